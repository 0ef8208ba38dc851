"""Point-in-time panel analytics as user-level PySpark operators.

Operators take and return a ``DataFrame`` (or ``Column``), lazy unless the docstring says
eager (placebo, power, unbalanced effects, guards); column names are parameters.  See ``README.md`` for the map from task to module.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The few functions that run in Python workers travel with the job, so executors
# need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
