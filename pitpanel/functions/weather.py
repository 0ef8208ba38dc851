"""Weather index expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_BASE_C = 15.5


def degree_deficit(temperature: Column | str, *, base_c: float = DEFAULT_BASE_C) -> Column:
    """``max(0, base - T)``; NULL stays NULL (``greatest`` alone would skip it)."""
    t = F.col(temperature) if isinstance(temperature, str) else temperature
    return F.when(t.isNotNull(), F.greatest(F.lit(base_c) - t, F.lit(0.0)))
