import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from pitpanel.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("pitpanel-tests", cpus=8, conf={"spark.driver.memory": "6g"})
    yield session
    session.stop()
