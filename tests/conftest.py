import pytest

from wirelake.session import get_session


@pytest.fixture(scope="session")
def spark():
    s = get_session(master="local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.showConsoleProgress": "false"})
    yield s
    s.stop()
