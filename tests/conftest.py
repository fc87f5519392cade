import pytest

from quaestor.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session("tests", "8")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
