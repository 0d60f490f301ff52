import pytest

from weftgraph.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", 4, "weftgraph-tests")
    session.sparkContext.setLogLevel("ERROR")
    return session
