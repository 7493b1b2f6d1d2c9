import pytest

from cohortloom import session


@pytest.fixture(scope="session")
def spark():
    s = session.build("4", 4)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
