import pytest

from tests.session import make_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = make_session()
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tiny():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.01"
