import pytest

from issuelake.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", 8, 8)
    yield session
    session.stop()
