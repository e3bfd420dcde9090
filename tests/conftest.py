import pytest

from strataloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session("tests", 4)
