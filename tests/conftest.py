import pytest

from .session import session


@pytest.fixture(scope="session")
def spark():
    return session()
