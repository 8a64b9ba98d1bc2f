import pytest

from riskloom.session import session


@pytest.fixture(scope="session")
def spark():
    return session("local[8]", partitions=8, memory="6g")
