import pytest

from faultlens.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(partitions=4)


SF = "/root/testdata/sf0.001"
