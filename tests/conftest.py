import pytest

from cairn.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores="8", memory="8g", partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    return session
