import pytest

from lexfold.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(cpus=4, app="tests", partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
