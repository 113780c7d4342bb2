import pytest

from skein.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session("tests", cores=4, shuffle=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
