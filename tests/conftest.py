import pytest

from stintlake.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session("tests", "8", memory="6g")
    yield session
    session.stop()
