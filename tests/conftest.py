"""One session for all tests."""

import pytest

from orrery.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
