import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from ledgerloom.session import local_session, release

    session = local_session("4", "tests", partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    release(session)
    session.stop()
