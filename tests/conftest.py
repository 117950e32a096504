"""One session for all tests."""

import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parent.parent)]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from ticketloom.session import build_session, ship_code

    session = build_session("tests", cores="4", shuffle_partitions=4, **{"spark.driver.memory": "3g"})
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    ship_code(session)
    yield session
    session.stop()
