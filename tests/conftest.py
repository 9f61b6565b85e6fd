"""One local session for all tests."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from quire.session import local_session

    shared = tmp_path_factory.mktemp("shared")
    extra = {"spark.checkpoint.dir": f"file://{shared}", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")), "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"}
    session = local_session(4, **extra)
    yield session
    session.stop()
