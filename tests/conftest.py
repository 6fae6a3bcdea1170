import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def log_dir(tmp_path_factory):
    return str(tmp_path_factory.mktemp("eventlog"))


@pytest.fixture(scope="session")
def spark(log_dir, tmp_path_factory):
    from emberscope.runtime import local_session

    warehouse = str(tmp_path_factory.mktemp("warehouse"))
    session = local_session(
        "tests", cpus=4,
        **{"spark.eventLog.enabled": "true", "spark.eventLog.dir": f"file://{log_dir}", "spark.sql.warehouse.dir": warehouse,
           "spark.sql.shuffle.partitions": "4"},
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR
