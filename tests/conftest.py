from __future__ import annotations

import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from stevedore.session import get_session

    warehouse = tempfile.mkdtemp(prefix="stevedore-wh-")
    session = get_session(
        "local[*]",
        "stevedore-tests",
        conf={
            "spark.sql.shuffle.partitions": "8",
            "spark.sql.warehouse.dir": warehouse,
            "spark.driver.memory": "4g",
            "spark.sql.maxMetadataStringLength": "10000",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def scratch(spark):
    """A new folder under the session's scratch root, for one test."""
    from stevedore.session import scratch_path

    return scratch_path(spark, "test")
