from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tablecraft.operators.sizing import SMALL_SOURCE_ROWS_CONF  # noqa: E402
from tablecraft.operators.skew import MAX_GROUP_ROWS_CONF  # noqa: E402
from tablecraft.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "local[8]",
        "tablecraft-tests",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(params=["plain", "large"])
def group_size(request, spark):
    """Run a test with the plain plans, then with every key of more than three rows treated as large."""
    if request.param == "large":
        spark.conf.set(MAX_GROUP_ROWS_CONF, "3")
    yield request.param
    spark.conf.unset(MAX_GROUP_ROWS_CONF)


@pytest.fixture(params=["broadcast", "shuffle"])
def source_size(request, spark):
    """Run a merge test with a small source, then with one too large to broadcast."""
    if request.param == "shuffle":
        spark.conf.set(SMALL_SOURCE_ROWS_CONF, "-1")
    yield request.param
    spark.conf.unset(SMALL_SOURCE_ROWS_CONF)
