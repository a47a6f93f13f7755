"""Jobs from table to table."""

from __future__ import annotations

import sys
from datetime import datetime

import pytest
from helpers import rows
from pyspark import cloudpickle

from tablecraft.operators.quality import Check
from tablecraft.plans.jobs import check_table, infer_table, refresh_history_table
from tablecraft.sources.tables import overwrite

# The model below travels with its tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@pytest.fixture
def tables(spark):
    names = ("job_in", "job_out")
    yield names
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_check_table(spark, tables):
    source, quarantine = tables
    overwrite(spark.createDataFrame([("1",), (" ",), (None,)], "pk string"), source)
    check = Check("is_not_null_and_not_empty", {"column": "pk", "trim_strings": True}, criticality="warn")
    with pytest.raises(ValueError, match="2 rows quarantined"):
        check_table(spark, source, [check], quarantine)
    assert rows(spark.table(quarantine), "pk") == [(None,), (" ",)]


FEED = "k string, v string, _change_type string, _commit_timestamp timestamp, _commit_version bigint"


def test_refresh_history_table(spark, tables):
    table = tables[1]
    initial = spark.createDataFrame([("a", "1"), ("b", "1")], "k string, v string")
    t = [datetime(2025, 1, d) for d in range(1, 6)]
    feed = spark.createDataFrame(
        [
            ("a", "1", "update_preimage", t[1], 1),
            ("a", "2", "update_postimage", t[1], 1),
            ("b", "1", "delete", t[2], 2),
        ],
        FEED,
    )

    def refresh(upto):
        refresh_history_table(
            spark, feed.where(f"_commit_version <= {upto}"), table, ["k"], initial=initial, initial_version=0, as_of=t[0]
        )
        columns = ("k", "v", "effective_start_date", "effective_end_date", "is_active_record", "bronze_commit_version")
        return rows(spark.table(table), *columns)

    def files(active):
        return {r[0] for r in spark.table(table).where(f"is_active_record = {active}").select("_metadata.file_name").distinct().collect()}

    assert refresh(0) == [("a", "1", t[0], None, True, 0), ("b", "1", t[0], None, True, 0)]
    changed = [("a", "1", t[0], t[1], False, 0), ("a", "2", t[1], None, True, 1)]
    assert refresh(1) == [*changed, ("b", "1", t[0], None, True, 0)]
    before = files(False)
    closed = [*changed, ("b", "1", t[0], t[2], False, 0)]
    assert refresh(2) == closed
    assert refresh(2) == closed
    assert refresh(2) == closed and files(False) > before
    plan = spark.table(table).where("is_active_record")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(is_active_record" in plan


class Plus:
    def predict(self, x):
        return x.iloc[:, 0].to_numpy() + 1.0


def test_infer_table(spark, tables):
    source, output = tables
    overwrite(spark.createDataFrame([(1.0,)], "x double"), source)
    infer_table(spark, source, output, Plus, ["x"], "m@1", "2025-01-01 00:00:00")
    overwrite(spark.createDataFrame([(2.0, "n")], "x double, note string"), source)
    infer_table(spark, source, output, Plus, ["x"], "m@2", "2025-01-02 00:00:00")
    assert rows(spark.table(output), "x", "prediction", "model_id", "note") == [
        (1.0, 2.0, "m@1", None), (2.0, 3.0, "m@2", "n"),
    ]
