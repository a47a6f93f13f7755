"""Streams give what the batch operators give, also after a repeated batch."""

from __future__ import annotations

import sys
from datetime import datetime, timedelta

import pytest
from pyspark import cloudpickle
from helpers import rows
from pyspark.sql import functions as F

from tablecraft.operators.agreement import has_feedback
from tablecraft.operators.cdc import history_rows
from tablecraft.session import working_dir
from tablecraft.streaming.history import HistoryFolder, feed_stream, history_schema, maintain_history
from tablecraft.streaming.scoring import predict_stream, tally_stream

FEED = "k string, v string, _change_type string, _commit_timestamp timestamp, _commit_version bigint"

# The models below travel with their tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _feed(spark):
    t = [datetime(2025, 1, 1) + timedelta(days=i) for i in range(8)]
    return spark.createDataFrame(
        [
            ("a", "1", "insert", t[0], 0),
            ("b", "1", "insert", t[1], 1),
            ("a", "1", "update_preimage", t[2], 2),
            ("a", "2", "update_postimage", t[2], 2),
            ("b", "1", "delete", t[3], 3),
            ("c", "1", "insert", t[4], 4),
            ("a", "2", "update_preimage", t[5], 5),
            ("a", "3", "update_postimage", t[5], 5),
            ("b", "9", "insert", t[6], 6),
            ("c", "1", "delete", t[7], 7),
        ],
        FEED,
    )


@pytest.mark.parametrize("overlap", [0, 2])
def test_history_stream(spark, group_size, overlap):
    """Deliveries may re-read commits of the one before."""
    root = working_dir(spark, "history")
    feed = _feed(spark)
    folder = HistoryFolder(spark, f"{root}/history", history_schema(feed.schema))
    batches = []
    for i, (low, high) in enumerate([(0, 2), (3, 4), (5, 7)]):
        load = feed.where((F.col("_commit_version") >= low - overlap) & (F.col("_commit_version") <= high))
        load.write.parquet(f"{root}/feed/delivery={i}")
        stream = feed_stream(spark, f"{root}/feed/*", feed.schema)
        maintain_history(stream, folder, ["k"], f"{root}/checkpoint", on_batch=batches.append).awaitTermination()
    assert batches == [0, 1, 2]
    expected = history_rows(feed, ["k"])
    assert rows(folder.history(2).select(*expected.columns)) == rows(expected)
    # Earlier states stay readable.
    assert folder.history(0).count() == 3 and folder.active(-1).count() == 0

    # The last batch runs again, as after a lost driver.
    folder.apply(feed.where("_commit_version >= 5"), 2, ["k"])
    assert rows(folder.history(2).select(*expected.columns)) == rows(expected)
    # An empty batch keeps the state.
    folder.apply(feed.limit(0), 3, ["k"])
    assert rows(folder.history(3).select(*expected.columns)) == rows(expected)


def test_history_stream_refuses_another_checkpoint(spark):
    root = working_dir(spark, "history")
    feed = _feed(spark)
    folder = HistoryFolder(spark, f"{root}/history", history_schema(feed.schema))
    feed.write.parquet(f"{root}/feed/delivery=0")
    stream = feed_stream(spark, f"{root}/feed/*", feed.schema)
    maintain_history(stream, folder, ["k"], f"{root}/checkpoint").awaitTermination()
    before = rows(folder.history(0))
    with pytest.raises(ValueError, match="another checkpoint"):
        maintain_history(feed_stream(spark, f"{root}/feed/*", feed.schema), folder, ["k"], f"{root}/new")
    maintain_history(feed_stream(spark, f"{root}/feed/*", feed.schema), folder, ["k"], f"{root}/checkpoint").awaitTermination()
    assert rows(folder.history(0)) == before


class Plus:
    def predict(self, x):
        return x.iloc[:, 0].to_numpy() + 1.0


def test_predict_stream(spark):
    root = working_dir(spark, "predict")
    df = spark.createDataFrame([(1.0,), (2.0,)], "x double")
    for i in range(2):
        df.write.parquet(f"{root}/in/part={i}")
        stream = feed_stream(spark, f"{root}/in/*", df.schema)
        predict_stream(stream, Plus, ["x"], f"{root}/out", f"{root}/checkpoint").awaitTermination()
    assert rows(spark.read.parquet(f"{root}/out"), "prediction") == [(2.0,), (2.0,), (3.0,), (3.0,)]


def test_tally_stream(spark):
    root = working_dir(spark, "tally")
    for i, values in enumerate([["yes", None], ["no", "later"]]):
        df = spark.createDataFrame([(v,) for v in values], "v string")
        df.write.parquet(f"{root}/in/part={i}")
        stream = feed_stream(spark, f"{root}/in/*", df.schema)
        tally_stream(
            stream,
            has_feedback(F.col("v")),
            lambda counts, n: counts.write.mode("overwrite").parquet(f"{root}/out"),
            f"{root}/checkpoint",
        ).awaitTermination()
    assert rows(spark.read.parquet(f"{root}/out")) == [(None, 1), (False, 1), (True, 2)]
