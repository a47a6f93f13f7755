"""Streams run to completion; each must equal its batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablecraft.operators.agreement import has_feedback
from tablecraft.session import working_dir
from tablecraft.sources.feed import between
from tablecraft.streaming.history import HistoryFolder, feed_stream, history_schema, maintain_history
from tablecraft.streaming.scoring import predict_stream, tally_stream
from workload.inputs import FEED, HISTORY, change_feed, stored, table
from workload.models import PriceModel
from workload.registry import query

# The feed arrives in three deliveries, cut at these instants.
_CUTS = ("2024-01-11 00:00:00", "2024-01-21 00:00:00")


def _deliveries(spark, d):
    """The feed, written once and then cut into its deliveries."""
    feed = stored(change_feed(spark, d), "feed")
    first, second = F.lit(_CUTS[0]).cast("timestamp"), F.lit(_CUTS[1]).cast("timestamp")
    at = F.col("_commit_timestamp")
    return feed.schema, [feed.where(at < first), feed.where((at >= first) & (at < second)), feed.where(at >= second)]


@query(
    f"""WITH {HISTORY} SELECT user_id, state, value, bronze_commit_version, effective_start_date, effective_end_date, is_active_record
    FROM history"""
)
def stream_scd2(spark, d):
    root = working_dir(spark, "stream-scd2")
    schema, deliveries = _deliveries(spark, d)
    folder = HistoryFolder(spark, f"{root}/history", history_schema(schema))
    batches = []
    for i, delivery in enumerate(deliveries):
        delivery.write.parquet(f"{root}/feed/delivery={i}")
        stream = feed_stream(spark, f"{root}/feed/*", schema)
        maintain_history(stream, folder, ["user_id"], f"{root}/checkpoint", on_batch=batches.append).awaitTermination()
    return folder.history(max(batches))


@query(f"WITH {FEED} SELECT * FROM feed WHERE _commit_timestamp >= TIMESTAMP '{_CUTS[0]}'")
def stream_feed(spark, d):
    """Deliveries consumed once each: what the later runs of the same query took in."""
    root = working_dir(spark, "stream-feed")
    schema, deliveries = _deliveries(spark, d)
    for i, delivery in enumerate(deliveries):
        delivery.write.parquet(f"{root}/feed/delivery={i}")
        stream = feed_stream(spark, f"{root}/feed/*", schema)
        (
            stream.writeStream.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{root}/seen/batch={n}"))
            .option("checkpointLocation", f"{root}/checkpoint")
            .trigger(availableNow=True)
            .start()
            .awaitTermination()
        )
    return between(
        spark.read.parquet(f"{root}/seen").where("batch > 0").drop("batch"), since_date=_CUTS[0]
    )


@query(
    """SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, 2.0::DOUBLE * l_quantity + 0.5::DOUBLE * l_extendedprice AS prediction
    FROM lineitem"""
)
def stream_predict(spark, d):
    root = working_dir(spark, "stream-predict")
    schema = table(spark, d, "lineitem").schema
    rows = feed_stream(spark, f"{d}/lineitem*.parquet", schema).select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"
    )
    predict_stream(
        rows, PriceModel, ["l_quantity", "l_extendedprice"], f"{root}/scored", f"{root}/checkpoint"
    ).awaitTermination()
    return spark.read.parquet(f"{root}/scored")


@query(
    """SELECT CASE WHEN toxic IS NULL THEN NULL WHEN toxic = 1 THEN false ELSE true END AS label, count(*) AS n FROM labels GROUP BY 1"""
)
def stream_tally(spark, d):
    root = working_dir(spark, "stream-tally")
    schema = table(spark, d, "labels").schema
    rows = feed_stream(spark, f"{d}/labels*.parquet", schema)
    value = has_feedback(F.when(F.col("toxic") == 1, "skip").when(F.col("quality") == 1, "yes").otherwise("no"))
    tally_stream(
        rows, value, lambda df, _: df.write.mode("overwrite").parquet(f"{root}/tally"), f"{root}/checkpoint"
    ).awaitTermination()
    return spark.read.parquet(f"{root}/tally")
