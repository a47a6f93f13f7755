"""Change feeds as streams, applied to a history continuously.

The history is kept below one root, one Parquet folder per micro-batch:

``batch=<n>/is_active_record=false``  rows closed by batch n, never touched again
``batch=<n>/is_active_record=true``   all active rows after batch n

A micro-batch reads the active rows of the batch before it, plus closed rows
recent enough to be replayed, and writes its own folder in one job. So its cost
follows the active rows and the batch, not the length of the history, and a
repeated batch overwrites its own output with the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tablecraft.functions.change import BRONZE_VERSION, FEED_COLUMNS, HISTORY_COLUMNS, IS_ACTIVE
from tablecraft.operators.cdc import apply_feed, version_range


def feed_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    """Feed files as a stream; the query's checkpoint remembers what was consumed."""
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def history_schema(feed_schema: T.StructType) -> T.StructType:
    """Schema of the history a feed leads to."""
    business = [f for f in feed_schema.fields if f.name not in FEED_COLUMNS]
    types = dict(zip(HISTORY_COLUMNS, ("timestamp", "timestamp", "boolean", "bigint")))
    return T.StructType([*business, *[T.StructField(c, T._parse_datatype_string(t)) for c, t in types.items()]])


class HistoryFolder:
    """Reads and writes the folders described above."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema

    def exists(self, path: str) -> bool:
        name = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        found = name.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(name)
        return found is not None and len(found) > 0

    def holds_batches(self) -> bool:
        return self.exists(f"{self.root}/batch=*")

    def _rows(self) -> DataFrame:
        schema = T.StructType([*self.schema.fields, T.StructField("batch", T.LongType())])
        return self.spark.read.schema(schema).parquet(self.root)

    def _closed_before(self, batch: int) -> DataFrame:
        if batch <= 0:
            return self.empty()
        return self._rows().where(~F.col(IS_ACTIVE) & (F.col("batch") < batch)).select(*self.schema.names)

    def empty(self) -> DataFrame:
        return self.spark.createDataFrame([], self.schema)

    def active(self, batch: int) -> DataFrame:
        """Active rows after a batch; none before the first."""
        if batch < 0:
            return self.empty()
        return self._rows().where(F.col(IS_ACTIVE) & (F.col("batch") == batch)).select(*self.schema.names)

    def history(self, batch: int) -> DataFrame:
        """The whole history after a batch."""
        return self._closed_before(batch + 1).unionByName(self.active(batch))

    def apply(self, feed: DataFrame, batch: int, keys: Sequence[str], tie_break: Sequence[str] = ()) -> None:
        """Apply one micro-batch of feed events and write its folder."""
        versions = version_range(feed)
        rows = self.active(batch - 1)
        if versions is not None:
            stored = self._closed_before(batch).where(F.col(BRONZE_VERSION).between(*versions))
            known = rows.withColumn("stored_before", F.lit(False)).unionByName(
                stored.withColumn("stored_before", F.lit(True))
            )
            changed = apply_feed(feed, known, keys, tie_break=tie_break)
            rows = changed.where(~F.coalesce("stored_before", F.lit(False)))
        (
            rows.select(*self.schema.names)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "static")
            .partitionBy(IS_ACTIVE)
            .parquet(f"{self.root}/batch={batch}")
        )


def maintain_history(
    feed: DataFrame,
    folder: HistoryFolder,
    keys: Sequence[str],
    checkpoint: str,
    *,
    tie_break: Sequence[str] = (),
    available_now: bool = True,
    on_batch: Callable[[int], None] | None = None,
) -> StreamingQuery:
    """Start a query that applies a feed stream to a history folder.

    A checkpoint and a folder belong together: with a new checkpoint, batches would count from 0 again and replace
    those in the folder, so a folder that holds batches is refused then.
    """
    if folder.holds_batches() and not folder.exists(f"{checkpoint.rstrip('/')}/offsets"):
        raise ValueError(f"{folder.root} holds batches of another checkpoint than {checkpoint}")

    def apply(events: DataFrame, batch: int) -> None:
        folder.apply(events, batch, keys, tie_break)
        if on_batch is not None:
            on_batch(batch)

    writer = feed.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
