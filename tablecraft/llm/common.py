"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablecraft.session import working_dir

# A frame of ids or parameters with at most this many rows (some 32 MB) is sent to every executor; a larger one
# is joined by shuffling. The rows are counted first.
BROADCAST_ROWS = 1_000_000
# Words whose hashes a task keeps at hand.
CACHED_WORDS = 100_000
# Documents that a task holds as Python objects at once.
SLICE_ROWS = 256


def keep(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back: a lost executor costs no earlier step again."""
    path = working_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored._stored_at = path
    return stored


def discard(stored: DataFrame) -> None:
    """Remove what ``keep`` wrote for ``stored``; nothing that is still to run may read it."""
    spark = stored.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(stored._stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcasting when it has at most ``limit`` rows, else as it is. ``df`` should be stored."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def without_documents(docs: DataFrame, removed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` without those whose id is in the one column of ``removed``; rows without an id stay."""
    removed = small(keep(removed.distinct(), "removed-ids").toDF("__removed"))
    return docs.join(removed, docs[id_col] == removed["__removed"], "left_anti")


def text_bytes(batch: pa.RecordBatch, name: str) -> Iterator[bytes | None]:
    """UTF-8 bytes of a string column, a slice of rows at a time."""
    column = batch.column(name)
    for at in range(0, len(column), SLICE_ROWS):
        yield from column.slice(at, SLICE_ROWS).cast(pa.binary()).to_pylist()


class WordHashes(dict):
    """64-bit hash of each word, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit values (the finalizer of splitmix64)."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def multiplier(at: int) -> np.uint64:
    """An odd 64-bit number for position ``at``."""
    return np.uint64((0x9E3779B97F4A7C15 * (2 * at + 1)) & 0xFFFFFFFFFFFFFFFF | 1)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """One hash per run of ``size`` neighbouring words."""
    count = len(words) - size + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    total = np.full(count, size, np.uint64)
    for at in range(size):
        total = total + mixed(words[at : at + count] * multiplier(at))
    return mixed(total)


def lists(values: Iterable[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list column from arrays, without a Python object per element."""
    values = list(values)
    offsets = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    flat = np.concatenate(values) if values else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def numbered(df: DataFrame, groups: list[str], order: list[str], name: str) -> DataFrame:
    """Number the rows of each group from 0 without gaps, in ``order``; no group meets in one task.

    Rows are range-partitioned by group and order, stored, counted per partition, and numbered from the counts of the
    partitions before. ``order`` should tell rows apart; rows equal in it are numbered in any order.
    """
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = keep(
        df.repartitionByRange(width, *groups, *order)
        .sortWithinPartitions(*groups, *order)
        .select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__row")),
        "numbered",
    )
    counts = placed.groupBy(*groups, "__part").agg(F.count("*").alias("__n"), F.min("__row").alias("__first"))
    before = Window.partitionBy(*groups).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        *groups, "__part", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")
    )
    starts = small(keep(starts, "numbered-starts"))
    same = [placed[g].eqNullSafe(starts[g]) for g in groups]
    joined = placed.join(starts, [placed["__part"] == starts["__part"], *same])
    return joined.select(
        *[placed[c] for c in df.columns],
        (F.col("__before") + F.col("__row") - F.col("__first")).cast("long").alias(name),
    )
