"""Deterministic deduplication."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Literal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_RANK = "__rank"


def top_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of every key in ``order``; null keys form one group.

    Filtering the row number to one lets Spark keep a single row per key and
    map task before the shuffle, so a large key never travels whole.
    """
    w = Window.partitionBy(*[F.col(k) for k in keys]).orderBy(*order)
    return df.withColumn(_RANK, F.row_number().over(w)).where(F.col(_RANK) == 1).drop(_RANK)


def dedupe(
    df: DataFrame,
    subset: Sequence[str] | None = None,
    keep: Literal["first", "last", False] = "first",
    order_by: Sequence[str] = (),
) -> DataFrame:
    """Drop duplicates of ``subset`` (all columns when ``None``).

    ``keep`` is ``"first"`` or ``"last"`` in ``order_by``, or ``False`` to drop
    every row that has a duplicate. A cluster has no physical row order, so
    first and last need ``order_by``.
    """
    columns = df.columns
    keys = list(subset) if subset is not None else columns
    if keep is False:
        rest = [c for c in columns if c not in keys]
        aggs = [F.count(F.lit(1)).alias("__n")]
        if rest:
            aggs.append(F.first(F.struct(*rest)).alias("__row"))
        single = df.groupBy(*keys).agg(*aggs).where(F.col("__n") == 1)
        return single.select(*[F.col(c) if c in keys else F.col(f"__row.{c}").alias(c) for c in columns])
    if keep not in ("first", "last"):
        raise ValueError(f"keep must be 'first', 'last' or False, not {keep!r}")
    if set(keys) == set(columns):
        return df.dropDuplicates()
    if not order_by:
        raise ValueError("keeping the first or last row of a group needs order_by")
    order = [F.col(c).asc() if keep == "first" else F.col(c).desc() for c in order_by]
    return top_row(df, keys, order)


def dedupe_latest(df: DataFrame, keys: Sequence[str], timestamp: str, tie_break: Sequence[str] = ()) -> DataFrame:
    """The row with the newest business timestamp per key."""
    return top_row(df, keys, [F.col(timestamp).desc_nulls_last(), *[F.col(c).desc() for c in tie_break]])
