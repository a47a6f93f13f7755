"""Jobs from table to table: quality gate, history refresh and batch inference."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecraft.functions.change import BRONZE_VERSION, IS_ACTIVE
from tablecraft.operators.cdc import apply_feed, merge_history, standardize_history, version_range
from tablecraft.operators.quality import Check, gate
from tablecraft.operators.scoring import batch_inference
from tablecraft.operators.versions import max_commit_version, scalar
from tablecraft.plans.silver import silver_table
from tablecraft.sources.feed import from_version
from tablecraft.sources.tables import append, change_partitions, layout, overwrite, read


def check_table(spark: SparkSession, table: str, checks: Iterable[Check], quarantine_table: str) -> DataFrame:
    """The valid rows of a table; bad rows replace the quarantine table and raise ``ValueError``."""
    return gate(read(spark, table), checks, lambda bad: overwrite(bad, quarantine_table), table)


def silver_job(
    spark: SparkSession,
    source: str,
    target: str,
    options: Mapping[str, Any],
    checks: Iterable[Check] = (),
    quarantine_table: str | None = None,
    partition_by: Sequence[str] = (),
) -> None:
    """Read a bronze table, cleanse it by its options, check it, and replace the silver table.

    A failed check writes the bad rows to the quarantine table, if one is named, and leaves the silver table as it is.
    """
    write_bad = (lambda bad: overwrite(bad, quarantine_table)) if quarantine_table else None
    overwrite(silver_table(read(spark, source), options, checks, write_bad), target, partition_by)


def refresh_history_table(
    spark: SparkSession,
    feed: DataFrame,
    table: str,
    keys: Sequence[str],
    *,
    initial: DataFrame,
    initial_version: int,
    as_of: Any = None,
) -> None:
    """Create a type-2 history table from the initial rows, or bring it up to date with the feed.

    The feed is read from the highest version the table holds; that version may
    be read twice, which changes nothing. The table is partitioned by the active
    flag: a run replaces the active rows and appends the rows it closed; rows
    closed before stay where they are, and only those in the feed's versions are
    read, to tell replayed events.
    """
    if not spark.catalog.tableExists(table):
        overwrite(standardize_history(initial, initial_version, as_of), table, [IS_ACTIVE])
        return
    target = spark.table(table)
    events = from_version(feed, scalar(max_commit_version(target)))
    if layout(spark, table) != [IS_ACTIVE]:
        overwrite(merge_history(events, target, keys), table)
        return
    versions = version_range(events)
    if versions is None:
        return
    closed = target.where(~F.col(IS_ACTIVE) & F.col(BRONZE_VERSION).between(*versions))

    def refreshed(active: DataFrame) -> DataFrame:
        known = active.withColumn("stored_before", F.lit(False)).unionByName(closed.withColumn("stored_before", F.lit(True)))
        changed = apply_feed(events, known, keys)
        return changed.where(~F.coalesce("stored_before", F.lit(False))).select(*target.columns)

    change_partitions(spark, table, spark.range(1).select(F.lit(True).alias(IS_ACTIVE)), refreshed)


def infer_table(
    spark: SparkSession,
    table: str,
    output_table: str,
    load_model: Callable[[], Any],
    features: Sequence[str],
    model_id: str,
    as_of: Any = None,
    **options: Any,
) -> None:
    """Append stamped predictions for all rows of a table, adding new columns to the output."""
    scored = batch_inference(read(spark, table), load_model, features, model_id, as_of, **options)
    append(scored, output_table)
