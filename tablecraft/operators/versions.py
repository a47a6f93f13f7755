"""Questions about commit versions, commit logs and freshness.

A commit log is a frame with ``version``, ``timestamp``, ``operation`` and
``operationParameters``. Every function returns a frame of one row (or a sorted
frame); :func:`scalar` fetches the single value where a job needs it.
"""

from __future__ import annotations

from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime
from functools import reduce
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecraft.functions.change import BRONZE_VERSION
from tablecraft.functions.time import instant

# Operations that change data, and those that are no data change.
DATA_OPERATIONS = ("MERGE", "WRITE", "CREATE TABLE", "DELETE", "UPDATE", "TRUNCATE")
MAINTENANCE_OPERATIONS = ("OPTIMIZE", "VACUUM START", "VACUUM END", "CHANGE COLUMN")
NO_VERSION = -1


def scalar(df: DataFrame) -> Any:
    """First value of a one-row frame."""
    row = df.first()
    return None if row is None else row[0]


def max_commit_version(df: DataFrame, column: str = BRONZE_VERSION) -> DataFrame:
    """Highest version in the table, -1 when there is none."""
    return df.agg(F.coalesce(F.max(column), F.lit(NO_VERSION)).cast("long").alias("max_version"))


def current_commit_version(log: DataFrame) -> DataFrame:
    return log.agg(F.max("version").alias("version"))


def data_history(log: DataFrame) -> DataFrame:
    """Commits that changed data, newest first."""
    return (
        log.where(F.col("operation").isin(*DATA_OPERATIONS))
        .select("version", "timestamp", "operation", "operationParameters")
        .orderBy(F.col("timestamp").desc(), F.col("version").desc())
    )


def latest_ingestion(log: DataFrame) -> DataFrame:
    """Time of the newest data commit."""
    return log.where(F.col("operation").isin(*DATA_OPERATIONS)).agg(F.max("timestamp").alias("timestamp"))


def closest_version(log: DataFrame, timestamp: str | datetime | Column) -> DataFrame:
    """Version of the last commit at or before an instant; null when there is none."""
    earlier = log.where(F.col("timestamp") <= instant(timestamp))
    return earlier.agg(F.max_by("version", F.struct("timestamp", "version")).alias("version"))


def last_change_version(log: DataFrame) -> DataFrame:
    """Newest version that is no maintenance; else the newest one, 0 for an empty log."""
    changed = F.when(~F.col("operation").isin(*MAINTENANCE_OPERATIONS), F.col("version"))
    return log.agg(F.coalesce(F.max(changed), F.max("version"), F.lit(0)).cast("long").alias("version"))


def _modified(df: DataFrame) -> DataFrame:
    """Newest value over the columns named after a timestamp or date."""
    temporal = (T.TimestampType, T.TimestampNTZType, T.DateType)
    names = [
        f.name
        for f in df.schema.fields
        if ("timestamp" in f.name.lower() or "date" in f.name.lower()) and isinstance(f.dataType, temporal)
    ]
    if not names:
        return df.sparkSession.range(1).select(F.lit(None).cast("timestamp").alias("last_modified"))
    newest = [F.max(F.col(c).cast("timestamp")) for c in names]
    return df.agg((newest[0] if len(newest) == 1 else F.greatest(*newest)).alias("last_modified"))


def freshness(tables: Mapping[str, DataFrame], logs: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """One row per table with its last modification.

    A table with a commit log is as fresh as its newest commit (falling back to
    the data for an empty log), any other as its newest date or timestamp value.
    """
    logs = logs or {}
    parts = []
    for name, df in tables.items():
        row = _modified(df)
        if name in logs:
            committed = logs[name].agg(F.max("timestamp").cast("timestamp").alias("committed"))
            row = row.withColumn("__one", F.lit(1)).join(committed.withColumn("__one", F.lit(1)), "__one")
            row = row.select(F.coalesce("committed", "last_modified").alias("last_modified"))
        parts.append(row.select(F.lit(name).alias("table_name"), "last_modified"))
    if not parts:
        raise ValueError("no tables given")
    return reduce(DataFrame.unionByName, parts)


# Tables of a schema that are looked at side by side.
TABLES_AT_ONCE = 8


def schema_freshness(spark: SparkSession, schema: str, logs: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Freshness of every table of a schema; null for a table that cannot be read as a whole.

    Each table is an action of its own and read strictly: a broken or missing file makes the table's value null, not
    that of its other files, and leaves the report whole.
    """
    logs = logs or {}

    def modified(name: str) -> tuple[str, datetime | None]:
        try:
            df = spark.read.options(ignoreCorruptFiles="false", ignoreMissingFiles="false").table(f"`{schema}`.`{name}`")
            return name, freshness({name: df}, {name: logs[name]} if name in logs else None).first()["last_modified"]
        except (PySparkException, Py4JJavaError):
            return name, None

    names = [entry.name for entry in spark.catalog.listTables(schema) if not entry.isTemporary]
    with ThreadPoolExecutor(TABLES_AT_ONCE) as pool:
        found = list(pool.map(modified, names))
    return spark.createDataFrame(found, "table_name string, last_modified timestamp")


# -- metadata frames ----------------------------------------------------------


def tables_of_format(tables: DataFrame, catalog: str, schema: str, data_format: str = "DELTA") -> DataFrame:
    """Tables of a schema stored in one format, from an information-schema frame."""
    wanted = (
        (F.col("table_catalog") == catalog)
        & (F.col("table_schema") == schema)
        & (F.col("data_source_format") == data_format)
    )
    return tables.where(wanted).select("table_catalog", "table_schema", "table_name")


# Names in information-schema views.
_TABLE = ("table_catalog", "table_schema", "table_name")
_CONSTRAINT = ("constraint_catalog", "constraint_schema", "constraint_name")
_TAGGED_TABLE = ("catalog_name", "schema_name", "table_name")


def table_constraints(usage: DataFrame, constraints: DataFrame) -> DataFrame:
    """Every constrained column with the kind and name of its constraint."""
    kinds = constraints.select(*_CONSTRAINT, "constraint_type")
    return usage.join(kinds, list(_CONSTRAINT)).select(
        *_TABLE, "column_name", "ordinal_position", "constraint_name", "constraint_type"
    )


def primary_key_columns(usage: DataFrame, constraints: DataFrame) -> DataFrame:
    """Primary-key columns of every table, in key order."""
    primary = constraints.where(F.col("constraint_type") == "PRIMARY KEY")
    return (
        table_constraints(usage, primary)
        .select(*_TABLE, "column_name", "ordinal_position")
        .orderBy(*_TABLE, "ordinal_position")
    )


def tagged_columns(column_tags: DataFrame, tag: str) -> DataFrame:
    """First column per table, by name, that carries a tag."""
    return (
        column_tags.where(F.col("tag_name") == tag)
        .groupBy(*_TAGGED_TABLE)
        .agg(F.min("column_name").alias("column_name"))
    )


def table_tags(tags: DataFrame) -> DataFrame:
    return tags.select(*_TAGGED_TABLE, "tag_name").distinct()
