"""Change-feed reads and configuration-driven loaders.

Loaders take functions from a table name to a frame, so that a caller decides
where tables, feeds and commit logs live. Every frame stays lazy.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecraft.functions.change import BRONZE_VERSION, COMMIT_TIMESTAMP, COMMIT_VERSION
from tablecraft.functions.time import instant
from tablecraft.operators.versions import (
    closest_version,
    current_commit_version,
    latest_ingestion,
    max_commit_version,
    scalar,
)

Reader = Callable[[str], DataFrame]
Config = Mapping[str, Mapping[str, Any]]


def from_version(feed: DataFrame, version: int) -> DataFrame:
    """Feed events of a version and later."""
    return feed.where(F.col(COMMIT_VERSION) >= version)


def between(
    feed: DataFrame,
    *,
    since_version: int | None = None,
    since_date: str | datetime | None = None,
    ending_version: int | None = None,
    ending_date: str | datetime | None = None,
) -> DataFrame:
    """Feed events within bounds, both inclusive; a date wins over a version."""
    if since_date is not None:
        feed = feed.where(F.col(COMMIT_TIMESTAMP) >= instant(since_date))
    elif since_version is not None:
        feed = feed.where(F.col(COMMIT_VERSION) >= since_version)
    if ending_date is not None:
        feed = feed.where(F.col(COMMIT_TIMESTAMP) <= instant(ending_date))
    elif ending_version is not None:
        feed = feed.where(F.col(COMMIT_VERSION) <= ending_version)
    return feed


def load_tables(
    config: Config,
    read: Reader,
    read_feed: Reader | None = None,
    starting_version: int | None = None,
) -> dict[str, dict[str, Any]]:
    """Copy of the config with a ``dataframe`` per table: its feed from a version, or the whole table."""
    loaded = {}
    for alias, entry in config.items():
        name = entry.get("table_name")
        if not name:
            raise ValueError(f"{alias} has no table_name")
        if entry.get("read_cdc", False) and starting_version is not None:
            if read_feed is None:
                raise ValueError(f"{alias} reads a change feed, but no read_feed is given")
            frame = from_version(read_feed(name), starting_version)
        else:
            frame = read(name)
        loaded[alias] = {**entry, "dataframe": frame}
    return loaded


def stamp_version(df: DataFrame, version: int) -> DataFrame:
    return df.withColumn(BRONZE_VERSION, F.lit(version).cast("long"))


def load_targets(
    config: Config,
    read: Reader,
    read_feed: Reader,
    read_log: Reader,
    is_bulk_load: bool = False,
) -> dict[str, dict[str, Any]]:
    """Per target: the whole source stamped with its current version, or the feed since the target's version.

    The feed starts at the target's highest version itself, so applying it has
    to be idempotent, as ``merge_history`` is.
    """
    loaded = {}
    for alias, entry in config.items():
        missing = [k for k in ("read_cdc", "table_name", "target_table_name") if entry.get(k) in (None, "")]
        if missing:
            raise ValueError(f"{alias} lacks {missing}")
        name = entry["table_name"]
        if is_bulk_load:
            frame = stamp_version(read(name), scalar(current_commit_version(read_log(name))))
        else:
            start = scalar(max_commit_version(read(entry["target_table_name"])))
            frame = from_version(read_feed(name), start)
        loaded[alias] = {**entry, "dataframe": frame}
    return loaded


def incremental_feed(feed: DataFrame, source_log: DataFrame, target_log: DataFrame) -> DataFrame:
    """Source events since the source version nearest before the target's last ingestion.

    Without such a version the whole feed is due.
    """
    ingested = scalar(latest_ingestion(target_log))
    if ingested is None:
        return feed
    start = scalar(closest_version(source_log, ingested))
    return feed if start is None else from_version(feed, start)


def load_incremental(config: Config, target_table: str, read_feed: Reader, read_log: Reader) -> dict[str, dict[str, Any]]:
    """Copy of the config with each source's incremental feed as ``dataframe``."""
    target_log = read_log(target_table)
    return {
        alias: {
            **entry,
            "dataframe": incremental_feed(
                read_feed(entry["table_name"]), read_log(entry["table_name"]), target_log
            ),
        }
        for alias, entry in config.items()
    }
