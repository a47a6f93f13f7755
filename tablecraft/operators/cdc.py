"""Change feeds and type-2 history."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecraft.functions.change import (
    BRONZE_VERSION,
    CHANGE_TYPE,
    COMMIT_TIMESTAMP,
    COMMIT_VERSION,
    DELETE,
    END_DATE,
    FEED_COLUMNS,
    HISTORY_COLUMNS,
    INSERT,
    IS_ACTIVE,
    START_DATE,
    UPDATE_POSTIMAGE,
    UPDATE_PREIMAGE,
    all_of,
)
from tablecraft.functions.time import instant
from tablecraft.operators.dedupe import top_row
from tablecraft.operators.sizing import is_small
from tablecraft.operators.skew import carry

_RANK = "__rank"
_FROM_TARGET = "__from_target"


def filter_change_types(feed: DataFrame, types: Sequence[str]) -> DataFrame:
    return feed.where(F.col(CHANGE_TYPE).isin(list(types)))


def _rank() -> Column:
    """Order of the change types within one commit: delete, preimage, new image."""
    return (
        F.when(F.col(CHANGE_TYPE) == DELETE, 0)
        .when(F.col(CHANGE_TYPE) == UPDATE_PREIMAGE, 1)
        .otherwise(2)
    )


def oldest_closing_event(feed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key the earliest preimage or delete: keys, commit timestamp, bronze version."""
    first = F.min(F.struct(COMMIT_VERSION, COMMIT_TIMESTAMP)).alias("first")
    return (
        filter_change_types(feed, [UPDATE_PREIMAGE, DELETE])
        .groupBy(*keys)
        .agg(first)
        .select(
            *keys,
            F.col(f"first.{COMMIT_TIMESTAMP}").alias(COMMIT_TIMESTAMP),
            F.col(f"first.{COMMIT_VERSION}").alias(BRONZE_VERSION),
        )
    )


def _end_date(tie_break: Sequence[str]) -> Column:
    """End of a new history row, refusing two new images of a key in one commit."""
    end = F.col("__next.ts")
    if tie_break:
        return end
    same_commit = (
        (F.col("__next.version") == F.col(BRONZE_VERSION))
        & (F.col("__next.ts") == F.col(START_DATE))
        & (F.col("__next.rank") == 2)
    )
    return F.when(
        same_commit,
        F.raise_error(F.lit("two new images of one key in one commit: give tie_break columns")),
    ).otherwise(end)


def _as_history(feed: DataFrame) -> DataFrame:
    """Feed events under the history column names, with their rank in a commit."""
    business = [c for c in feed.columns if c not in FEED_COLUMNS]
    return feed.select(
        *business,
        F.col(COMMIT_TIMESTAMP).alias(START_DATE),
        F.lit(None).cast("timestamp").alias(END_DATE),
        F.lit(True).alias(IS_ACTIVE),
        F.col(COMMIT_VERSION).alias(BRONZE_VERSION),
        _rank().alias(_RANK),
    )


def _next_event() -> Column:
    return F.struct(
        F.col(START_DATE).alias("ts"), F.col(BRONZE_VERSION).alias("version"), F.col(_RANK).alias("rank")
    )


def history_rows(feed: DataFrame, keys: Sequence[str], tie_break: Sequence[str] = ()) -> DataFrame:
    """Turn feed events into history rows.

    Inserts and postimages open a row; the key's next insert, postimage or
    delete ends it.
    """
    events = _as_history(feed.where(F.col(CHANGE_TYPE) != UPDATE_PREIMAGE))
    order = [BRONZE_VERSION, START_DATE, _RANK, *tie_break]
    timeline = carry(events, keys, order, {"__next": _next_event()}, forward=True)
    business = [c for c in feed.columns if c not in FEED_COLUMNS]
    return (
        timeline.where(F.col(_RANK) == 2)
        .withColumn(END_DATE, _end_date(tie_break))
        .select(
            *business,
            BRONZE_VERSION,
            START_DATE,
            END_DATE,
            F.col(END_DATE).isNull().alias(IS_ACTIVE),
        )
    )


def merge_history(
    feed: DataFrame,
    target: DataFrame,
    keys: Sequence[str],
    *,
    tie_break: Sequence[str] = (),
) -> DataFrame:
    """New state of a type-2 history after applying a change feed.

    Active rows close at the key's earliest preimage or delete of a later
    version. New history rows are added unless the target already has the key
    and version, so a replay of any part of the feed changes nothing.

    Target rows and feed events are put on one timeline per key, hence a single
    shuffle on the keys. Closed rows outside the versions of the feed and, for a
    feed of few keys, rows of other keys cannot be affected and bypass it.
    """
    versions = version_range(feed)
    if versions is None:
        return target
    touched = F.coalesce(F.col(IS_ACTIVE) | F.col(BRONZE_VERSION).between(*versions), F.lit(True))
    changed = apply_feed(feed, target.where(touched), keys, tie_break=tie_break)
    return target.where(~touched).unionByName(changed, allowMissingColumns=True)


def version_range(feed: DataFrame) -> tuple[int, int] | None:
    """First and last commit version of a feed; ``None`` for an empty one."""
    first, last = feed.agg(F.min(COMMIT_VERSION), F.max(COMMIT_VERSION)).first()
    return None if first is None else (first, last)


def apply_feed(
    feed: DataFrame,
    touched: DataFrame,
    keys: Sequence[str],
    *,
    tie_break: Sequence[str] = (),
) -> DataFrame:
    """The part of :func:`merge_history` that looks at the affected target rows only.

    When the feed has few keys, target rows of other keys stay where they are.
    """
    key_names = [f"__feed_{k}" for k in keys]
    feed_keys = feed.select(*[F.col(k).alias(n) for k, n in zip(keys, key_names)]).distinct()
    if not is_small(feed_keys):
        return _timeline(feed, touched, keys, tie_break)
    match = all_of(F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, key_names))
    known = F.broadcast(feed_keys)
    changed = _timeline(feed, touched.join(known, match, "left_semi"), keys, tie_break)
    return touched.join(known, match, "left_anti").unionByName(changed, allowMissingColumns=True)


def _timeline(feed: DataFrame, touched: DataFrame, keys: Sequence[str], tie_break: Sequence[str]) -> DataFrame:
    events = _as_history(feed).withColumn(_FROM_TARGET, F.lit(0))
    existing = touched.withColumns({_RANK: F.lit(3), _FROM_TARGET: F.lit(1)})
    timeline = existing.unionByName(events, allowMissingColumns=True)

    is_feed = F.col(_FROM_TARGET) == 0
    values = {
        "__next": F.when(is_feed & (F.col(_RANK) != 1), _next_event()),
        "__close": F.when(is_feed & (F.col(_RANK) < 2), F.col(START_DATE)),
        # A target row sorts behind the events of its own version.
        "__known": F.when(~is_feed, F.col(BRONZE_VERSION)),
    }
    order = [BRONZE_VERSION, _FROM_TARGET, START_DATE, _RANK, *tie_break]
    # A key has one active row, and no more closed ones than the events they repeat.
    timeline = carry(timeline, keys, order, values, forward=True, measured=feed)

    columns = [c for c in timeline.columns if not c.startswith("__")]
    closes = ~is_feed & F.col(IS_ACTIVE) & F.col("__close").isNotNull()
    new_row = (F.col(_RANK) == 2) & ~F.coalesce(F.col("__known") == F.col(BRONZE_VERSION), F.lit(False))
    end = F.when(is_feed, _end_date(tie_break)).when(closes, F.col("__close")).otherwise(F.col(END_DATE))
    active = F.when(is_feed, F.col("__next").isNull()).when(closes, F.lit(False)).otherwise(F.col(IS_ACTIVE))
    return (
        timeline.where(~is_feed | new_row)
        .withColumns({"__end": end, "__active": active})
        .select(
            *[
                F.col("__end").alias(c) if c == END_DATE else F.col("__active").alias(c) if c == IS_ACTIVE else F.col(c)
                for c in columns
            ]
        )
    )


def has_history_columns(df: DataFrame) -> bool:
    """All four history columns are present; some of them are not enough."""
    return set(HISTORY_COLUMNS) <= set(df.columns)


def standardize_history(df: DataFrame, version: int, as_of: str | datetime | Column | None = None) -> DataFrame:
    """Give an initial load its history columns; a frame that has all four stays as it is."""
    if has_history_columns(df):
        return df
    return df.withColumns(
        {
            START_DATE: instant(as_of),
            END_DATE: F.lit(None).cast("timestamp"),
            IS_ACTIVE: F.lit(True),
            BRONZE_VERSION: F.lit(version).cast("long"),
        }
    )


def snapshot_changes(
    before: DataFrame,
    after: DataFrame,
    keys: Sequence[str],
    version: int,
    timestamp: str | datetime | Column,
) -> DataFrame:
    """Change feed that leads from one keyed snapshot to the next.

    Each snapshot has one row per key, where equal nulls are one key; a key that repeats raises when the feed runs.
    """
    columns = after.columns
    missing = {f.name: F.lit(None).cast(f.dataType) for f in after.schema.fields if f.name not in before.columns}
    key_names = [f"__key_{i}" for i in range(len(keys))]
    wide = {f.name: f.dataType for f in after.schema.fields}

    def packed(df: DataFrame, side: str) -> DataFrame:
        row = F.struct(*[F.col(f"`{c}`").cast(wide[c]).alias(c) for c in columns])
        return df.select(
            *[F.col(k).cast(wide[k]).alias(n) for k, n in zip(keys, key_names)],
            (row if side == "b" else F.lit(None).cast(T.StructType(after.schema.fields))).alias("b"),
            (row if side == "a" else F.lit(None).cast(T.StructType(after.schema.fields))).alias("a"),
        )

    both = packed(before.withColumns(missing) if missing else before, "b").unionByName(packed(after, "a"))
    met = both.groupBy(*key_names).agg(
        F.first("b", ignorenulls=True).alias("b"),
        F.first("a", ignorenulls=True).alias("a"),
        F.greatest(F.count("b"), F.count("a")).alias("most"),
    )
    gone, fresh = F.col("a").isNull(), F.col("b").isNull()

    def event(kind: str, row: str) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.col(row).alias("row"))

    repeated = F.raise_error(F.lit(f"a snapshot has several rows of one key of {list(keys)}"))
    events = (
        F.when(F.col("most") > 1, repeated.cast(T.ArrayType(_event_type(after))))
        .when(fresh, F.array(event(INSERT, "a")))
        .when(gone, F.array(event(DELETE, "b")))
        .when(~F.col("a").eqNullSafe(F.col("b")), F.array(event(UPDATE_PREIMAGE, "b"), event(UPDATE_POSTIMAGE, "a")))
    )
    return (
        met.select(F.explode(events).alias("e"))
        .select(
            *[F.col(f"e.row.`{c}`").alias(c) for c in columns],
            F.col("e.kind").alias(CHANGE_TYPE),
            F.lit(version).cast("long").alias(COMMIT_VERSION),
            instant(timestamp).alias(COMMIT_TIMESTAMP),
        )
    )


def _event_type(rows: DataFrame) -> T.StructType:
    return T.StructType([T.StructField("kind", T.StringType()), T.StructField("row", T.StructType(rows.schema.fields))])


def state_as_of(
    feed: DataFrame,
    keys: Sequence[str],
    version: int | None = None,
    timestamp: str | datetime | None = None,
) -> DataFrame:
    """Table state replayed from its feed up to a version or a timestamp, both inclusive."""
    if (version is None) == (timestamp is None):
        raise ValueError("give exactly one of version and timestamp")
    bound = (
        F.col(COMMIT_VERSION) <= version if version is not None else F.col(COMMIT_TIMESTAMP) <= instant(timestamp)
    )
    newest = [F.col(COMMIT_VERSION).desc(), F.col(COMMIT_TIMESTAMP).desc(), _rank().desc()]
    latest = top_row(feed.where(bound & (F.col(CHANGE_TYPE) != UPDATE_PREIMAGE)), keys, newest)
    return latest.where(F.col(CHANGE_TYPE) != DELETE).drop(*FEED_COLUMNS)


def valid_at(history: DataFrame, at: str | datetime | Column) -> DataFrame:
    """History rows in force at an instant; a row's end is exclusive."""
    t = instant(at)
    return history.where((F.col(START_DATE) <= t) & (F.col(END_DATE).isNull() | (F.col(END_DATE) > t)))


def current_rows(history: DataFrame) -> DataFrame:
    return history.where(F.col(IS_ACTIVE))
