"""Change-feed vocabulary and null-safe change predicates."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Change-feed columns, change types, history and audit columns.
CHANGE_TYPE = "_change_type"
COMMIT_VERSION = "_commit_version"
COMMIT_TIMESTAMP = "_commit_timestamp"
FEED_COLUMNS = (CHANGE_TYPE, COMMIT_VERSION, COMMIT_TIMESTAMP)

INSERT = "insert"
UPDATE_PREIMAGE = "update_preimage"
UPDATE_POSTIMAGE = "update_postimage"
DELETE = "delete"

START_DATE = "effective_start_date"
END_DATE = "effective_end_date"
IS_ACTIVE = "is_active_record"
BRONZE_VERSION = "bronze_commit_version"
HISTORY_COLUMNS = (START_DATE, END_DATE, IS_ACTIVE, BRONZE_VERSION)

CREATED = "created_date"
MODIFIED = "last_modified_date"
AUDIT_COLUMNS = (CREATED, MODIFIED)
BACKFILL_TIMESTAMP = "1900-01-01 00:00:00"


def all_of(terms: Iterable[Column]) -> Column:
    terms = list(terms)
    return reduce(lambda a, b: a & b, terms) if terms else F.lit(True)


def any_of(terms: Iterable[Column]) -> Column:
    terms = list(terms)
    return reduce(lambda a, b: a | b, terms) if terms else F.lit(False)


def differs(columns: Sequence[str]) -> Column:
    """True when any column differs between ``target`` and ``source``, nulls being equal."""
    return any_of(~F.col(f"target.`{c}`").eqNullSafe(F.col(f"source.`{c}`")) for c in columns)


def differs_ignoring_nulls(columns: Sequence[str]) -> Column:
    """Like :func:`differs`, but a null on the source side is no change."""
    return any_of(
        F.col(f"source.`{c}`").isNotNull() & ~F.col(f"target.`{c}`").eqNullSafe(F.col(f"source.`{c}`"))
        for c in columns
    )


def update_trigger(
    source_columns: Sequence[str],
    join_fields: Sequence[str],
    columns_to_ignore: Sequence[str] | None = None,
    ignore_null_updates: bool = False,
) -> Column:
    """Whether a matched row needs an update; false when nothing is left to compare."""
    skipped = {*join_fields, *(columns_to_ignore or ())}
    compared = [c for c in source_columns if c not in skipped]
    return (differs_ignoring_nulls if ignore_null_updates else differs)(compared)
