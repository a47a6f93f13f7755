"""Timestamps as arguments and as text."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def instant(value: str | datetime | Column | None) -> Column:
    """A timestamp column from text, a datetime or a column; the current time when ``None``."""
    if value is None:
        return F.current_timestamp()
    if isinstance(value, Column):
        return value
    return F.lit(value).cast("timestamp")


def iso8601_utc(ts: Column) -> Column:
    """``2025-07-29T17:00:00.000+00:00``; the session time zone must be UTC."""
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("+00:00"))
