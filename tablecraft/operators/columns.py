"""Cleansing, renaming, ordering and filtering of columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecraft.functions.change import BRONZE_VERSION, END_DATE, FEED_COLUMNS, IS_ACTIVE, START_DATE
from tablecraft.functions.time import instant

# Connector columns, and the pattern replaced in normalised values.
DELETED_FLAG = "_fivetran_deleted"
CONNECTOR_COLUMNS = ("_fivetran_deleted", "_fivetran_synced")
NON_ALPHANUMERIC = "[^a-zA-Z0-9]"
NON_LETTER = "[^A-Za-z]"

Renames = Sequence[Mapping[str, str]]


def _is_string(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.StringType)


def _replace(df: DataFrame, new: Mapping[str, Column]) -> DataFrame:
    return df.withColumns(dict(new)) if new else df


def clean(df: DataFrame) -> DataFrame:
    """Trim spaces off every string column and turn empty strings into nulls."""
    return _replace(
        df, {c: F.nullif(F.trim(F.col(c)), F.lit("")) for c in df.columns if _is_string(df, c)}
    )


def filter_deleted(df: DataFrame) -> DataFrame:
    """Keep rows whose deletion flag is false (not null) and drop the flag."""
    if DELETED_FLAG not in df.columns:
        return df
    return df.where(F.col(DELETED_FLAG) == "false").drop(DELETED_FLAG)


def normalize_column_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Trim, lower-case and replace each non-alphanumeric character by ``_`` in string columns."""
    return _replace(
        df,
        {
            c: F.regexp_replace(F.trim(F.lower(F.col(c))), NON_ALPHANUMERIC, "_")
            for c in columns
            if _is_string(df, c)
        },
    )


def standardize_date_columns(df: DataFrame, columns: Renames | None) -> DataFrame:
    """Rename timestamps to ``<new>_timestamp`` and add ``<new>_date``."""
    pairs = [(c["original_name"], c["new_name"]) for c in columns or () if c]
    for original, new in pairs:
        if not isinstance(df.schema[original].dataType, (T.TimestampType, T.TimestampNTZType)):
            raise ValueError(f"column {original} must be a timestamp to be standardized")
        if new == "created" and original != "created_timestamp":
            df = df.drop("created_timestamp")
    if not pairs:
        return df
    renamed = df.withColumnsRenamed({original: f"{new}_timestamp" for original, new in pairs})
    return renamed.withColumns({f"{new}_date": F.col(f"{new}_timestamp").cast("date") for _, new in pairs})


def uppercase_alpha_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Upper-case values made of ASCII letters only; every other value becomes null."""

    def letters(c: str) -> Column:
        return F.when(F.regexp_replace(F.col(c), NON_LETTER, "") == F.col(c), F.upper(F.col(c)))

    return _replace(df, {c: letters(c) for c in columns})


def order_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Named columns first, the rest by name, connector columns last; each once."""
    first = [c for c in dict.fromkeys(columns) if c in df.columns]
    last = [c for c in df.columns if c in CONNECTOR_COLUMNS and c not in first]
    middle = sorted(c for c in df.columns if c not in {*first, *last})
    return df.select(*first, *middle, *last)


def select_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The named columns that exist; all of them for an empty list."""
    return df.select(*[c for c in columns if c in df.columns]) if columns else df


def rename_columns(df: DataFrame, columns: Renames | None) -> DataFrame:
    """Rename one after the other, so a later pair sees an earlier new name."""
    for c in columns or ():
        if c:
            df = df.withColumnRenamed(c["original_name"], c["new_name"])
    return df


def snake_case_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.replace(" ", "_").lower() for c in df.columns])


def lower_case_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def has_to_bool(df: DataFrame, columns: Sequence[tuple[str, str]]) -> DataFrame:
    """Whether a column contains a text, ignoring case; null gives false."""
    return _replace(
        df,
        {
            c: F.coalesce(F.upper(F.col(c)).contains(text.upper()), F.lit(False))
            for c, text in columns
        },
    )


def load_columns(*, bulk_load: bool = False, history: bool = False) -> list[str]:
    """Extra columns a kind of load carries through the cleansing."""
    if not history:
        return [BRONZE_VERSION]
    if bulk_load:
        return [BRONZE_VERSION, IS_ACTIVE, START_DATE, END_DATE]
    return list(FEED_COLUMNS)


def recent_rows(
    df: DataFrame,
    timestamp: str,
    as_of: str | datetime | Column | None = None,
    within: timedelta = timedelta(minutes=10),
) -> DataFrame:
    """Rows not older than ``within`` before ``as_of``."""
    return df.where(F.col(timestamp) >= instant(as_of) - F.lit(within))


def with_values(df: DataFrame, column: str, values: Sequence, *, negate: bool = False) -> DataFrame:
    """Rows whose column is (or is not) one of the values."""
    hit = F.col(column).isin(list(values))
    return df.where(~hit if negate else hit)


def _rounded(c: Column, digits: int, scale: int) -> Column:
    return F.round(c.cast("decimal(38,10)"), digits).cast(f"decimal(38,{scale})")


def whole(c: Column) -> Column:
    """Aggregates: nearest whole number, shown with two decimals."""
    return _rounded(c, 0, 2)


def money(c: Column) -> Column:
    """Financial values: two decimals."""
    return _rounded(c, 2, 2)


def ratio(c: Column) -> Column:
    """Ratios and percentages: four decimals."""
    return _rounded(c, 4, 4)
