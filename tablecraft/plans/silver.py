"""Bronze-to-silver jobs: cleansing, history and quality gate."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame

from tablecraft.operators.cdc import merge_history, standardize_history
from tablecraft.operators.columns import (
    clean,
    filter_deleted,
    load_columns,
    normalize_column_values,
    rename_columns,
    select_columns,
    standardize_date_columns,
)
from tablecraft.operators.quality import Check, gate, validate_config


def cleanse_table(df: DataFrame, options: Mapping[str, Any], extra_columns: Sequence[str] = ()) -> DataFrame:
    """Drop deleted rows, clean, rename, standardize dates, select, normalise: one projection over one scan."""
    df = clean(filter_deleted(df))
    df = rename_columns(df, options.get("rename_columns"))
    df = standardize_date_columns(df, options.get("standardize_date_columns"))
    wanted = [c for c in options.get("select_columns") or [] if c is not None]
    df = select_columns(df, [*wanted, *extra_columns] if wanted else [])
    values = [c for c in options.get("normalize_column_values") or [] if c is not None]
    return normalize_column_values(df, values)


def cleanse(
    config: Mapping[str, Mapping[str, Any]], *, bulk_load: bool = False, history: bool = False
) -> dict[str, dict[str, Any]]:
    """Copy of the config with every ``dataframe`` cleansed by its own options."""
    extra = load_columns(bulk_load=bulk_load, history=history)
    return {
        alias: {**entry, "dataframe": cleanse_table(entry["dataframe"], entry, extra)}
        for alias, entry in config.items()
    }


def silver_table(
    df: DataFrame,
    options: Mapping[str, Any],
    checks: Iterable[Check] = (),
    write_quarantine: Callable[[DataFrame], None] | None = None,
) -> DataFrame:
    """Cleanse one table, check its columns against the options and its rows against the checks."""
    result = cleanse_table(df, options)
    validate_config(result, {"table": options})
    checks = list(checks)
    if not checks:
        return result
    return gate(result, checks, write_quarantine or (lambda _: None), options.get("table_name", "table"))


def refresh_history(
    feed: DataFrame | None,
    target: DataFrame | None,
    keys: Sequence[str],
    *,
    initial: DataFrame | None = None,
    initial_version: int = 0,
    as_of: Any = None,
) -> DataFrame:
    """History after a load: the initial rows when there is no target yet, else the feed applied to it."""
    if target is None:
        if initial is None:
            raise ValueError("the first load needs the initial rows")
        return standardize_history(initial, initial_version, as_of)
    return target if feed is None else merge_history(feed, target, keys)
