"""Data-quality checks, quarantine and gates.

Row checks turn into one boolean expression each. A check passes on null unless
its purpose is to forbid nulls; an expression has to be true, so null fails it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tablecraft.functions.change import any_of
from tablecraft.operators.skew import skew_join

ERRORS = "_errors"
WARNINGS = "_warnings"


@dataclass(frozen=True)
class Check:
    function: str
    arguments: Mapping[str, Any] = field(default_factory=dict)
    name: str = ""
    criticality: str = "error"

    def __post_init__(self) -> None:
        if self.criticality not in ("error", "warn"):
            raise ValueError(f"criticality must be error or warn, not {self.criticality!r}")
        if not self.name:
            column = self.arguments.get("column") or "_".join(self.arguments.get("columns", ()))
            object.__setattr__(self, "name", f"{column}_{self.function}".strip("_"))

    @classmethod
    def from_config(cls, entry: Mapping[str, Any]) -> "Check":
        body = entry.get("check", entry)
        return cls(
            function=body["function"],
            arguments=body.get("arguments", {}),
            name=entry.get("name", ""),
            criticality=entry.get("criticality", "error"),
        )


def _not_empty(column: str, trim_strings: bool = False) -> Column:
    c = F.col(column).cast("string")
    return F.col(column).isNotNull() & ((F.trim(c) if trim_strings else c) != "")


def _in_range(column: str, min: Any = None, max: Any = None) -> Column:
    c = F.col(column)
    ok = F.lit(True)
    if min is not None:
        ok = ok & (c >= F.lit(min))
    if max is not None:
        ok = ok & (c <= F.lit(max))
    return c.isNull() | ok


def _in_list(column: str, allowed: Sequence[Any]) -> Column:
    values = [v for v in allowed if v is not None]
    return F.col(column).isNull() | (F.col(column).isin(values) if values else F.lit(False))


ROW_CHECKS: dict[str, Callable[..., Column]] = {
    "is_not_null_and_not_empty": _not_empty,
    "not_null": lambda column: F.col(column).isNotNull(),
    "is_in_list": _in_list,
    "is_in_range": _in_range,
    "expression_true_for_all": lambda expression: F.coalesce(F.expr(expression), F.lit(False)),
}
UNIQUE = "unique_combination_of_columns"
DATASET_CHECKS = ("row_count_between", "expect_schema")


def _evaluate(df: DataFrame, checks: Iterable[Check]) -> tuple[DataFrame, list[tuple[Check, Column]], list[str]]:
    """The rows with helper columns, whether each check fails on a row, and the helpers' names.

    Uniqueness needs the number of rows per key; only repeated keys are counted
    out and joined back, with large keys spread over tasks.
    """
    failed, helpers = [], []
    for i, check in enumerate(c for c in checks if c.function not in DATASET_CHECKS):
        if check.function == UNIQUE:
            keys, repeated = list(check.arguments["columns"]), f"__repeated_{i}"
            counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
            df = skew_join(df, counted.select(*keys, F.lit(True).alias(repeated)), keys, null_safe=True)
            helpers.append(repeated)
            failed.append((check, F.col(repeated).isNotNull()))
        elif check.function in ROW_CHECKS:
            # Never null: a row is in exactly one of the frames that a split makes.
            failed.append((check, ~F.coalesce(ROW_CHECKS[check.function](**check.arguments), F.lit(False))))
        else:
            raise ValueError(f"unknown check function: {check.function}")
    return df, failed, helpers


def _named(rows: DataFrame, failed: Sequence[tuple[Check, Column]]) -> DataFrame:
    def names(criticality: str) -> Column:
        found = [F.when(bad, F.lit(c.name)) for c, bad in failed if c.criticality == criticality]
        return (F.array_compact(F.array(*found)) if found else F.array()).cast("array<string>")

    return rows.withColumns({ERRORS: names("error"), WARNINGS: names("warn")})


def annotate(df: DataFrame, checks: Iterable[Check]) -> DataFrame:
    """Add ``_errors`` and ``_warnings``: the names of the checks a row fails."""
    rows, failed, helpers = _evaluate(df, checks)
    return _named(rows, failed).drop(*helpers)


def split(df: DataFrame, checks: Iterable[Check]) -> tuple[DataFrame, DataFrame]:
    """Valid rows (no error) and quarantined rows (any failed check, with the reasons)."""
    rows, failed, helpers = _evaluate(df, checks)
    valid = rows.where(~any_of(bad for c, bad in failed if c.criticality == "error"))
    quarantine = _named(rows.where(any_of(bad for _, bad in failed)), failed)
    return valid.drop(*helpers), quarantine.drop(*helpers)


def violations(df: DataFrame, checks: Iterable[Check]) -> DataFrame:
    """Failures per check and criticality, counted in one aggregation; checks without a failure are left out."""
    rows, failed, _ = _evaluate(df, checks)
    if not failed:
        raise ValueError("no row checks given")
    counts = rows.agg(*[F.count_if(bad).alias(f"n{i}") for i, (_, bad) in enumerate(failed)])
    entries = [
        F.struct(
            F.lit(c.name).alias("check"), F.lit(c.criticality).alias("criticality"), F.col(f"n{i}").alias("failures")
        )
        for i, (c, _) in enumerate(failed)
    ]
    return counts.select(F.explode(F.array(*entries)).alias("v")).select("v.*").where(F.col("failures") > 0)


def row_count_check(df: DataFrame, min: int, max: int, name: str = "row_count_between") -> DataFrame:
    """One row: the count and whether it lies within the bounds."""
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(name).alias("check"), "row_count", F.col("row_count").between(min, max).alias("passed")
    )


def schema_problems(df: DataFrame, columns: Mapping[str, str]) -> list[str]:
    """Expected columns that are missing or of another type."""
    names = {"long": "bigint", "integer": "int", "short": "smallint", "byte": "tinyint"}
    found = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    problems = []
    for column, expected in columns.items():
        wanted = names.get(expected, expected)
        if column not in found:
            problems.append(f"{column} is missing")
        elif found[column] != wanted:
            problems.append(f"{column} is {found[column]}, expected {expected}")
    return problems


def _dataset_failures(df: DataFrame, checks: Iterable[Check]) -> list[str]:
    failures = []
    for check in checks:
        if check.function == "expect_schema":
            failures += [f"{check.name}: {p}" for p in schema_problems(df, check.arguments["columns"])]
        elif check.function == "row_count_between":
            row = row_count_check(df, **check.arguments).first()
            if not row["passed"]:
                failures.append(f"{check.name}: {row['row_count']} rows")
    return failures


def gate(
    df: DataFrame,
    checks: Iterable[Check],
    write_quarantine: Callable[[DataFrame], None],
    name: str = "table",
) -> DataFrame:
    """The valid rows; raises ``ValueError`` after writing the quarantine when a check fails.

    Failed warnings count as well. A failed check on the whole table raises first.
    """
    checks = list(checks)
    problems = _dataset_failures(df, [c for c in checks if c.function in DATASET_CHECKS])
    if problems:
        raise ValueError(f"{name}: {'; '.join(problems)}")
    valid, quarantine = split(df, checks)
    n = quarantine.count()
    if n:
        write_quarantine(quarantine)
        raise ValueError(f"{name}: {n} rows quarantined")
    return valid


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """Count rows as they pass, without a job of its own: ``observation.get["rows"]``."""
    observation = Observation(name)
    return df.observe(observation, F.count(F.lit(1)).alias("rows")), observation


# -- checks of a transformation's configuration -------------------------------


def _entries(config: Mapping[str, Mapping[str, Any]], option: str) -> list:
    lists = [table.get(option) or [] for table in config.values()]
    return [e for e in reduce(lambda a, b: a + list(b), lists, []) if e is not None]


def validate_config(df: DataFrame, config: Mapping[str, Mapping[str, Any]]) -> None:
    """Raise ``ValueError`` naming configured columns the frame lacks."""
    present = set(df.columns)
    expected = {
        "renamed": [e["new_name"] for e in _entries(config, "rename_columns")],
        "standardized date": [
            f"{e['new_name']}_{suffix}"
            for e in _entries(config, "standardize_date_columns")
            for suffix in ("date", "timestamp")
        ],
        "required": _entries(config, "select_columns"),
    }
    for kind, names in expected.items():
        missing = [n for n in names if n not in present]
        if missing:
            raise ValueError(f"missing {kind} columns: {missing}")
