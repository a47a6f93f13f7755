"""Agreement between two labellings and label tallies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion(df: DataFrame, expert: str, model: str, by: Sequence[str] = (), *, nulls: str = "error") -> DataFrame:
    """Counts ``tp, tn, fp, fn`` of two 0/1 columns, per group when ``by`` is given.

    Both labels sit in one row, so unequal lengths show up as nulls: they raise,
    or are left out with ``nulls="drop"``. Any other value raises.
    """
    if nulls not in ("error", "drop"):
        raise ValueError("nulls must be 'error' or 'drop'")
    if nulls == "drop":
        df = df.where(F.col(expert).isNotNull() & F.col(model).isNotNull())

    def checked(name: str) -> Column:
        good = F.coalesce(F.col(name).isin(0, 1), F.lit(False))
        return F.when(good, F.col(name) == 1).otherwise(F.raise_error(F.lit(f"{name} must be 0 or 1")))

    pairs = df.select(*by, checked(expert).alias("e"), checked(model).alias("m"))
    e, m = F.col("e"), F.col("m")
    return pairs.groupBy(*by).agg(
        F.count_if(e & m).alias("tp"),
        F.count_if(~e & ~m).alias("tn"),
        F.count_if(~e & m).alias("fp"),
        F.count_if(e & ~m).alias("fn"),
    )


def agreement_scores(df: DataFrame, expert: str, model: str, by: Sequence[str] = (), *, nulls: str = "error") -> DataFrame:
    """Accuracy, F1, Cohen's kappa and Matthews correlation from one pass of counts.

    Undefined values: accuracy, F1 and Matthews are 0, kappa is NaN.
    """
    counts = confusion(df, expert, model, by, nulls=nulls)
    tp, tn, fp, fn = (F.col(c).cast("double") for c in ("tp", "tn", "fp", "fn"))
    n = tp + tn + fp + fn

    def divided(a: Column, b: Column, otherwise: float) -> Column:
        return F.when(b != 0, a / b).otherwise(F.lit(otherwise))

    chance = (tp + fn) * (tn + fn) + (tn + fp) * (tp + fp)
    spread = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    return counts.withColumns(
        {
            "accuracy": divided(tp + tn, n, 0.0),
            "f1": divided(2 * tp, 2 * tp + fp + fn, 0.0),
            "kappa": F.when(chance != 0, 1 - (fp + fn) * n / chance).otherwise(F.lit(float("nan"))),
            "matthews": divided(tp * tn - fp * fn, spread, 0.0),
        }
    )


def has_feedback(value: Column) -> Column:
    """Whether a feedback value is a yes or a no; null without feedback."""
    return value.isin("yes", "no")


def label_tally(df: DataFrame, value: Column) -> DataFrame:
    """Rows per value, null being a value."""
    return df.groupBy(value.alias("label")).agg(F.count(F.lit(1)).alias("n"))
