"""Gold metrics with the rounding standard."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecraft.operators.columns import money, whole


def metrics(df: DataFrame, by: Sequence[str], amount: Column, *, prefix: str = "amount") -> DataFrame:
    """Row count, total and average of an amount per group.

    Totals are financial values, averages aggregates. The amount is summed as a
    decimal, so the result does not depend on the order of the rows.
    """
    exact = amount.cast("decimal(18,4)")
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("row_count"),
        money(F.sum(exact)).alias(f"total_{prefix}"),
        whole(F.avg(exact)).alias(f"avg_{prefix}"),
    )
