"""Parameterised SQL and text rendering of results."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tablecraft.functions.text import render_row


def run_sql(spark: SparkSession, query: str, parameters: Mapping[str, Any] | None = None) -> DataFrame:
    """Run a query with ``:name`` parameters bound as values, never spliced as text."""
    return spark.sql(query, args=dict(parameters or {}))


def render_rows(df: DataFrame) -> DataFrame:
    """Each row as one ``line`` of text."""
    return df.select(render_row(df).alias("line"))
