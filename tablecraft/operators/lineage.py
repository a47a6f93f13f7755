"""Upstream, downstream and the notebooks behind table lineage.

An edge is a row with ``source_table_full_name``, ``target_table_full_name``,
``entity_metadata`` (JSON text) and ``event_time``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Edge columns, metadata layout, size of a recent-lineage report.
SOURCE = "source_table_full_name"
TARGET = "target_table_full_name"
METADATA_SCHEMA = "notebook_id string, job_info struct<job_id string>"
RECENT_EVENTS = 100


def lineage_pairs(edges: DataFrame) -> DataFrame:
    """``table_name, direction, related_table`` for all tables, without self-edges.

    One row per related table rather than one array per table: a hub related to
    very many tables stays spread over tasks.
    """
    linked = edges.where(F.col(SOURCE) != F.col(TARGET)).select(SOURCE, TARGET).distinct()
    both = F.array(
        F.struct(F.col(SOURCE).alias("table_name"), F.lit("downstream").alias("direction"), F.col(TARGET).alias("related_table")),
        F.struct(F.col(TARGET).alias("table_name"), F.lit("upstream").alias("direction"), F.col(SOURCE).alias("related_table")),
    )
    return linked.select(F.explode(both).alias("p")).select("p.*")


def recent_edges(edges: DataFrame, table: str, limit: int = RECENT_EVENTS, tie_break: Column | None = None) -> DataFrame:
    """The newest lineage events that touch a table."""
    touches = (F.col(SOURCE) == table) | (F.col(TARGET) == table)
    order = [F.col("event_time").desc()] + ([tie_break] if tie_break is not None else [])
    return edges.where(touches).orderBy(*order).limit(limit)


def table_lineage(edges: DataFrame, table: str, limit: int | None = None, tie_break: Column | None = None) -> DataFrame:
    """One row with the sorted upstream and downstream tables of a table, over all its events or its newest ``limit``."""
    touches = (F.col(SOURCE) == table) | (F.col(TARGET) == table)
    recent = edges.where(touches) if limit is None else recent_edges(edges, table, limit, tie_break)
    other = F.col(SOURCE) != F.col(TARGET)
    up = F.when(other & (F.col(TARGET) == table), F.col(SOURCE))
    down = F.when(other & (F.col(SOURCE) == table), F.col(TARGET))
    return recent.agg(
        F.sort_array(F.collect_set(up)).alias("upstream_tables"),
        F.sort_array(F.collect_set(down)).alias("downstream_tables"),
    ).select(F.lit(table).alias("table_name"), "upstream_tables", "downstream_tables")


def lineage_entities(edges: DataFrame, jobs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Notebooks that read or write each table, with job and task names.

    ``jobs`` has ``job_id, job_name``; ``tasks`` has ``job_id, notebook_id,
    notebook_path, task_key``. Edges without notebook or job, or with broken
    metadata, count for nothing. Unknown names fall back to the identifiers.
    """
    # Runs repeat the same edge: group first, parse each distinct metadata once.
    # The count inside the parsed text keeps the parsing above the grouping.
    grouped = edges.groupBy(SOURCE, TARGET, "entity_metadata").agg(F.count(F.lit(1)).alias("n"))
    metadata = F.from_json(F.when(F.col("n") > 0, F.col("entity_metadata")), METADATA_SCHEMA)
    parsed = grouped.select(SOURCE, TARGET, metadata.alias("m")).select(
        SOURCE, TARGET, F.col("m.notebook_id").alias("notebook_id"), F.col("m.job_info.job_id").alias("job_id")
    )
    used = parsed.where((F.col("notebook_id") != "") & (F.col("job_id") != ""))
    reading = F.when(
        F.col(SOURCE).isNotNull(), F.struct(F.col(SOURCE).alias("table_name"), F.lit("reads").alias("role"))
    )
    writing = F.when(
        F.col(TARGET).isNotNull() & ~F.col(SOURCE).eqNullSafe(F.col(TARGET)),
        F.struct(F.col(TARGET).alias("table_name"), F.lit("writes").alias("role")),
    )
    uses = (
        used.select("notebook_id", "job_id", F.explode(F.array_compact(F.array(reading, writing))).alias("u"))
        .select("u.*", "notebook_id", "job_id")
        .distinct()
    )
    # What is left has the size of the catalog, not of its history of runs.
    named = uses.join(jobs.select("job_id", "job_name"), "job_id", "left")
    placed = named.join(
        tasks.select("job_id", "notebook_id", "notebook_path", "task_key"), ["job_id", "notebook_id"], "left"
    )
    fallback = F.concat(F.lit("notebook_id:"), F.col("notebook_id"))
    return placed.select(
        "table_name",
        "role",
        "notebook_id",
        F.coalesce(F.element_at(F.split("notebook_path", "/"), -1), fallback).alias("notebook_name"),
        F.coalesce("notebook_path", fallback).alias("notebook_path"),
        "job_id",
        F.coalesce("job_name", F.concat(F.lit("Job "), F.col("job_id"))).alias("job_name"),
        "task_key",
    )
