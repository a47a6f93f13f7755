"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecraft.llm import (
    decontamination,
    edit_counts,
    filter_audit,
    html_text,
    license_scan,
    ngram_join,
    packing,
    quality_rules,
    sharding,
    token_alignment,
    token_files,
    tool_calls,
    toxicity,
)
from workload.registry import query


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 ids, placed by sums of squares."""
    return packing.pack(_table(spark, sf_dir, "documents"))


@query()
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base statistics of all documents and the verdict of the robust distance per language and source."""
    return quality_rules.judge(_table(spark, sf_dir, "documents"))


@query()
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents, learned from the labels that are not held out."""
    scored = toxicity.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scored.select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
        "toxic_tokens",
        F.size("spans").alias("n_spans"),
    )


@query()
def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose sets of three words have a similarity of 0.9 or more, as components."""
    return ngram_join.ngram_join(_table(spark, sf_dir, "documents"), size=3, over=90, under=100)


@query()
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item, replaced words allowed, and where it lies."""
    return decontamination.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@query()
def op4_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns as calls, the user turns after them as results: linked, ordered, checked, canonical."""
    calls, results = tool_calls.from_turns(_table(spark, sf_dir, "conversations"))
    return tool_calls.link(calls, results, tool_calls.TURN_SCHEMAS)


@query()
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents before and after three edits each, from their segment trees."""
    state = edit_counts.trees(_table(spark, sf_dir, "documents"))
    edited = edit_counts.apply_edits(state, edit_counts.sample_edits(F.col("text")))
    return edited.select(
        "doc_id",
        "n_before",
        "n_tokens",
        "n_pretokens",
        "n_encoded",
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
    )


@query()
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes, with a place in their shard."""
    placed = sharding.slots(sharding.partition(_table(spark, sf_dir, "documents")))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query()
def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_text.extract(_table(spark, sf_dir, "pages"))


@query()
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in all documents: template, coverage and span."""
    return license_scan.license_matches(_table(spark, sf_dir, "documents"))


@query()
def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of all documents, written in compressed blocks in the order of their ids and read back."""
    return token_files.write_and_read(_table(spark, sf_dir, "documents"))


@query(filter_audit.AUDIT_SQL)
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters in all orders: what each step removes, per source."""
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@query()
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links between the tokens of two vocabularies, for all documents."""
    documents, _ = token_alignment.align(_table(spark, sf_dir, "documents"))
    return documents.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
