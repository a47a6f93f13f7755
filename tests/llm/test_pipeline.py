from __future__ import annotations

import pytest

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries

SF_DIR = "/root/testdata/sf0.001"


def test_all_operators_are_registered():
    names = list(queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert "pipeline" not in oracle_sql()


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.keep(stage(spark, docs, SF_DIR), "test-stage")
        out.append(docs)
    return out


def test_each_stage_only_takes_away(stages):
    for before, after in zip(stages[:-2], stages[1:-1], strict=True):
        assert after.columns == before.columns
        assert after.exceptAll(before).count() == 0
        assert 0.5 * before.count() <= after.count() <= before.count()


def test_all_kept_documents_are_packed(stages):
    kept = {r.doc_id for r in stages[-2].collect()}
    assert {r.doc_id for r in stages[-1].collect()} == kept


def test_run_equals_its_stages(spark, stages):
    rows = corpus_pipeline.run(spark, SF_DIR).select("doc_id", "piece", "ids_crc32").collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, stages[-1].select("doc_id", "piece", "ids_crc32").collect()))


def test_odd_documents_pass_all_stages(spark, odd_docs, no_docs):
    for start in (odd_docs, no_docs):
        docs = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF_DIR)
            assert docs.columns == start.columns
        corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).count()
