"""Data quality, agreement scores, lineage and versions."""

from __future__ import annotations

import math
from datetime import datetime
from pathlib import Path

import pytest
from helpers import rows
from pyspark.sql import functions as F

from tablecraft.operators import agreement as A
from tablecraft.operators import lineage as L
from tablecraft.operators import quality as Q
from tablecraft.operators import versions as V

CHECKS = [
    Q.Check("not_null", {"column": "id"}, "id_present"),
    Q.Check("is_not_null_and_not_empty", {"column": "name", "trim_strings": True}, "name_present", "warn"),
    Q.Check("is_in_list", {"column": "status", "allowed": ["a", "b"]}, "status_known"),
    Q.Check("expression_true_for_all", {"expression": "lo <= hi"}, "ordered"),
    Q.Check("unique_combination_of_columns", {"columns": ["id"]}, "id_unique"),
    Q.Check("is_in_range", {"column": "lo", "min": 0}, "lo_range"),
]


@pytest.fixture
def people(spark):
    return spark.createDataFrame(
        [
            (1, "n", "a", 1, 2),
            (2, " ", "b", 1, 2),
            (None, "n", "a", 1, 2),
            (3, "n", "x", 5, 2),
            (3, "n", None, -1, None),
            (4, None, "a", 1, 1),
        ],
        "id int, name string, status string, lo int, hi int",
    )


def test_annotate_names_the_failed_checks(people, group_size):
    found = rows(Q.annotate(people, CHECKS), "id", "lo", "_errors", "_warnings")
    assert found == [
        (None, 1, ["id_present"], []),
        (1, 1, [], []),
        (2, 1, [], ["name_present"]),
        (3, -1, ["ordered", "id_unique", "lo_range"], []),
        (3, 5, ["status_known", "ordered", "id_unique"], []),
        (4, 1, [], ["name_present"]),
    ]


def test_valid_and_quarantine_cover_the_input(people):
    valid, quarantine = Q.split(people, CHECKS)
    assert valid.columns == people.columns
    assert rows(valid, "id") == [(1,), (2,), (4,)]
    assert rows(quarantine, "id") == [(None,), (2,), (3,), (3,), (4,)]
    covered = valid.unionByName(quarantine.drop("_errors", "_warnings")).distinct()
    assert rows(covered) == rows(people)


def test_violations(people):
    assert rows(Q.violations(people, CHECKS)) == [
        ("id_present", "error", 1), ("id_unique", "error", 2), ("lo_range", "error", 1),
        ("name_present", "warn", 2), ("ordered", "error", 2), ("status_known", "error", 1),
    ]


def test_gate(people):
    written = []
    with pytest.raises(ValueError, match="5 rows quarantined"):
        Q.gate(people, CHECKS, written.append, "people")
    assert written[0].count() == 5
    clean = people.where("id = 1")
    assert Q.gate(clean, CHECKS, written.append).count() == 1 and len(written) == 1
    bounds = Q.Check("row_count_between", {"min": 5, "max": 10}, "enough")
    with pytest.raises(ValueError, match="enough: 1 rows"):
        Q.gate(clean, [bounds], written.append)
    types = Q.Check("expect_schema", {"columns": {"id": "integer", "name": "string", "lo": "long", "zz": "date"}}, "types")
    with pytest.raises(ValueError, match="lo is int, expected long.*zz is missing"):
        Q.gate(clean, [types], written.append)


def test_check_configuration():
    entry = {"criticality": "warn", "check": {"function": "not_null", "arguments": {"column": "pk"}}}
    check = Q.Check.from_config(entry)
    assert (check.name, check.criticality) == ("pk_not_null", "warn")
    with pytest.raises(ValueError, match="criticality"):
        Q.Check("not_null", {"column": "a"}, criticality="fatal")


def test_unknown_check_function(people):
    with pytest.raises(ValueError, match="unknown check"):
        Q.annotate(people, [Q.Check("no_such_check", name="x")])


def test_row_count_check(people):
    assert rows(Q.row_count_check(people, 1, 5)) == [("row_count_between", 6, False)]


def test_observed_counts_without_a_job_of_its_own(people):
    df, observation = Q.observed(people, "people")
    df.collect()
    assert observation.get["rows"] == 6


def test_validate_config(people):
    Q.validate_config(people, {"t": {"rename_columns": [{"original_name": "x", "new_name": "name"}], "select_columns": ["id"]}})
    Q.validate_config(people, {"t": {"standardize_date_columns": [None], "rename_columns": None}})
    with pytest.raises(ValueError, match=r"renamed columns: \['zz'\]"):
        Q.validate_config(people, {"t": {"rename_columns": [{"original_name": "x", "new_name": "zz"}]}})
    with pytest.raises(ValueError, match="made_date.*made_timestamp"):
        Q.validate_config(people, {"t": {"standardize_date_columns": [{"original_name": "x", "new_name": "made"}]}})
    with pytest.raises(ValueError, match="required"):
        Q.validate_config(people, {"t": {"select_columns": ["zz"]}})


# -- agreement: expected scores of each pair of labellings ----------------------

PAIRS = {
    "perfect": ([1, 1, 0, 0, 1], [1, 1, 0, 0, 1], (1.0, 1.0, 1.0, 1.0)),
    "moderate": ([1, 1, 0, 0, 1, 0, 1], [1, 0, 0, 1, 1, 0, 0], (4 / 7, 4 / 7, 0.16, 1 / 6)),
    "none": ([1, 1, 1, 1], [0, 0, 0, 0], (0.0, 0.0, 0.0, 0.0)),
    "all ones": ([1, 1, 1, 1], [1, 1, 1, 1], (1.0, 1.0, math.nan, 0.0)),
    "empty": ([], [], (0.0, 0.0, math.nan, 0.0)),
    "half": ([1, 0, 1, 0], [1, 1, 1, 1], (0.5, 2 / 3, 0.0, 0.0)),
}


@pytest.mark.parametrize("name", PAIRS)
def test_agreement_scores(spark, name):
    expert, model, expected = PAIRS[name]
    df = spark.createDataFrame(list(zip(expert, model)), "e int, m int")
    row = A.agreement_scores(df, "e", "m").first()
    found = (row["accuracy"], row["f1"], row["kappa"], row["matthews"])
    assert found == pytest.approx(expected, nan_ok=True)


def test_agreement_refuses_or_drops_nulls(spark):
    df = spark.createDataFrame([(1, 1), (None, 1)], "e int, m int")
    with pytest.raises(Exception, match="must be 0 or 1"):
        A.agreement_scores(df, "e", "m").collect()
    assert A.agreement_scores(df, "e", "m", nulls="drop").first()["tp"] == 1
    with pytest.raises(ValueError):
        A.confusion(df, "e", "m", nulls="ignore")


def test_label_tally_counts_nulls(spark):
    df = spark.createDataFrame([("yes",), ("no",), ("maybe",), (None,)], "v string")
    assert rows(A.label_tally(df, A.has_feedback(F.col("v")))) == [(None, 1), (False, 1), (True, 2)]


# -- lineage ------------------------------------------------------------------


@pytest.fixture
def edges(spark):
    def meta(notebook, job):
        return f'{{"notebook_id": "{notebook}", "job_info": {{"job_id": "{job}"}}}}'

    return spark.createDataFrame(
        [
            ("a", "b", meta("n1", "j1"), datetime(2025, 1, 1)),
            ("a", "b", meta("n1", "j1"), datetime(2025, 1, 2)),
            ("b", "c", meta("n2", "j9"), datetime(2025, 1, 3)),
            ("b", "b", "broken", datetime(2025, 1, 4)),
            (None, "b", '{"notebook_id": "n3"}', datetime(2025, 1, 5)),
        ],
        f"{L.SOURCE} string, {L.TARGET} string, entity_metadata string, event_time timestamp",
    )


def test_lineage_pairs(edges):
    assert rows(L.lineage_pairs(edges)) == [
        ("a", "downstream", "b"), ("b", "downstream", "c"), ("b", "upstream", "a"), ("c", "upstream", "b"),
    ]


def test_table_lineage_looks_at_the_newest_events(edges):
    assert L.table_lineage(edges, "b").first().asDict() == {
        "table_name": "b", "upstream_tables": ["a"], "downstream_tables": ["c"],
    }
    assert L.table_lineage(edges, "b", limit=3).first()["upstream_tables"] == []


def test_lineage_entities(spark, edges):
    jobs = spark.createDataFrame([("j1", "Load")], "job_id string, job_name string")
    tasks = spark.createDataFrame(
        [("j1", "n1", "/repo/load_b", "t1")], "job_id string, notebook_id string, notebook_path string, task_key string"
    )
    assert rows(L.lineage_entities(edges, jobs, tasks)) == [
        ("a", "reads", "n1", "load_b", "/repo/load_b", "j1", "Load", "t1"),
        ("b", "reads", "n2", "notebook_id:n2", "notebook_id:n2", "j9", "Job j9", None),
        ("b", "writes", "n1", "load_b", "/repo/load_b", "j1", "Load", "t1"),
        ("c", "writes", "n2", "notebook_id:n2", "notebook_id:n2", "j9", "Job j9", None),
    ]


# -- versions -----------------------------------------------------------------


@pytest.fixture
def log(spark):
    return spark.createDataFrame(
        [
            (0, datetime(2025, 1, 1), "CREATE TABLE", {}),
            (1, datetime(2025, 1, 2), "WRITE", {"mode": "Append"}),
            (2, datetime(2025, 1, 3), "OPTIMIZE", {}),
            (3, datetime(2025, 1, 4), "VACUUM END", {}),
        ],
        "version bigint, timestamp timestamp, operation string, operationParameters map<string,string>",
    )


def test_versions(spark, log):
    empty = log.limit(0)
    assert V.scalar(V.current_commit_version(log)) == 3
    assert [r["version"] for r in V.data_history(log).collect()] == [1, 0]
    assert V.scalar(V.latest_ingestion(log)) == datetime(2025, 1, 2)
    assert V.scalar(V.closest_version(log, "2025-01-03 12:00:00")) == 2
    assert V.scalar(V.closest_version(log, "2024-01-01 00:00:00")) is None
    assert V.scalar(V.last_change_version(log)) == 1
    assert V.scalar(V.last_change_version(log.where("version > 1"))) == 3
    assert V.scalar(V.last_change_version(empty)) == 0
    table = spark.createDataFrame([(1,), (None,)], "bronze_commit_version int")
    assert V.scalar(V.max_commit_version(table)) == 1
    assert V.scalar(V.max_commit_version(table.limit(0))) == -1


def test_freshness(spark, log):
    made = spark.createDataFrame([(datetime(2025, 5, 1), datetime(2025, 6, 1))], "made_date timestamp, seen_timestamp timestamp")
    named = spark.createDataFrame([("x",)], "update_date string")
    found = V.freshness({"made": made, "named": named, "logged": made}, {"logged": log, "made": log.limit(0)})
    assert rows(found) == [("logged", datetime(2025, 1, 4)), ("made", datetime(2025, 6, 1)), ("named", None)]
    with pytest.raises(ValueError):
        V.freshness({})


def test_schema_freshness(spark):
    spark.sql("CREATE DATABASE fresh")
    try:
        spark.sql("CREATE TABLE fresh.a USING parquet AS SELECT timestamp'2025-03-01 00:00:00' AS loaded_date")
        spark.sql("CREATE TABLE fresh.gone USING parquet AS SELECT 1 AS id")
        spark.sql("CREATE VIEW fresh.broken AS SELECT * FROM fresh.gone")
        spark.sql("DROP TABLE fresh.gone")
        spark.sql("CREATE TABLE fresh.part USING parquet AS SELECT timestamp'2025-04-01 00:00:00' AS loaded_date")
        spark.sql("CREATE TABLE fresh.torn USING parquet AS SELECT timestamp'2025-04-01 00:00:00' AS loaded_date")
        for name, keep in (("part", True), ("torn", False)):
            place = spark.sql(f"DESCRIBE FORMATTED fresh.{name}").where("col_name = 'Location'").first()["data_type"]
            folder = Path(place.removeprefix("file:"))
            for file in folder.glob("part-*.parquet"):
                (folder / f"broken-{file.name}").write_bytes(b"no parquet at all, but long enough to be looked at")
                if not keep:
                    file.write_bytes(b"no parquet at all, but long enough to be looked at")
                    (folder / f".{file.name}.crc").unlink()
            spark.catalog.refreshTable(f"fresh.{name}")
        assert rows(V.schema_freshness(spark, "fresh")) == [
            ("a", datetime(2025, 3, 1)), ("broken", None), ("part", None), ("torn", None),
        ]
    finally:
        spark.sql("DROP DATABASE fresh CASCADE")


@pytest.mark.parametrize("allowed", [["a", None], [None], [], ["a"]])
def test_no_row_is_lost_by_a_split(spark, allowed):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "v string")
    check = Q.Check("is_in_list", {"column": "v", "allowed": allowed})
    valid, bad = Q.split(df, [check])
    assert sorted(str(r["v"]) for r in valid.union(bad.select("v")).collect()) == ["None", "a", "b"]
    assert {r["v"] for r in bad.collect()} == {"a", "b"} - set(allowed)
