"""Cleansing, deduplication and the silver job."""

from __future__ import annotations

from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from helpers import rows
from pyspark.sql import functions as F

from tablecraft.operators import columns as C
from tablecraft.operators.dedupe import dedupe, dedupe_latest
from tablecraft.operators.quality import Check
from tablecraft.plans.gold import metrics
from tablecraft.plans.silver import cleanse, refresh_history, silver_table


def test_clean_trims_spaces_and_nulls_empty_text(spark):
    df = spark.createDataFrame([(" a ", 1), ("  ", 2), ("\t", 3), (None, 4)], "s string, n int")
    assert rows(C.clean(df), "n", "s") == [(1, "a"), (2, None), (3, "\t"), (4, None)]


@pytest.mark.parametrize("kind", ["boolean", "string"])
def test_filter_deleted(spark, kind):
    df = spark.createDataFrame([(1, "true"), (2, "false"), (3, None)], "id int, _fivetran_deleted string")
    df = df.withColumn("_fivetran_deleted", F.col("_fivetran_deleted").cast(kind))
    assert rows(C.filter_deleted(df)) == [(2,)]
    assert C.filter_deleted(df.select("id")).count() == 3


def test_normalize_replaces_each_character(spark):
    df = spark.createDataFrame([(" A--b C ", 5)], "s string, n int")
    assert rows(C.normalize_column_values(df, ["s", "n"])) == [("a__b_c", 5)]


def test_standardize_dates(spark):
    df = spark.createDataFrame(
        [(1, datetime(2025, 1, 2, 3), datetime(2024, 1, 1))], "id int, made timestamp, created_timestamp timestamp"
    )
    found = C.standardize_date_columns(df, [{"original_name": "made", "new_name": "created"}])
    assert found.columns == ["id", "created_timestamp", "created_date"]
    assert rows(found) == [(1, datetime(2025, 1, 2, 3), date(2025, 1, 2))]
    assert C.standardize_date_columns(df, [None]) is df and C.standardize_date_columns(df, []) is df
    with pytest.raises(ValueError, match="timestamp"):
        C.standardize_date_columns(df, [{"original_name": "id", "new_name": "x"}])


def test_uppercase_alpha(spark):
    df = spark.createDataFrame([("ab",), ("a1",), ("",), (None,), ("é",)], "s string")
    assert [r["s"] for r in C.uppercase_alpha_columns(df, ["s"]).collect()] == ["AB", None, "", None, None]


def test_order_select_and_rename(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "b int, _fivetran_synced int, a int, c int")
    assert C.order_columns(df, ["c"]).columns == ["c", "a", "b", "_fivetran_synced"]
    assert C.order_columns(df, ["_fivetran_synced"]).columns == ["_fivetran_synced", "a", "b", "c"]
    assert C.select_columns(df, ["a", "zz"]).columns == ["a"]
    assert C.select_columns(df, []).columns == df.columns
    renames = [{"original_name": "a", "new_name": "x"}, {"original_name": "zz", "new_name": "y"}]
    assert C.rename_columns(df, renames).columns == ["b", "_fivetran_synced", "x", "c"]
    spaced = df.toDF("Some Name", "B", "cC", "D d")
    assert C.snake_case_columns(spaced).columns == ["some_name", "b", "cc", "d_d"]
    assert C.lower_case_columns(spaced).columns == ["some name", "b", "cc", "d d"]


def test_has_to_bool(spark):
    df = spark.createDataFrame([("Has a Pool",), ("none",), (None,)], "s string")
    assert [r["s"] for r in C.has_to_bool(df, [("s", "pool")]).collect()] == [True, False, False]


def test_load_columns():
    assert C.load_columns() == ["bronze_commit_version"]
    assert C.load_columns(history=True) == ["_change_type", "_commit_version", "_commit_timestamp"]
    assert len(C.load_columns(bulk_load=True, history=True)) == 4


def test_recent_rows_and_membership(spark):
    df = spark.createDataFrame([(1, datetime(2025, 1, 1, 12)), (2, datetime(2025, 1, 1, 11))], "id int, ts timestamp")
    assert rows(C.recent_rows(df, "ts", "2025-01-01 12:05:00"), "id") == [(1,)]
    assert rows(C.recent_rows(df, "ts", "2025-01-01 12:05:00", timedelta(hours=2)), "id") == [(1,), (2,)]
    assert rows(C.with_values(df, "id", [1]), "id") == [(1,)]
    assert rows(C.with_values(df, "id", [1], negate=True), "id") == [(2,)]


def test_rounding_standard(spark):
    df = spark.createDataFrame([(2.345, 2.5, 0.123449)], "m double, w double, r double")
    found = df.select(C.money(F.col("m")), C.whole(F.col("w")), C.ratio(F.col("r"))).first()
    assert tuple(found) == (Decimal("2.35"), Decimal("3.00"), Decimal("0.1234"))


def test_gold_metrics(spark):
    df = spark.createDataFrame([("a", 1.5), ("a", 2.25), ("b", None)], "k string, v double")
    assert rows(metrics(df, ["k"], F.col("v"))) == [
        ("a", 2, Decimal("3.75"), Decimal("2.00")), ("b", 1, None, None),
    ]


def test_dedupe(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (None, "c", 3), (None, "d", 4), (2, "e", 5)], "k int, v string, t int")
    assert rows(dedupe(df, ["k"], "first", ["t"]), "v") == [("a",), ("c",), ("e",)]
    assert rows(dedupe(df, ["k"], "last", ["t"]), "v") == [("b",), ("d",), ("e",)]
    assert rows(dedupe(df, ["k"], False)) == [(2, "e", 5)]
    assert rows(dedupe_latest(df, ["k"], "t"), "v") == [("b",), ("d",), ("e",)]
    twice = df.unionByName(df)
    assert rows(dedupe(twice)) == rows(df)
    assert rows(dedupe(twice, keep=False)) == []
    with pytest.raises(ValueError, match="order_by"):
        dedupe(df, ["k"])
    with pytest.raises(ValueError, match="keep"):
        dedupe(df, ["k"], "any", ["t"])


def test_dedupe_keeps_one_row_per_key_before_the_shuffle(spark):
    df = spark.range(10).select((F.col("id") % 2).alias("k"), "id")
    plan = dedupe(df, ["k"], "first", ["id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_cleanse(spark):
    df = spark.createDataFrame(
        [(1, " Red Shoe ", datetime(2025, 1, 1), "false", 7), (2, "x", datetime(2025, 1, 1), "true", 7)],
        "pk int, name string, at timestamp, _fivetran_deleted string, bronze_commit_version bigint",
    )
    options = {
        "rename_columns": [{"original_name": "name", "new_name": "label"}],
        "standardize_date_columns": [{"original_name": "at", "new_name": "made"}],
        "select_columns": ["pk", "label", "made_date"],
        "normalize_column_values": ["label"],
    }
    config = {"t": {"table_name": "t", "dataframe": df, **options}, "all": {"table_name": "u", "dataframe": df}}
    found = cleanse(config)
    assert found["t"]["dataframe"].columns == ["pk", "label", "made_date", "bronze_commit_version"]
    assert rows(found["t"]["dataframe"], "pk", "label") == [(1, "red_shoe")]
    # Without a selection every column stays.
    assert found["all"]["dataframe"].columns == ["pk", "name", "at", "bronze_commit_version"]
    assert config["t"]["dataframe"] is df


def test_silver_table(spark):
    df = spark.createDataFrame([(1, "a"), (2, " ")], "pk int, name string")
    check = Check("not_null", {"column": "name"})
    written = []
    with pytest.raises(ValueError, match="1 rows quarantined"):
        silver_table(df, {"table_name": "t", "select_columns": ["pk", "name"]}, [check], written.append)
    assert rows(written[0], "pk") == [(2,)]
    with pytest.raises(ValueError, match="required"):
        silver_table(df, {"select_columns": ["absent"]})
    assert silver_table(df, {}).count() == 2


def test_refresh_history(spark):
    initial = spark.createDataFrame([("U1", "a")], "user_id string, tier string")
    first = refresh_history(None, None, ["user_id"], initial=initial, initial_version=3, as_of="2025-01-01 00:00:00")
    feed = spark.createDataFrame(
        [("U1", "a", "delete", datetime(2025, 2, 1), 4)],
        "user_id string, tier string, _change_type string, _commit_timestamp timestamp, _commit_version bigint",
    )
    assert rows(refresh_history(feed, first, ["user_id"]), "is_active_record") == [(False,)]
    assert refresh_history(None, first, ["user_id"]) is first
    with pytest.raises(ValueError):
        refresh_history(feed, None, ["user_id"])
