"""Large keys are cut or salted without changing any result."""

from __future__ import annotations

import random

import pytest
from helpers import rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from tablecraft.operators.skew import MAX_GROUP_ROWS_CONF, carry, heavy_keys, skew_join


@pytest.fixture
def skewed(spark):
    rng = random.Random(5)
    data = [
        ("hot" if rng.random() < 0.4 else rng.choice(["a", "b", None]), i, None if rng.random() < 0.5 else i * 10)
        for i in range(300)
    ]
    return spark.createDataFrame(data, "k string, t bigint, v bigint")


def test_heavy_keys_are_bounded_by_the_partitions(spark, skewed):
    spark.conf.set(MAX_GROUP_ROWS_CONF, "1")
    try:
        many = spark.range(100).select((F.col("id") % 50).alias("k"))
        assert len(heavy_keys(many, ["k"])) == 4
    finally:
        spark.conf.unset(MAX_GROUP_ROWS_CONF)
    assert heavy_keys(skewed, ["k"]) == {}


@pytest.mark.parametrize("partitions", ["4", "500"])
def test_heavy_keys_on_clusters_of_any_size(spark, partitions):
    spark.conf.set(MAX_GROUP_ROWS_CONF, "300")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.range(0, 20000, 1, 16).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 40).alias("k"))
        found = heavy_keys(df, ["k"])
        sizes = {r["h"]: r["count"] for r in df.groupBy(F.xxhash64("k").alias("h")).count().collect()}
        largest = max(sizes, key=sizes.get)
        assert found[largest] == sizes[largest]
        assert set(found) <= set(sizes) and len(found) == min(len(sizes), int(partitions))
        assert heavy_keys(df.limit(0), ["k"]) == {}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset(MAX_GROUP_ROWS_CONF)


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("include_current", [False, True])
def test_carry_equals_a_plain_window(spark, skewed, group_size, forward, include_current):
    order = F.col("t").desc() if forward else F.col("t").asc()
    stop = Window.currentRow if include_current else -1
    w = Window.partitionBy("k").orderBy(order).rowsBetween(Window.unboundedPreceding, stop)
    expected = skewed.withColumn("x", F.last("v", ignorenulls=True).over(w))
    found = carry(skewed, ["k"], ["t"], {"x": F.col("v")}, forward=forward, include_current=include_current)
    assert rows(found.select("k", "t", "v", "x")) == rows(expected)


@pytest.mark.parametrize("dtype", ["date", "timestamp", "timestamp_ntz", "double"])
def test_carry_cuts_along_other_types(spark, group_size, dtype):
    position = {
        "date": "date_add(date'2024-01-01', cast(id as int))",
        "timestamp": "timestamp_seconds(id)",
        "timestamp_ntz": "cast(timestamp_seconds(id) as timestamp_ntz)",
        "double": "id / 7",
    }[dtype]
    df = spark.range(60).select(F.lit(1).alias("k"), F.expr(position).alias("t"), "id")
    found = carry(df, ["k"], ["t"], {"x": F.col("id")})
    assert [r["x"] for r in found.orderBy("t").collect()] == [None, *range(59)]


def test_carry_cuts_along_text(spark, group_size):
    df = spark.range(60).select(F.lit(1).alias("k"), F.lpad(F.col("id").cast("string"), 3, "0").alias("t"), "id")
    found = carry(df, ["k"], ["t"], {"x": F.col("id")})
    assert [r["x"] for r in found.orderBy("t").collect()] == [None, *range(59)]


def test_carry_cuts_within_one_instant(spark):
    spark.conf.set(MAX_GROUP_ROWS_CONF, "10")
    try:
        df = spark.range(80).select(F.lit(1).alias("k"), F.lit(7).alias("t"), "id")
        found = carry(df, ["k"], ["t", "id"], {"x": F.col("id")})
        assert [r["x"] for r in found.orderBy("id").collect()] == [None, *range(79)]
        assert found.groupBy("__segment").count().count() > 1 if "__segment" in found.columns else True
    finally:
        spark.conf.unset(MAX_GROUP_ROWS_CONF)


def test_equal_rows_and_other_types_join_alike_when_salted(spark, group_size):
    left = spark.range(200).select(F.lit("01").alias("k"), F.lit("same").alias("v"))
    right = spark.createDataFrame([(1, "one")], "k int, w string")
    assert skew_join(left, right, ["k"], "inner").count() == 200
    assert skew_join(left, right, ["k"], "left_anti").count() == 0


def test_rows_with_nested_maps_are_salted(spark, group_size):
    left = spark.range(60).select(F.lit(1).alias("k"), F.array(F.create_map(F.lit("a"), "id")).alias("m"))
    assert skew_join(left, spark.createDataFrame([(1, 2)], "k int, w int"), ["k"], "inner").count() == 60


def test_no_task_gets_a_large_key_whole(spark, skewed):
    spark.conf.set(MAX_GROUP_ROWS_CONF, "60")
    try:
        found = carry(skewed, ["k"], ["t"], {"x": F.col("v")})
        windows = [line for line in found._jdf.queryExecution().toString().splitlines() if "Window [" in line]
        assert any("__segment" in line for line in windows)
    finally:
        spark.conf.unset(MAX_GROUP_ROWS_CONF)


@pytest.mark.parametrize("null_safe", [False, True])
@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_skew_join_equals_a_plain_join(spark, skewed, group_size, how, null_safe):
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("a", 3), (None, 4), ("z", 5)], "k string, w int")
    other = right.withColumnRenamed("k", "rk")
    on = F.col("k").eqNullSafe(F.col("rk")) if null_safe else F.col("k") == F.col("rk")
    expected = skewed.join(other, on, how).drop("rk")
    assert rows(skew_join(skewed, right, ["k"], how, null_safe=null_safe)) == rows(expected)


def test_skew_join_with_keys_of_other_types(spark, group_size):
    left = spark.range(40).select((F.col("id") % 2).cast("int").alias("k"), "id")
    right = spark.createDataFrame([(0, "zero"), (2**40, "far")], "k bigint, w string")
    found = skew_join(left, right, ["k"])
    assert found.where("w = 'zero'").count() == 20 and found.count() == 40


def test_skew_join_refuses_other_types_of_join(spark, skewed):
    with pytest.raises(ValueError):
        skew_join(skewed, skewed.select("k"), ["k"], "full_outer")
