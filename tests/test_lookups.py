"""Feature lookups and places within a radius, against brute force."""

from __future__ import annotations

import math
import random
from datetime import datetime, timedelta

import pytest
from helpers import rows
from pyspark.sql import functions as F

from tablecraft.operators.features import FeatureLookup, lookup_features, training_set
from tablecraft.operators.geo import EARTH_RADIUS, nearby_places


def when(hours):
    return datetime(2025, 1, 1) + timedelta(hours=hours)


@pytest.fixture
def labels(spark):
    rng = random.Random(1)
    data = [(i, "hot" if i % 3 == 0 else rng.choice(["a", "b", None]), when(rng.randrange(200))) for i in range(60)]
    return spark.createDataFrame(data, "id int, member_id string, ts timestamp")


@pytest.fixture
def visits(spark):
    rng = random.Random(2)
    data = {("hot" if i % 3 == 0 else rng.choice(["a", "b", None]), when(rng.randrange(200))): i for i in range(80)}
    return spark.createDataFrame(
        [(k, t, i if i % 4 else None) for (k, t), i in data.items()], "member_id string, ts timestamp, age int"
    )


@pytest.mark.parametrize("lookback", [None, timedelta(hours=10)])
def test_point_in_time_lookup_equals_brute_force(spark, labels, visits, group_size, lookback):
    lookup = FeatureLookup("visits", "member_id", ["age"], timestamp_lookup_key="ts", lookback_window=lookback)
    seen = visits.collect()
    expected = []
    for label in labels.collect():
        fitting = [v for v in seen if v["member_id"] == label["member_id"] is not None and v["ts"] <= label["ts"]]
        newest = max(fitting, key=lambda v: v["ts"], default=None)
        if newest and lookback and newest["ts"] < label["ts"] - lookback:
            newest = None
        expected.append((*label, newest["age"] if newest else None))
    found = rows(lookup_features(labels, visits, lookup))
    assert found == sorted(expected, key=lambda r: tuple((v is not None, str(v)) for v in r))


def test_lookup_by_key(spark, labels, group_size):
    members = spark.createDataFrame([("hot", 1, "x"), ("a", None, "y")], "member_id string, age int, area string")
    lookup = FeatureLookup(
        "m", "member_id", ["age", "area"], rename_outputs={"area": "member_area"}, default_values={"age": 18}
    )
    found = lookup_features(labels, members, lookup)
    assert found.columns == ["id", "member_id", "ts", "age", "member_area"]
    by_member = {(r["member_id"], r["age"], r["member_area"]) for r in found.collect()}
    assert by_member == {("hot", 1, "x"), ("a", 18, "y"), ("b", 18, None), (None, 18, None)}
    assert found.count() == labels.count()


def test_lookup_refuses_names_the_labels_have(labels, visits):
    with pytest.raises(ValueError, match="rename_outputs"):
        lookup_features(labels, visits.withColumnRenamed("age", "id"), FeatureLookup("v", "member_id", ["id"]))


def test_training_set(spark, labels, visits):
    members = spark.createDataFrame([("hot", "x")], "member_id string, area string")
    lookups = [
        (FeatureLookup("visits", "member_id", ["age"], timestamp_lookup_key="ts"), visits),
        (FeatureLookup("members", ["member_id"], ["area"]), members),
    ]
    assert training_set(labels, lookups, "id", ["member_id", "ts", "id"]).columns == ["id", "age", "area"]
    with pytest.raises(ValueError, match="label column"):
        training_set(labels, [], "absent")


def _four(visits, members):
    later = visits.withColumnRenamed("ts", "seen")
    return [
        (FeatureLookup("visits", "member_id", ["age"], timestamp_lookup_key="ts"), visits),
        (FeatureLookup("members", "member_id", ["area"], default_values={"area": "none"}), members),
        (
            FeatureLookup(
                "visits", "member_id", ["age"], timestamp_lookup_key="ts", feature_timestamp="seen",
                rename_outputs={"age": "recent_age"}, lookback_window=timedelta(hours=10),
            ),
            later,
        ),
        (FeatureLookup("visits", "member_id", ["age"], timestamp_lookup_key="made", feature_timestamp="seen",
                       rename_outputs={"age": "made_age"}), later),
    ]


def _two_times(labels):
    return labels.withColumn("made", F.col("ts") - F.expr("make_interval(0, 0, 0, 0, id % 50)"))


def test_lookups_on_one_timeline_equal_one_after_the_other(spark, labels, visits, group_size):
    labels = _two_times(labels)
    members = spark.createDataFrame([("hot", "x"), ("a", None), (None, "z")], "member_id string, area string")
    lookups = _four(visits, members)
    one_by_one = labels
    for lookup, features in lookups:
        one_by_one = lookup_features(one_by_one, features, lookup)
    found = training_set(labels, lookups, None)
    assert found.columns == one_by_one.columns == ["id", "member_id", "ts", "made", "age", "area", "recent_age", "made_age"]
    assert rows(found) == rows(one_by_one) and found.count() == 60
    with pytest.raises(Exception, match="several rows of one key"):
        training_set(labels, _four(visits, members.union(members)), None).collect()


def test_one_exchange_for_all_lookups_of_a_key(spark, labels, visits):
    members = spark.createDataFrame([("hot", "x")], "member_id string, area string")
    plan = training_set(_two_times(labels), _four(visits, members), None)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Join" not in plan


def test_lookups_by_features_and_by_other_types(spark, labels, visits):
    members = spark.createDataFrame([("hot", 5), ("a", 6)], "member_id string, home int")
    homes = spark.createDataFrame([(5, "five"), (6, "six")], "home bigint, name string")
    lookups = [
        (FeatureLookup("homes", "home", ["name"]), homes),
        (FeatureLookup("members", "member_id", ["home"]), members),
    ]
    found = training_set(labels, lookups, None)
    assert found.columns == ["id", "member_id", "ts", "name", "home"]
    assert {(r["member_id"], r["home"], r["name"]) for r in found.collect()} == {("hot", 5, "five"), ("a", 6, "six"), ("b", None, None), (None, None, None)}
    with pytest.raises(ValueError, match="several lookups"):
        training_set(labels, [lookups[0], lookups[0]], None)


def test_lookup_configuration():
    lookup = FeatureLookup.from_config(
        {"feature_store_name": "fs.member", "lookup_key": "member_id", "feature_names": ["Age"], "lookback_window": 30}
    )
    assert (lookup.table_name, lookup.keys, lookup.lookback_window) == ("fs.member", ["member_id"], timedelta(days=30))
    with pytest.raises(ValueError, match="table_name"):
        FeatureLookup.from_config({"lookup_key": "k", "feature_names": []})


def _meters(a, b):
    (lat1, lon1), (lat2, lon2) = [[math.radians(v) for v in p] for p in (a, b)]
    h = math.sin((lat2 - lat1) / 2) ** 2 + math.cos(lat1) * math.cos(lat2) * math.sin((lon2 - lon1) / 2) ** 2
    return 2 * EARTH_RADIUS * math.asin(math.sqrt(min(h, 1.0)))


@pytest.mark.parametrize("radius", [11265.0, 300_000.0, 900_000.0, 4_000_000.0, 15_000_000.0, 30_000_000.0])
@pytest.mark.parametrize("region", ["equator", "mid latitudes", "pole", "south pole", "date line"])
def test_nearby_places_equals_brute_force(spark, group_size, region, radius):
    rng = random.Random(3)
    spread = radius / 111_000 * 2

    def point():
        lat, lon = {
            "equator": (0, 10), "mid latitudes": (52, 13), "pole": (90, 0), "south pole": (-90, 0), "date line": (-17, 180),
        }[region]
        lat += rng.uniform(-spread, spread)
        lon += rng.uniform(-180, 180) if "pole" in region else rng.uniform(-spread, spread)
        return max(-90.0, min(90.0, lat)), (lon + 180) % 360 - 180

    centers = [(i, *point()) for i in range(25)]
    places = [(i, *point(), rng.choice(["gym", "cafe"])) for i in range(60)]
    expected = {
        (c[0], p[0]) for c in centers for p in places if p[3] == "gym" and _meters(c[1:3], p[1:3]) <= radius
    }
    found = nearby_places(
        spark.createDataFrame(centers, "id int, lat double, lon double"),
        spark.createDataFrame(places, "id int, lat double, lon double, type string"),
        radius,
        types=["gym"],
    ).collect()
    assert len(found) == len(expected)
    assert {(r["center_id"], r["place_id"]) for r in found} == expected


def test_nearby_places_refuses_odd_radii(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0)], "id int, lat double, lon double")
    for radius in (0, -1):
        with pytest.raises(ValueError):
            nearby_places(df, df, radius)


def test_lookup_of_repeated_keys_is_refused(spark, group_size):
    labels = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    features = spark.createDataFrame([(1, 5.0), (2, 6.0), (None, 7.0), (None, 8.0)], "k int, f double")
    lookup = FeatureLookup("t", "k", ["f"])
    assert rows(lookup_features(labels, features, lookup)) == [(None, None), (1, 5.0), (2, 6.0)]
    with pytest.raises(Exception, match="several rows of one key"):
        lookup_features(labels, features.union(features), lookup).collect()
