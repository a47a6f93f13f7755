"""Feature lookups, semi and anti joins, places within a radius."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from tablecraft.operators.features import FeatureLookup, lookup_features, training_set as training
from tablecraft.operators.geo import nearby_places as nearby
from tablecraft.operators.skew import skew_join
from workload.inputs import table
from workload.registry import query


def _purchases(spark, d):
    events = table(spark, d, "events").where("event_type = 'purchase'")
    return events.select("event_id", "user_id", "ts", F.col("value").alias("amount"))


def _visits(spark, d):
    events = table(spark, d, "events").where("event_type IN ('view', 'click')")
    # A click has no duration: the newest feature may well be a null.
    return events.select(
        "user_id", "ts", "event_type", F.when(F.col("event_type") == "view", F.col("value")).alias("duration")
    )


_ASOF = """
p AS (SELECT event_id, user_id, ts, value AS amount FROM events WHERE event_type = 'purchase'),
v AS (SELECT user_id, ts, event_type, CASE WHEN event_type = 'view' THEN value END AS duration
      FROM events WHERE event_type IN ('view', 'click')),
j AS (SELECT p.*, v.ts AS seen, v.event_type AS last_visit, v.duration
      FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts)
"""


@query(
    """SELECT o_orderkey, o_custkey, o_totalprice, c_mktsegment AS segment, coalesce(c_acctbal, 0) AS c_acctbal
    FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_nationkey <> 4) ON o_custkey = c_custkey"""
)
def feature_lookup(spark, d):
    labels = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    customers = table(spark, d, "customer").where("c_nationkey <> 4").withColumnRenamed("c_custkey", "o_custkey")
    lookup = FeatureLookup.from_config(
        {
            "feature_store_name": "customer",
            "lookup_key": "o_custkey",
            "feature_names": ["c_mktsegment", "c_acctbal"],
            "rename_outputs": {"c_mktsegment": "segment"},
            "default_values": {"c_acctbal": 0.0},
        }
    )
    return lookup_features(labels, customers, lookup)


@query(f"WITH {_ASOF} SELECT event_id, user_id, ts, amount, last_visit, duration FROM j")
def feature_asof(spark, d):
    lookup = FeatureLookup(
        "visits", "user_id", ["event_type", "duration"], timestamp_lookup_key="ts", rename_outputs={"event_type": "last_visit"}
    )
    return lookup_features(_purchases(spark, d), _visits(spark, d), lookup)


@query(
    f"""WITH {_ASOF} SELECT event_id, user_id, ts, amount,
      CASE WHEN seen >= ts - INTERVAL 6 HOUR THEN last_visit END AS last_visit,
      coalesce(CASE WHEN seen >= ts - INTERVAL 6 HOUR THEN duration END, -1) AS duration FROM j"""
)
def feature_lookback(spark, d):
    lookup = FeatureLookup(
        "visits",
        "user_id",
        ["event_type", "duration"],
        timestamp_lookup_key="ts",
        rename_outputs={"event_type": "last_visit"},
        lookback_window=timedelta(hours=6),
        default_values={"duration": -1.0},
    )
    return lookup_features(_purchases(spark, d), _visits(spark, d), lookup)


@query(
    f"""WITH {_ASOF} SELECT event_id, amount, last_visit, c_mktsegment FROM j LEFT JOIN customer ON user_id = c_custkey"""
)
def training_set(spark, d):
    visits = FeatureLookup(
        "visits", "user_id", ["event_type"], timestamp_lookup_key="ts", rename_outputs={"event_type": "last_visit"}
    )
    segment = FeatureLookup("customer", "user_id", ["c_mktsegment"])
    customers = table(spark, d, "customer").withColumnRenamed("c_custkey", "user_id")
    return training(
        _purchases(spark, d), [(visits, _visits(spark, d)), (segment, customers)], "amount", ["user_id", "ts"]
    )


@query(
    """WITH p AS (SELECT event_id, user_id, ts, value AS amount FROM events WHERE event_type = 'purchase'),
    v AS (SELECT user_id, ts, value FROM events WHERE event_type = 'view'),
    c AS (SELECT user_id, ts, value FROM events WHERE event_type = 'click'),
    pv AS (SELECT p.*, v.value AS view_value FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts),
    pc AS (SELECT pv.*, CASE WHEN c.ts >= pv.ts - INTERVAL 7 DAY THEN c.value END AS click_value
           FROM pv ASOF LEFT JOIN c ON pv.user_id = c.user_id AND pv.ts >= c.ts)
    SELECT event_id, amount, view_value, click_value, c_mktsegment AS segment, coalesce(n_orders, 0) AS n_orders
    FROM pc LEFT JOIN customer ON user_id = c_custkey
    LEFT JOIN (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY ALL) ON user_id = o_custkey"""
)
def training_set_timeline(spark, d):
    """Four lookups of one key, two of them as of a time, on one timeline."""

    def events(kind):
        return table(spark, d, "events").where(F.col("event_type") == kind).select("user_id", "ts", "value")

    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    orders = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(F.count("*").alias("n_orders"))
    lookups = [
        (FeatureLookup("views", "user_id", ["value"], "ts", {"value": "view_value"}), events("view")),
        (FeatureLookup("clicks", "user_id", ["value"], "ts", {"value": "click_value"}, timedelta(days=7)), events("click")),
        (FeatureLookup("customer", "user_id", ["c_mktsegment"], rename_outputs={"c_mktsegment": "segment"}), customers),
        (FeatureLookup("orders", "user_id", ["n_orders"], default_values={"n_orders": 0}), orders),
    ]
    return training(_purchases(spark, d), lookups, "amount", ["user_id", "ts"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def missing_keys(spark, d):
    return _by_key(spark, d, "left_anti")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def matching_keys(spark, d):
    return _by_key(spark, d, "left_semi")


def _by_key(spark, d, how):
    rich = table(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return skew_join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), rich, ["o_custkey"], how)


# Coordinates follow the balance (latitude) and the nation (longitude).


@query(
    """WITH s AS (SELECT s_suppkey, s_acctbal / 200 AS lat, s_nationkey * 0.05 AS lon FROM supplier),
    c AS (SELECT c_custkey, c_acctbal / 200 AS lat, c_nationkey * 0.05 AS lon FROM customer
          WHERE c_mktsegment IN ('HOUSEHOLD', 'FURNITURE')),
    m AS (SELECT s_suppkey, c_custkey, 2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians(c.lat - s.lat) / 2), 2)
        + cos(radians(s.lat)) * cos(radians(c.lat)) * pow(sin(radians(c.lon - s.lon) / 2), 2)))) AS m FROM s, c)
    SELECT s_suppkey AS center_s_suppkey, c_custkey AS place_c_custkey, round(m, 3) AS distance_m FROM m WHERE m <= 11265"""
)
def nearby_places(spark, d):
    def located(name: str, prefix: str):
        return table(spark, d, name).withColumns(
            {"lat": F.col(f"{prefix}_acctbal") / 200, "lon": F.col(f"{prefix}_nationkey") * F.lit(0.05)}
        )

    found = nearby(
        located("supplier", "s").select("s_suppkey", "lat", "lon"),
        located("customer", "c").select("c_custkey", "c_mktsegment", "lat", "lon"),
        types=["HOUSEHOLD", "FURNITURE"],
        type_column="c_mktsegment",
    )
    return found.select("center_s_suppkey", "place_c_custkey", F.round("distance_m", 3).alias("distance_m"))
