"""Change feeds, history, snapshots and versions."""

from __future__ import annotations

import zlib

from pyspark.sql import functions as F

from tablecraft.functions.time import iso8601_utc
from tablecraft.operators import cdc, versions
from tablecraft.sources import feed as feeds
from workload.inputs import AS_OF, FEED, HISTORY, LOG, SECOND_LOAD, change_feed, commit_log, stored, table
from workload.registry import query

_HISTORY_COLUMNS = (
    "user_id, state, value, bronze_commit_version, effective_start_date, effective_end_date, is_active_record"
)


@query(f"WITH {FEED} SELECT * FROM feed WHERE _commit_version >= 2500")
def feed_from_version(spark, d):
    return feeds.from_version(change_feed(spark, d), 2500)


@query(
    f"""WITH {FEED} SELECT * FROM feed
    WHERE _commit_timestamp BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-25 00:00:00'"""
)
def feed_between(spark, d):
    return feeds.between(
        change_feed(spark, d), since_date="2024-01-05 00:00:00", ending_date="2024-01-25 00:00:00"
    )


@query(f"WITH {LOG} SELECT *, (SELECT max(version) FROM log) AS bronze_commit_version FROM nation")
def bulk_load_stamped(spark, d):
    config = {"n": {"table_name": "nation", "target_table_name": "silver_nation", "read_cdc": True}}
    loaded = feeds.load_targets(
        config,
        read=lambda name: table(spark, d, name),
        read_feed=lambda name: change_feed(spark, d),
        read_log=lambda name: commit_log(spark, d),
        is_bulk_load=True,
    )
    return loaded["n"]["dataframe"]


@query(
    f"""WITH {HISTORY}, v AS (
      SELECT max(bronze_commit_version) AS v FROM history
      WHERE effective_start_date < TIMESTAMP '{SECOND_LOAD}')
    SELECT feed.* FROM feed, v WHERE _commit_version >= v"""
)
def feed_since_target(spark, d):
    """The feed a target still needs, from the highest version it holds."""
    feed = stored(change_feed(spark, d), "feed")
    config = {"u": {"table_name": "users", "target_table_name": "users_history", "read_cdc": True}}
    loaded = feeds.load_targets(
        config,
        read=lambda name: _first_load(feed),
        read_feed=lambda name: feed,
        read_log=lambda name: commit_log(spark, d),
    )
    return loaded["u"]["dataframe"]


@query(f"WITH {FEED} SELECT * FROM feed WHERE _change_type IN ('insert', 'delete')")
def cdc_filter(spark, d):
    return cdc.filter_change_types(change_feed(spark, d), ["insert", "delete"])


@query(
    f"""WITH {FEED}, r AS (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY _commit_version, _commit_timestamp, _change_type) AS rn
      FROM feed WHERE _change_type IN ('update_preimage', 'delete'))
    SELECT user_id, _commit_timestamp, _commit_version AS bronze_commit_version FROM r WHERE rn = 1"""
)
def cdc_oldest(spark, d):
    return cdc.oldest_closing_event(change_feed(spark, d), ["user_id"])


@query(f"WITH {HISTORY} SELECT {_HISTORY_COLUMNS} FROM history")
def cdc_to_scd(spark, d):
    return cdc.history_rows(change_feed(spark, d), ["user_id"])


def _first_load(feed):
    """The history table after the first load, partitioned like a table that is kept up to date."""
    first = feed.where(F.col("_commit_timestamp") < F.lit(SECOND_LOAD).cast("timestamp"))
    return stored(cdc.history_rows(first, ["user_id"]), "history", ("is_active_record",))


@query(f"WITH {HISTORY} SELECT {_HISTORY_COLUMNS} FROM history")
def scd2_merge(spark, d):
    """The second load re-reads the last commit of the first one."""
    feed = stored(change_feed(spark, d), "feed")
    target = _first_load(feed)
    start = versions.scalar(versions.max_commit_version(target))
    return cdc.merge_history(feeds.from_version(feed, start), target, ["user_id"])


@query(f"WITH {HISTORY} SELECT {_HISTORY_COLUMNS} FROM history")
def scd2_replay(spark, d):
    """The whole feed once more on a complete history changes nothing."""
    feed = stored(change_feed(spark, d), "feed")
    history = stored(cdc.history_rows(feed, ["user_id"]), "history", ("is_active_record",))
    return cdc.merge_history(feed, history, ["user_id"])


@query(
    f"""SELECT *, TIMESTAMP '{AS_OF}' AS effective_start_date, CAST(NULL AS TIMESTAMP) AS effective_end_date,
    true AS is_active_record, 7::BIGINT AS bronze_commit_version FROM customer"""
)
def history_standardize(spark, d):
    return cdc.standardize_history(table(spark, d, "customer"), 7, AS_OF)


@query(
    """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(date_part('millisecond', ts)::BIGINT % 1000 AS VARCHAR), 3, '0')
    || '+00:00' AS iso FROM events"""
)
def iso8601(spark, d):
    return table(spark, d, "events").select("event_id", iso8601_utc(F.col("ts")).alias("iso"))


@query(
    f"""WITH {FEED}, {LOG}, t AS (SELECT max(o_orderdate) + INTERVAL 8204 DAY AS ingested FROM orders),
    v AS (SELECT max(version) AS v FROM log, t
      WHERE operation IN ('MERGE', 'WRITE', 'UPDATE') AND timestamp <= ingested)
    SELECT feed.* FROM feed, v WHERE v IS NULL OR _commit_version >= v"""
)
def incremental_load(spark, d):
    """Events since the commit nearest before the target's last ingestion, 8204 days after the last order."""
    target_log = table(spark, d, "orders").select(
        F.lit(0).alias("version"),
        (F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 8204 DAY")).alias("timestamp"),
        F.lit("WRITE").alias("operation"),
    )
    log = versions.data_history(commit_log(spark, d))
    loaded = feeds.load_incremental(
        {"u": {"table_name": "users"}},
        "users_history",
        read_feed=lambda name: change_feed(spark, d),
        read_log=lambda name: target_log if name == "users_history" else log,
    )
    return loaded["u"]["dataframe"]


# Two snapshots of the customers: first those with a positive balance, then those
# outside one nation, with the balance of the households raised.
_BEFORE = "SELECT * FROM customer WHERE c_acctbal > 0"
_AFTER = """SELECT c_custkey, c_name, c_nationkey,
  CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, c_mktsegment
  FROM customer WHERE c_nationkey <> 7"""


@query(
    f"""WITH b AS ({_BEFORE}), a AS ({_AFTER}), e AS (
      SELECT a.*, 'insert' AS _change_type FROM a ANTI JOIN b USING (c_custkey)
      UNION ALL SELECT b.*, 'delete' FROM b ANTI JOIN a USING (c_custkey)
      UNION ALL SELECT b.*, 'update_preimage' FROM b JOIN a USING (c_custkey) WHERE a.c_acctbal <> b.c_acctbal
      UNION ALL SELECT a.*, 'update_postimage' FROM b JOIN a USING (c_custkey) WHERE a.c_acctbal <> b.c_acctbal)
    SELECT *, 2::BIGINT AS _commit_version, TIMESTAMP '{AS_OF}' AS _commit_timestamp FROM e"""
)
def snapshot_diff(spark, d):
    customers = table(spark, d, "customer")
    before = customers.where("c_acctbal > 0")
    raised = F.when(F.col("c_mktsegment") == "HOUSEHOLD", F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal"))
    after = customers.where("c_nationkey <> 7").withColumn("c_acctbal", raised)
    return cdc.snapshot_changes(before, after, ["c_custkey"], 2, AS_OF)


@query(
    f"""WITH {FEED}, r AS (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY _commit_version DESC) AS rn
      FROM feed WHERE _change_type <> 'update_preimage' AND _commit_timestamp <= TIMESTAMP '{SECOND_LOAD}')
    SELECT user_id, state, value FROM r WHERE rn = 1 AND _change_type <> 'delete'"""
)
def state_as_of(spark, d):
    return cdc.state_as_of(change_feed(spark, d), ["user_id"], timestamp=SECOND_LOAD)


@query(
    f"""WITH {HISTORY} SELECT {_HISTORY_COLUMNS} FROM history
    WHERE effective_start_date <= TIMESTAMP '{SECOND_LOAD}'
      AND (effective_end_date IS NULL OR effective_end_date > TIMESTAMP '{SECOND_LOAD}')"""
)
def scd2_valid_at(spark, d):
    return cdc.valid_at(cdc.history_rows(change_feed(spark, d), ["user_id"]), SECOND_LOAD)


@query(f"WITH {HISTORY} SELECT {_HISTORY_COLUMNS} FROM history WHERE is_active_record")
def scd2_current(spark, d):
    return cdc.current_rows(cdc.history_rows(change_feed(spark, d), ["user_id"]))


# -- versions -----------------------------------------------------------------


@query(f"WITH {HISTORY} SELECT coalesce(max(bronze_commit_version), -1) AS max_version FROM history")
def max_version(spark, d):
    return versions.max_commit_version(cdc.history_rows(change_feed(spark, d), ["user_id"]))


@query(f"WITH {LOG} SELECT max(version) AS version FROM log")
def current_version(spark, d):
    return versions.current_commit_version(commit_log(spark, d))


@query(f"WITH {LOG} SELECT * FROM log WHERE operation IN ('MERGE', 'WRITE', 'UPDATE')")
def data_history(spark, d):
    return versions.data_history(commit_log(spark, d))


@query(f"WITH {LOG} SELECT max(timestamp) AS timestamp FROM log WHERE operation IN ('MERGE', 'WRITE', 'UPDATE')")
def latest_ingestion(spark, d):
    return versions.latest_ingestion(commit_log(spark, d))


@query(
    f"""WITH {LOG} SELECT version FROM log WHERE timestamp <= TIMESTAMP '{SECOND_LOAD}'
    ORDER BY timestamp DESC, version DESC LIMIT 1"""
)
def closest_version(spark, d):
    return versions.closest_version(commit_log(spark, d), SECOND_LOAD)


@query(f"WITH {LOG} SELECT max(version) AS version FROM log WHERE operation NOT IN ('OPTIMIZE', 'VACUUM END')")
def last_change_version(spark, d):
    return versions.last_change_version(commit_log(spark, d))


@query(
    """SELECT 'orders' AS table_name, max(o_orderdate) AS last_modified FROM orders
    UNION ALL SELECT 'lineitem', max(l_shipdate) FROM lineitem
    UNION ALL SELECT 'events', max(ts) FROM events
    UNION ALL SELECT 'nation', CAST(NULL AS TIMESTAMP) FROM nation WHERE n_nationkey = (SELECT min(n_nationkey) FROM nation)"""
)
def freshness(spark, d):
    names = ("orders", "lineitem", "events", "nation")
    return versions.freshness(
        {n: table(spark, d, n) for n in names}, logs={"events": commit_log(spark, d)}
    )


@query(
    """SELECT 'orders' AS table_name, max(o_orderdate) AS last_modified FROM orders
    UNION ALL SELECT 'lineitem', max(l_shipdate) FROM lineitem
    UNION ALL SELECT 'region', CAST(NULL AS TIMESTAMP) FROM region WHERE r_regionkey = (SELECT min(r_regionkey) FROM region)
    UNION ALL SELECT 'broken', CAST(NULL AS TIMESTAMP) FROM region WHERE r_regionkey = (SELECT min(r_regionkey) FROM region)"""
)
def schema_freshness(spark, d):
    schema = f"freshness_{zlib.crc32(d.encode())}"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {schema}")
    for name in ("orders", "lineitem", "region"):
        spark.sql(f"CREATE OR REPLACE VIEW {schema}.{name} AS SELECT * FROM parquet.`{d}/{name}.parquet`")
    # A view of a table that is gone.
    spark.sql(f"CREATE TABLE IF NOT EXISTS {schema}.gone (id INT) USING parquet")
    spark.sql(f"CREATE OR REPLACE VIEW {schema}.broken AS SELECT * FROM {schema}.gone")
    spark.sql(f"DROP TABLE {schema}.gone")
    return versions.schema_freshness(spark, schema)


# -- metadata frames: parts stand for tables, their brand for the schema --------


def _tables(spark, d):
    return table(spark, d, "part").select(
        F.lit("silver").alias("table_catalog"),
        F.lower("p_brand").alias("table_schema"),
        F.concat(F.lit("part_"), F.col("p_partkey")).alias("table_name"),
        F.when(F.col("p_type") == "ECONOMY", "DELTA").otherwise("PARQUET").alias("data_source_format"),
    )


@query(
    """SELECT 'silver' AS table_catalog, lower(p_brand) AS table_schema, 'part_' || p_partkey AS table_name
    FROM part WHERE p_type = 'ECONOMY' AND lower(p_brand) = 'brand#2'"""
)
def tables_by_format(spark, d):
    return versions.tables_of_format(_tables(spark, d), "silver", "brand#2")


def _constraints(spark, d):
    part = table(spark, d, "part")
    name = F.concat(F.lit("c_"), F.col("p_partkey"))
    where = [
        F.lit("silver").alias("constraint_catalog"),
        F.lower("p_brand").alias("constraint_schema"),
        name.alias("constraint_name"),
    ]
    kinds = part.select(
        *where, F.when(F.col("p_size") > 10, "PRIMARY KEY").otherwise("FOREIGN KEY").alias("constraint_type")
    )
    lines = table(spark, d, "lineitem").select("l_partkey", "l_linenumber").distinct()
    usage = part.join(lines, F.col("p_partkey") == F.col("l_partkey")).select(
        *where,
        F.lit("silver").alias("table_catalog"),
        F.lower("p_brand").alias("table_schema"),
        F.concat(F.lit("part_"), F.col("p_partkey")).alias("table_name"),
        F.concat(F.lit("k"), F.col("l_linenumber")).alias("column_name"),
        F.col("l_linenumber").cast("long").alias("ordinal_position"),
    )
    return usage, kinds


@query(
    """SELECT DISTINCT 'silver' AS table_catalog, lower(p_brand) AS table_schema, 'part_' || p_partkey AS table_name,
      'k' || l_linenumber AS column_name, l_linenumber::BIGINT AS ordinal_position
    FROM part JOIN lineitem ON p_partkey = l_partkey WHERE p_size > 10"""
)
def primary_keys(spark, d):
    return versions.primary_key_columns(*_constraints(spark, d))


@query(
    """SELECT DISTINCT 'silver' AS table_catalog, lower(p_brand) AS table_schema, 'part_' || p_partkey AS table_name,
      'k' || l_linenumber AS column_name, l_linenumber::BIGINT AS ordinal_position, 'c_' || p_partkey AS constraint_name,
      CASE WHEN p_size > 10 THEN 'PRIMARY KEY' ELSE 'FOREIGN KEY' END AS constraint_type
    FROM part JOIN lineitem ON p_partkey = l_partkey"""
)
def table_constraints(spark, d):
    return versions.table_constraints(*_constraints(spark, d))


def _column_tags(spark, d):
    return table(spark, d, "lineitem").select(
        F.lit("silver").alias("catalog_name"),
        F.lit("parts").alias("schema_name"),
        F.concat(F.lit("part_"), F.col("l_partkey")).alias("table_name"),
        F.concat(F.lit("k"), F.col("l_linenumber")).alias("column_name"),
        F.when(F.col("l_returnflag") == "R", "is_deleted_field").otherwise("created_date_field").alias("tag_name"),
    )


@query(
    """SELECT 'silver' AS catalog_name, 'parts' AS schema_name, 'part_' || l_partkey AS table_name,
      min('k' || l_linenumber) AS column_name FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2, 3"""
)
def tagged_columns(spark, d):
    return versions.tagged_columns(_column_tags(spark, d), "is_deleted_field")


@query(
    """SELECT DISTINCT 'silver' AS catalog_name, 'parts' AS schema_name, 'part_' || l_partkey AS table_name,
      CASE WHEN l_returnflag = 'R' THEN 'is_deleted_field' ELSE 'created_date_field' END AS tag_name FROM lineitem"""
)
def table_tags(spark, d):
    return versions.table_tags(_column_tags(spark, d))
