"""Inputs that Spark derives from the driver's tables, and the same as SQL.

The driver has no change feeds, merge sources or lineage edges; they are derived
from whole tables by rules on values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecraft.operators.skew import carry
from tablecraft.session import working_dir

AS_OF = "2024-06-01 00:00:00"


def stored(df: DataFrame, purpose: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """A derived table, written to the shared folder so that several steps read it instead of deriving it again."""
    path = working_dir(df.sparkSession, purpose)
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- change feed of users -----------------------------------------------------
# Each user's events in time order: an error deletes the user's row, the event
# after it (or the first one) inserts it, any other event updates it.


def change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(
        "user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"), "event_id"
    )
    seen = carry(events, ["user_id"], ["ts", "event_id"], {"prev": F.struct("event_type", "value")})
    absent = F.col("prev").isNull() | (F.col("prev.event_type") == "error")
    error = F.col("event_type") == "error"
    new = F.struct(F.col("event_type").alias("state"), F.col("value"))
    old = F.struct(F.col("prev.event_type").alias("state"), F.col("prev.value").alias("value"))

    def event(kind: str, row) -> F.Column:
        return F.struct(F.lit(kind).alias("kind"), row.alias("row"))

    kinds = (
        F.when(error & absent, F.array().cast("array<struct<kind:string,row:struct<state:string,value:double>>>"))
        .when(error, F.array(event("delete", old)))
        .when(absent, F.array(event("insert", new)))
        .otherwise(F.array(event("update_preimage", old), event("update_postimage", new)))
    )
    return seen.select("user_id", "ts", "event_id", F.explode(kinds).alias("e")).select(
        "user_id",
        F.col("e.row.state").alias("state"),
        F.col("e.row.value").alias("value"),
        F.col("e.kind").alias("_change_type"),
        F.col("ts").alias("_commit_timestamp"),
        F.col("event_id").alias("_commit_version"),
    )


FEED = """
seen AS (
  SELECT user_id, event_type, value, ts, event_id,
         lag(event_type) OVER w AS prev_type, lag(value) OVER w AS prev_value
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
),
feed AS (
  SELECT user_id, event_type AS state, value,
         CASE WHEN prev_type IS NULL OR prev_type = 'error' THEN 'insert' ELSE 'update_postimage' END AS _change_type,
         ts AS _commit_timestamp, event_id AS _commit_version
  FROM seen WHERE event_type <> 'error'
  UNION ALL
  SELECT user_id, prev_type, prev_value,
         CASE WHEN event_type = 'error' THEN 'delete' ELSE 'update_preimage' END, ts, event_id
  FROM seen WHERE prev_type IS NOT NULL AND prev_type <> 'error'
)
"""

# Every history row of the feed: what a complete type-2 history must hold.
HISTORY = (
    FEED
    + """,
timeline AS (
  SELECT *, lead(_commit_timestamp) OVER (
    PARTITION BY user_id
    ORDER BY _commit_version, _commit_timestamp, CASE WHEN _change_type = 'delete' THEN 0 ELSE 1 END
  ) AS next_ts
  FROM feed WHERE _change_type <> 'update_preimage'
),
history AS (
  SELECT user_id, state, value, _commit_version AS bronze_commit_version,
         _commit_timestamp AS effective_start_date, next_ts AS effective_end_date,
         next_ts IS NULL AS is_active_record
  FROM timeline WHERE _change_type <> 'delete'
)
"""
)

# The feed is applied in two loads; the second one starts at this instant.
SECOND_LOAD = "2024-01-20 00:00:00"


# -- commit log ---------------------------------------------------------------
# One commit per event; the operation follows the event's type.

_OPERATION = """CASE event_type
  WHEN 'signup' THEN 'WRITE' WHEN 'purchase' THEN 'MERGE' WHEN 'click' THEN 'UPDATE'
  WHEN 'error' THEN 'VACUUM END' ELSE 'OPTIMIZE' END"""


def commit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("version"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.expr(_OPERATION).alias("operation"),
        F.col("props").alias("operationParameters"),
    )


LOG = f"""
log AS (
  SELECT event_id AS version, ts AS timestamp, {_OPERATION} AS operation, props AS "operationParameters" FROM events
)
"""


# -- merge pair ---------------------------------------------------------------
# Target: orders placed before 2001. Source: orders placed since 1998, some with
# a corrected price, some with a lost status, the others as they were.

_TARGET_WHERE = "o_orderdate < TIMESTAMP '2001-01-01 00:00:00'"
_SOURCE_WHERE = "o_orderdate >= TIMESTAMP '1998-01-01 00:00:00'"
_TARGET_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
_SOURCE_STATUS = "CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderstatus END"
_SOURCE_PRICE = "CASE WHEN o_orderstatus = 'P' THEN o_totalprice + 100 ELSE o_totalprice END"


def merge_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where(F.expr(_TARGET_WHERE.replace("TIMESTAMP", "TIMESTAMP_NTZ"))).select(*_TARGET_COLUMNS)


def merge_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where(F.expr(_SOURCE_WHERE.replace("TIMESTAMP", "TIMESTAMP_NTZ")))
    return orders.select(
        "o_orderkey",
        "o_custkey",
        F.expr(_SOURCE_STATUS).alias("o_orderstatus"),
        F.expr(_SOURCE_PRICE).alias("o_totalprice"),
        "o_orderpriority",
    )


PAIR = f"""
t AS (SELECT {", ".join(_TARGET_COLUMNS)} FROM orders WHERE {_TARGET_WHERE}),
s AS (
  SELECT o_orderkey, o_custkey, {_SOURCE_STATUS} AS o_orderstatus, {_SOURCE_PRICE} AS o_totalprice, o_orderpriority
  FROM orders WHERE {_SOURCE_WHERE}
)
"""


# -- lineage edges ------------------------------------------------------------
# Every order is one run: an open one writes a gold report from its segment's
# table, any other one its segment's table from its nation's; an urgent one
# rewrites what it reads. The notebook is the priority, the job the nation.

_SEGMENT_TABLE = "concat('silver.orders.', lower(c_mktsegment))"
_READ = f"CASE WHEN o_orderstatus = 'O' THEN {_SEGMENT_TABLE} ELSE concat('bronze.nation.n', c_nationkey) END"
_WRITTEN = f"""CASE WHEN o_orderpriority = '1-URGENT' THEN {_READ}
  WHEN o_orderstatus = 'O' THEN concat('gold.report.p', substr(o_orderpriority, 1, 1)) ELSE {_SEGMENT_TABLE} END"""
_METADATA = """CASE WHEN o_orderstatus = 'P' THEN 'not json'
  ELSE concat('{"notebook_id": "', substr(o_orderpriority, 1, 1), '", "job_info": {"job_id": "', c_nationkey, '"}}') END"""


def lineage_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("entity_run_id"),
        F.expr(_READ).alias("source_table_full_name"),
        F.expr(_WRITTEN).alias("target_table_full_name"),
        F.expr(_METADATA).alias("entity_metadata"),
        F.col("o_orderdate").alias("event_time"),
    )


EDGES = f"""
edges AS (
  SELECT o_orderkey AS entity_run_id, {_READ} AS source_table_full_name, {_WRITTEN} AS target_table_full_name,
         {_METADATA} AS entity_metadata, o_orderdate AS event_time
  FROM orders JOIN customer ON o_custkey = c_custkey
)
"""
