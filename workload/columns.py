"""Cleansing, deduplication, gold metrics, SQL and rendering."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from tablecraft.operators import columns as C
from tablecraft.operators.dedupe import dedupe, dedupe_latest
from tablecraft.plans.gold import metrics
from tablecraft.plans.silver import cleanse, silver_table
from tablecraft.sources.feed import load_tables
from tablecraft.sources.sql import render_rows as rendered
from tablecraft.sources.sql import run_sql
from workload.inputs import table
from workload.registry import query

# Text made dirty by rules on values; the same expressions in Spark and SQL.
_NAME = "CASE WHEN c_acctbal < 0 THEN '   ' WHEN c_nationkey < 10 THEN '  ' || c_name || ' ' ELSE c_name END"
_SEGMENT = "CASE WHEN c_nationkey = 3 THEN '' WHEN c_nationkey > 15 THEN c_mktsegment || '  ' ELSE c_mktsegment END"
_FLAG = "CASE WHEN o_orderstatus = 'P' THEN 'true' WHEN o_orderpriority = '5-LOW' THEN NULL ELSE 'false' END"
_LABEL = "'  ' || upper(p_name) || '--(' || p_brand || ') '"
_DATE_FORMAT = "%Y-%m-%d"


def _dirty_customers(spark, d):
    return table(spark, d, "customer").select(
        "c_custkey", F.expr(_NAME).alias("c_name"), F.expr(_SEGMENT).alias("c_mktsegment"), "c_acctbal"
    )


@query(
    f"""SELECT c_custkey, nullif(trim({_NAME}), '') AS c_name, nullif(trim({_SEGMENT}), '') AS c_mktsegment, c_acctbal
    FROM customer"""
)
def clean_strings(spark, d):
    return C.clean(_dirty_customers(spark, d))


@query(f"SELECT o_orderkey, o_orderstatus FROM orders WHERE {_FLAG} = 'false'")
def filter_deleted(spark, d):
    orders = table(spark, d, "orders").withColumn(C.DELETED_FLAG, F.expr(_FLAG))
    return C.filter_deleted(orders.select("o_orderkey", "o_orderstatus", C.DELETED_FLAG))


@query(
    f"""SELECT p_partkey, regexp_replace(trim(lower({_LABEL})), '[^a-zA-Z0-9]', '_', 'g') AS label, p_size FROM part"""
)
def normalize_values(spark, d):
    part = table(spark, d, "part").select("p_partkey", F.expr(_LABEL).alias("label"), "p_size")
    return C.normalize_column_values(part, ["label", "p_size"])


@query(
    f"SELECT o_orderkey, o_orderdate AS order_timestamp, strftime(o_orderdate, '{_DATE_FORMAT}') AS order_date FROM orders"
)
def standardize_dates(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    dated = C.standardize_date_columns(orders, [{"original_name": "o_orderdate", "new_name": "order"}])
    return dated.withColumn("order_date", F.col("order_date").cast("string"))


@query(
    """SELECT p_partkey, CASE WHEN regexp_replace(p_type, '[^A-Za-z]', '', 'g') = p_type THEN upper(p_type) END AS p_type,
    CASE WHEN regexp_replace(p_name, '[^A-Za-z]', '', 'g') = p_name THEN upper(p_name) END AS p_name FROM part"""
)
def uppercase_alpha(spark, d):
    return C.uppercase_alpha_columns(table(spark, d, "part").select("p_partkey", "p_type", "p_name"), ["p_type", "p_name"])


@query("SELECT p_partkey, contains(upper(p_name), 'RING') AS p_name, contains(upper(p_type), 'ECO') AS p_type FROM part")
def has_to_bool(spark, d):
    return C.has_to_bool(table(spark, d, "part").select("p_partkey", "p_name", "p_type"), [("p_name", "ring"), ("p_type", "Eco")])


@query("SELECT n_name, n_nationkey, n_regionkey FROM nation")
def order_columns(spark, d):
    return C.order_columns(table(spark, d, "nation"), ["n_name"])


@query("SELECT p_partkey, p_size FROM part")
def select_columns(spark, d):
    return C.select_columns(table(spark, d, "part"), ["p_partkey", "p_size", "absent"])


@query("SELECT n_nationkey AS nation_key, n_name AS name, n_regionkey FROM nation")
def rename_columns(spark, d):
    renames = [{"original_name": "n_nationkey", "new_name": "nation_key"}, {"original_name": "n_name", "new_name": "name"}]
    return C.rename_columns(table(spark, d, "nation"), renames)


@query("SELECT n_nationkey AS nation_key, n_name AS nation_name FROM nation")
def snake_case(spark, d):
    named = table(spark, d, "nation").select(F.col("n_nationkey").alias("Nation Key"), F.col("n_name").alias("Nation Name"))
    return C.snake_case_columns(named)


@query("SELECT n_nationkey AS nationkey, n_name AS name FROM nation")
def lower_names(spark, d):
    named = table(spark, d, "nation").select(F.col("n_nationkey").alias("NationKey"), F.col("n_name").alias("NAME"))
    return C.lower_case_columns(named)


@query(
    f"""SELECT o_orderkey AS order_key, o_orderdate AS placed_timestamp, strftime(o_orderdate, '{_DATE_FORMAT}') AS placed_date,
      regexp_replace(trim(lower(trim(o_orderpriority || ' '))), '[^a-zA-Z0-9]', '_', 'g') AS o_orderpriority
    FROM orders WHERE {_FLAG} = 'false'"""
)
def cleanse_orders(spark, d):
    def orders(_):
        return table(spark, d, "orders").withColumns(
            {C.DELETED_FLAG: F.expr(_FLAG), "o_orderpriority": F.expr("o_orderpriority || ' '")}
        )

    config = {
        "orders": {
            "table_name": "orders",
            "rename_columns": [{"original_name": "o_orderkey", "new_name": "order_key"}],
            "standardize_date_columns": [{"original_name": "o_orderdate", "new_name": "placed"}],
            "select_columns": ["order_key", "placed_timestamp", "placed_date", "o_orderpriority"],
            "normalize_column_values": ["o_orderpriority"],
        }
    }
    result = cleanse(load_tables(config, orders))["orders"]["dataframe"]
    return result.withColumn("placed_date", F.col("placed_date").cast("string"))


@query(f"SELECT c_custkey AS customer_key, nullif(trim({_NAME}), '') AS c_name FROM customer")
def silver_customers(spark, d):
    options = {
        "table_name": "customer",
        "rename_columns": [{"original_name": "c_custkey", "new_name": "customer_key"}],
        "select_columns": ["customer_key", "c_name"],
    }
    return silver_table(_dirty_customers(spark, d), options)


@query("SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-25 12:00:00' - INTERVAL 3 DAY")
def recent_events(spark, d):
    return C.recent_rows(table(spark, d, "events"), "ts", F.lit("2024-01-25 12:00:00").cast("timestamp_ntz"), timedelta(days=3))


@query("SELECT event_id, event_type FROM events WHERE event_type NOT IN ('error', 'view')")
def events_without(spark, d):
    return C.with_values(table(spark, d, "events").select("event_id", "event_type"), "event_type", ["error", "view"], negate=True)


@query(
    """WITH x AS (
      SELECT c_mktsegment, CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18, 4)) AS amount
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)
    SELECT c_mktsegment, count(*) AS row_count, CAST(round(sum(amount), 2) AS DOUBLE) AS total_revenue,
      CAST(round(CAST(sum(amount) AS DOUBLE) / count(*), 0) AS DOUBLE) AS avg_revenue
    FROM x GROUP BY 1"""
)
def gold_revenue_by_segment(spark, d):
    sold = (
        table(spark, d, "lineitem")
        .select("l_orderkey", "l_extendedprice", "l_discount")
        .join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    )
    amount = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    result = metrics(sold, ["c_mktsegment"], amount, prefix="revenue")
    return result.withColumns({c: F.col(c).cast("double") for c in ("total_revenue", "avg_revenue")})


@query(
    """SELECT o_orderstatus, CAST(round(avg(CAST(o_totalprice AS DECIMAL(18, 4))), 2) AS DOUBLE) AS price,
      round(CAST(count(*) FILTER (o_orderpriority = '1-URGENT') AS DOUBLE) / count(*), 4) AS urgent_share
    FROM orders GROUP BY 1"""
)
def rounding_standard(spark, d):
    price = C.money(F.avg(F.col("o_totalprice").cast("decimal(18,4)")))
    share = C.ratio(F.count_if(F.col("o_orderpriority") == "1-URGENT") / F.count(F.lit(1)))
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(
        price.cast("double").alias("price"), share.cast("double").alias("urgent_share")
    )


# -- deduplication ------------------------------------------------------------

_KEY = ("l_orderkey", "l_linenumber")
_REST = (
    "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus", "l_shipdate",
)


def _ranked(order: str) -> str:
    return f"""SELECT * EXCLUDE (rn) FROM (
      SELECT *, row_number() OVER (PARTITION BY {", ".join(_KEY)} ORDER BY {order}) AS rn FROM lineitem) WHERE rn = 1"""


@query(_ranked(", ".join(_REST)))
def dedupe_first(spark, d):
    return dedupe(table(spark, d, "lineitem"), _KEY, "first", _REST)


@query(_ranked(", ".join(f"{c} DESC" for c in _REST)))
def dedupe_last(spark, d):
    return dedupe(table(spark, d, "lineitem"), _KEY, "last", _REST)


@query(f"SELECT * FROM lineitem QUALIFY count(*) OVER (PARTITION BY {', '.join(_KEY)}) = 1")
def dedupe_none(spark, d):
    return dedupe(table(spark, d, "lineitem"), _KEY, False)


@query(_ranked("l_shipdate DESC, " + ", ".join(f"{c} DESC" for c in _REST)), name="dedupe_latest")
def dedupe_latest_shipment(spark, d):
    return dedupe_latest(table(spark, d, "lineitem"), _KEY, "l_shipdate", _REST)


@query("SELECT DISTINCT text, lang FROM documents")
def dedupe_rows(spark, d):
    return dedupe(table(spark, d, "documents").select("text", "lang"))


# -- SQL and rendering --------------------------------------------------------


@query(
    """SELECT l_returnflag, count(*) AS n, sum(CAST(l_quantity AS BIGINT))::BIGINT AS quantity FROM lineitem
    WHERE l_shipdate >= TIMESTAMP '1998-01-01 00:00:00' AND l_linestatus = 'O' GROUP BY 1"""
)
def sql_params(spark, d):
    table(spark, d, "lineitem").createOrReplaceTempView("workload_lineitem")
    return run_sql(
        spark,
        """SELECT l_returnflag, count(*) AS n, sum(CAST(l_quantity AS BIGINT)) AS quantity FROM workload_lineitem
        WHERE l_shipdate >= CAST(:since AS TIMESTAMP_NTZ) AND l_linestatus = :status GROUP BY 1""",
        {"since": "1998-01-01 00:00:00", "status": "O"},
    )


@query(
    """SELECT doc_id || ' | ' || coalesce(CASE WHEN lang <> 'en' THEN lang END, 'NULL') || ' | ' ||
      CASE WHEN length(j) > 50 THEN substr(j, 1, 50) || '...' ELSE j END AS line
    FROM (SELECT *, to_json({'source': source, 'lang': lang, 'n_chars': n_chars, 'origin': 'documents'})::VARCHAR AS j FROM documents)"""
)
def render_rows(spark, d):
    nested = F.struct("source", "lang", "n_chars", F.lit("documents").alias("origin"))
    other = F.when(F.col("lang") != "en", F.col("lang"))
    return rendered(table(spark, d, "documents").select("doc_id", other.alias("lang"), nested.alias("about")))
