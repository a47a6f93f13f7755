"""Data quality, label agreement, tallies and lineage."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablecraft.operators import agreement as A
from tablecraft.operators import lineage as L
from tablecraft.operators import quality as Q
from workload.inputs import EDGES, lineage_edges, table
from workload.registry import query

_CHECKS = [
    Q.Check.from_config(c)
    for c in (
        {
            "name": "price_valid",
            "check": {"function": "is_in_range", "arguments": {"column": "o_totalprice", "min": 1000, "max": 400000}},
        },
        {
            "name": "status_in_list",
            "check": {"function": "is_in_list", "arguments": {"column": "o_orderstatus", "allowed": ["F", "O"]}},
        },
        {
            "name": "clerk_present",
            "criticality": "warn",
            "check": {
                "function": "is_not_null_and_not_empty",
                "arguments": {"column": "note", "trim_strings": True},
            },
        },
        {"name": "customer_present", "check": {"function": "not_null", "arguments": {"column": "customer"}}},
        {
            "name": "date_valid",
            "check": {
                "function": "expression_true_for_all",
                "arguments": {"expression": "o_orderdate >= TIMESTAMP_NTZ '1996-01-01 00:00:00'"},
            },
        },
        {
            "name": "one_per_day",
            "criticality": "warn",
            "check": {
                "function": "unique_combination_of_columns",
                "arguments": {"columns": ["o_custkey", "o_orderdate"]},
            },
        },
    )
]

_NOTE = "CASE WHEN o_orderpriority = '3-MEDIUM' THEN '  ' WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderpriority END"
_CUSTOMER = "CASE WHEN o_totalprice < 20000 THEN NULL ELSE o_custkey END"


def _orders(spark, d):
    return table(spark, d, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
        F.expr(_NOTE).alias("note"), F.expr(_CUSTOMER).alias("customer"),
    )


_CHECKED = f"""
x AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, {_NOTE} AS note, {_CUSTOMER} AS customer FROM orders),
c AS (SELECT *,
    CASE WHEN o_totalprice < 1000 OR o_totalprice > 400000 THEN 'price_valid' END AS e1,
    CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'status_in_list' END AS e2,
    CASE WHEN customer IS NULL THEN 'customer_present' END AS e3,
    CASE WHEN NOT o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' THEN 'date_valid' END AS e4,
    CASE WHEN note IS NULL OR trim(note) = '' THEN 'clerk_present' END AS w1,
    CASE WHEN count(*) OVER (PARTITION BY o_custkey, o_orderdate) > 1 THEN 'one_per_day' END AS w2
  FROM x),
r AS (SELECT *, concat_ws(',', e1, e2, e3, e4) AS errors, concat_ws(',', w1, w2) AS warnings FROM c)
"""


@query(f"WITH {_CHECKED} SELECT o_orderkey, o_totalprice, note FROM r WHERE errors = ''")
def dq_split_valid(spark, d):
    return Q.split(_orders(spark, d), _CHECKS)[0].select("o_orderkey", "o_totalprice", "note")


@query(f"WITH {_CHECKED} SELECT o_orderkey, errors, warnings FROM r WHERE errors <> '' OR warnings <> ''")
def dq_quarantine(spark, d):
    rows = Q.split(_orders(spark, d), _CHECKS)[1]
    return rows.select(
        "o_orderkey", F.array_join("_errors", ",").alias("errors"), F.array_join("_warnings", ",").alias("warnings")
    )


@query(
    f"""WITH {_CHECKED}, u AS (
      SELECT unnest([e1, e2, e3, e4]) AS "check", 'error' AS criticality FROM r
      UNION ALL SELECT unnest([w1, w2]), 'warn' FROM r)
    SELECT "check", criticality, count(*) AS failures FROM u WHERE "check" IS NOT NULL GROUP BY ALL"""
)
def dq_summary(spark, d):
    return Q.violations(_orders(spark, d), _CHECKS)


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) = 1 AS is_unique
    FROM lineitem"""
)
def dq_unique(spark, d):
    check = Q.Check("unique_combination_of_columns", {"columns": ["l_orderkey", "l_linenumber"]})
    rows = Q.annotate(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), [check])
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.size("_errors") == 0).alias("is_unique"))


@query("SELECT 'row_count_between' AS \"check\", count(*) AS row_count, count(*) BETWEEN 1 AND 100000000 AS passed FROM lineitem")
def dq_rowcount(spark, d):
    return Q.row_count_check(table(spark, d, "lineitem"), 1, 100_000_000)


# -- agreement ----------------------------------------------------------------


def _scores(source: str, by: str = "") -> str:
    return f"""WITH n AS (SELECT {by} count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality = 0 AND toxic = 0) AS tn,
      count(*) FILTER (quality = 0 AND toxic = 1) AS fp, count(*) FILTER (quality = 1 AND toxic = 0) AS fn FROM {source} GROUP BY ALL),
    x AS (SELECT *, (tp + fn) * (tn + fn) + (tn + fp) * (tp + fp) AS chance,
      (tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn) AS spread FROM n)
    SELECT {by} tp, tn, fp, fn, round((tp + tn) / (tp + tn + fp + fn), 9) AS accuracy,
      CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0::DOUBLE ELSE round(2 * tp / (2 * tp + fp + fn), 9) END AS f1,
      CASE WHEN chance = 0 THEN -9.0::DOUBLE ELSE round(1 - (fp + fn) * (tp + tn + fp + fn) / chance, 9) END AS kappa,
      CASE WHEN spread = 0 THEN 0.0::DOUBLE ELSE round((tp * tn - fp * fn) / sqrt(spread), 9) END AS matthews
    FROM x"""


def _rounded(df):
    # An undefined kappa is NaN, which databases compare in different ways.
    kappa = F.when(F.isnan("kappa"), F.lit(-9.0)).otherwise(F.round("kappa", 9))
    return df.withColumns(
        {"kappa": kappa, **{c: F.round(c, 9) for c in ("accuracy", "f1", "matthews")}}
    )


@query(_scores("labels"))
def agreement_scores(spark, d):
    return _rounded(A.agreement_scores(table(spark, d, "labels"), "quality", "toxic"))


@query(_scores("(SELECT source, quality, toxic FROM labels JOIN documents USING (doc_id))", "source,"))
def agreement_by_source(spark, d):
    labels = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return _rounded(A.agreement_scores(labels, "quality", "toxic", ["source"]))


@query(
    _scores("(SELECT source, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)"
            " WHERE quality IS NOT NULL AND toxic IS NOT NULL)", "source,")
)
def agreement_of_pairs(spark, d):
    """Documents without a label make lists of unequal length: an error by default, left out when asked for."""
    labels = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id", "left")
    return _rounded(A.agreement_scores(labels, "quality", "toxic", ["source"], nulls="drop"))


@query(
    """SELECT CASE WHEN quality IS NULL THEN NULL WHEN toxic = 1 THEN false ELSE true END AS label, count(*) AS n
    FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1"""
)
def label_tally(spark, d):
    """Labelled documents have feedback unless they are toxic."""
    labels = table(spark, d, "labels")
    value = F.when(F.col("toxic") == 1, "skip").when(F.col("quality") == 1, "yes").when(F.col("quality") == 0, "no")
    rows = table(spark, d, "documents").select("doc_id").join(labels, "doc_id", "left")
    return A.label_tally(rows, A.has_feedback(value))


# -- lineage ------------------------------------------------------------------

_ENDS = "source_table_full_name, target_table_full_name"


@query(
    f"""WITH {EDGES}, p AS (SELECT DISTINCT {_ENDS} FROM edges WHERE source_table_full_name <> target_table_full_name)
    SELECT source_table_full_name AS table_name, 'downstream' AS direction, target_table_full_name AS related_table FROM p
    UNION ALL SELECT target_table_full_name, 'upstream', source_table_full_name FROM p"""
)
def lineage_sets(spark, d):
    return L.lineage_pairs(lineage_edges(spark, d))


_ONE = "silver.orders.household"


@query(
    f"""WITH {EDGES} SELECT * FROM edges WHERE source_table_full_name = '{_ONE}' OR target_table_full_name = '{_ONE}'
    ORDER BY event_time DESC, entity_run_id LIMIT 100"""
)
def lineage_recent(spark, d):
    return L.recent_edges(lineage_edges(spark, d), _ONE, tie_break=F.col("entity_run_id"))


@query(
    f"""WITH {EDGES}, r AS (SELECT * FROM edges WHERE source_table_full_name = '{_ONE}' OR target_table_full_name = '{_ONE}')
    SELECT '{_ONE}' AS table_name,
      coalesce(string_agg(DISTINCT source_table_full_name, ',' ORDER BY source_table_full_name)
        FILTER (source_table_full_name <> '{_ONE}'), '') AS upstream,
      coalesce(string_agg(DISTINCT target_table_full_name, ',' ORDER BY target_table_full_name)
        FILTER (target_table_full_name <> '{_ONE}'), '') AS downstream FROM r"""
)
def lineage_of_table(spark, d):
    row = L.table_lineage(lineage_edges(spark, d), _ONE)
    return row.select(
        "table_name",
        F.array_join("upstream_tables", ",").alias("upstream"),
        F.array_join("downstream_tables", ",").alias("downstream"),
    )


@query(
    f"""WITH {EDGES}, m AS (SELECT {_ENDS}, json_extract_string(entity_metadata, '$.notebook_id') AS notebook_id,
        json_extract_string(entity_metadata, '$.job_info.job_id') AS job_id
      FROM edges WHERE entity_metadata <> 'not json'),
    u AS (SELECT DISTINCT source_table_full_name AS table_name, 'reads' AS role, notebook_id, job_id FROM m
      UNION SELECT target_table_full_name, 'writes', notebook_id, job_id FROM m WHERE source_table_full_name <> target_table_full_name),
    j AS (SELECT CAST(n_nationkey AS VARCHAR) AS job_id, n_name AS job_name FROM nation WHERE n_regionkey <> 2),
    k AS (SELECT CAST(n_nationkey AS VARCHAR) AS job_id, CAST(n_regionkey AS VARCHAR) AS notebook_id,
        '/jobs/' || lower(n_name) AS notebook_path, 'task_' || n_nationkey AS task_key FROM nation)
    SELECT table_name, role, u.notebook_id, coalesce(split_part(notebook_path, '/', 3), 'notebook_id:' || u.notebook_id) AS notebook_name,
      coalesce(notebook_path, 'notebook_id:' || u.notebook_id) AS notebook_path, u.job_id,
      coalesce(job_name, 'Job ' || u.job_id) AS job_name, task_key
    FROM u LEFT JOIN j ON u.job_id = j.job_id LEFT JOIN k ON u.job_id = k.job_id AND u.notebook_id = k.notebook_id"""
)
def lineage_entities(spark, d):
    nation = table(spark, d, "nation")
    job_id = F.col("n_nationkey").cast("string").alias("job_id")
    jobs = nation.where("n_regionkey <> 2").select(job_id, F.col("n_name").alias("job_name"))
    tasks = nation.select(
        job_id,
        F.col("n_regionkey").cast("string").alias("notebook_id"),
        F.concat(F.lit("/jobs/"), F.lower("n_name")).alias("notebook_path"),
        F.concat(F.lit("task_"), F.col("n_nationkey")).alias("task_key"),
    )
    return L.lineage_entities(lineage_edges(spark, d), jobs, tasks)
