"""Merges, updates and deletes on the merge pair of orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablecraft.functions.change import differs
from tablecraft.operators import merge as M
from tablecraft.sources.tables import append_rows
from workload.inputs import AS_OF, PAIR, merge_source, merge_target, table
from workload.registry import query

_KEY = ["o_orderkey"]
_PLAIN = ("o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
_NOW = f"TIMESTAMP '{AS_OF}'"
_OLD = "TIMESTAMP '1900-01-01 00:00:00'"
_LOADED = "2020-01-01 00:00:00"
_CHANGED = "(" + " OR ".join(f"t.{c} IS DISTINCT FROM s.{c}" for c in _PLAIN) + ")"
_BOTH = "t.o_orderkey IS NOT NULL AND s.o_orderkey IS NOT NULL"


def _outer(columns: str, where: str = "true") -> str:
    return f"WITH {PAIR} SELECT coalesce(t.o_orderkey, s.o_orderkey) AS o_orderkey, {columns} FROM t FULL JOIN s ON t.o_orderkey = s.o_orderkey WHERE {where}"


def _picked(condition: str, columns=_PLAIN) -> str:
    return ", ".join(
        f"CASE WHEN t.o_orderkey IS NULL OR ({_BOTH} AND {condition}) THEN s.{c} ELSE t.{c} END AS {c}" for c in columns
    )


@query(
    _outer(
        _picked(_CHANGED)
        + f""", CASE WHEN t.o_orderkey IS NULL THEN {_NOW} ELSE TIMESTAMP '{_LOADED}' END AS created_date,
        CASE WHEN t.o_orderkey IS NULL OR ({_BOTH} AND {_CHANGED}) THEN {_NOW} ELSE TIMESTAMP '{_LOADED}' END AS last_modified_date"""
    )
)
def merge_audited(spark, d):
    loaded = F.lit(_LOADED).cast("timestamp")
    target = merge_target(spark, d).withColumns({"created_date": loaded, "last_modified_date": loaded})
    return M.audited_upsert(merge_source(spark, d), target, _KEY, AS_OF)


@query(
    _outer(
        _picked(_CHANGED)
        + f""", CASE WHEN t.o_orderkey IS NULL THEN {_NOW} ELSE {_OLD} END AS created_date,
        CASE WHEN t.o_orderkey IS NULL OR ({_BOTH} AND {_CHANGED}) THEN {_NOW} ELSE {_OLD} END AS last_modified_date"""
    )
)
def audit_backfill(spark, d):
    """The target has no audit columns yet."""
    return M.audited_upsert(merge_source(spark, d), merge_target(spark, d), _KEY, AS_OF)


@query("SELECT *, CAST(NULL AS TIMESTAMP) AS created_date, CAST(NULL AS TIMESTAMP) AS last_modified_date FROM orders")
def audit_evolve(spark, d):
    return M.ensure_audit_columns(table(spark, d, "orders"))[0]


@query("SELECT o_orderkey, o_orderstatus = 'P' OR o_orderkey % 3 = 0 AS changed FROM orders")
def merge_change_predicate(spark, d):
    """All orders against a copy that loses the customer of some and the price of others."""
    target = table(spark, d, "orders").alias("target")
    source = table(spark, d, "orders").withColumns(
        {
            "o_totalprice": F.expr("CASE WHEN o_orderstatus = 'P' THEN -1.0 - o_totalprice ELSE o_totalprice END"),
            "o_custkey": F.expr("CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey END"),
        }
    ).alias("source")
    joined = target.join(source, F.col("target.o_orderkey") == F.col("source.o_orderkey"))
    return joined.select("target.o_orderkey", differs(_PLAIN).alias("changed"))


@query(_outer(_picked("true")))
def merge_keys(spark, d):
    return M.merge(merge_target(spark, d), merge_source(spark, d), primary_keys=_KEY)


@query(_outer(_picked("true"), "s.o_orderkey IS NOT NULL"))
def merge_hard_delete(spark, d):
    return M.merge_with_keys(merge_target(spark, d), merge_source(spark, d), _KEY, hard_delete=True)


@query(
    f"""WITH {PAIR}, j AS (
      SELECT t.o_orderkey AS k, s.o_orderkey AS sk, t.o_custkey AS c, t.o_orderstatus AS st, s.o_totalprice AS sp,
        t.o_totalprice AS tp, t.o_orderpriority AS p, coalesce(s.o_totalprice > t.o_totalprice, false) AS m
      FROM t LEFT JOIN s ON t.o_orderkey = s.o_orderkey)
    SELECT k AS o_orderkey, c AS o_custkey, CASE WHEN m THEN 'U' ELSE st END AS o_orderstatus,
      CASE WHEN m THEN sp ELSE tp END AS o_totalprice, p AS o_orderpriority FROM j
    UNION ALL SELECT s.* FROM s WHERE NOT EXISTS (
      SELECT 1 FROM t WHERE t.o_orderkey = s.o_orderkey AND s.o_totalprice > t.o_totalprice)"""
)
def merge_condition(spark, d):
    return M.merge(
        merge_target(spark, d),
        merge_source(spark, d),
        condition="target.o_orderkey = source.o_orderkey AND source.o_totalprice > target.o_totalprice",
        when_matched_update={"o_totalprice": "source.o_totalprice", "o_orderstatus": F.lit("U")},
    )


@query(
    """SELECT o_orderkey, o_custkey, CASE WHEN c_custkey IS NULL THEN o_orderpriority ELSE c_mktsegment END AS o_orderpriority
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > o_totalprice / 100
    UNION ALL SELECT NULL, c_custkey, 'NONE' FROM customer WHERE NOT EXISTS (
      SELECT 1 FROM orders WHERE o_custkey = c_custkey AND c_acctbal > o_totalprice / 100)"""
)
def merge_many_per_key(spark, d):
    """The target has many rows per join key, the source one."""
    return M.merge_on_condition(
        table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice"),
        table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"),
        "target.o_custkey = source.c_custkey AND source.c_acctbal > target.o_totalprice / 100",
        when_matched_update={"o_orderpriority": "source.c_mktsegment"},
        when_not_matched_insert={"o_custkey": "source.c_custkey", "o_orderpriority": F.lit("NONE")},
        with_schema_evolution=True,
    ).select("o_orderkey", "o_custkey", "o_orderpriority")


_CHANGE = "CASE WHEN o_orderpriority = '2-HIGH' THEN 'delete' ELSE 'update' END"


@query(
    f"""WITH {PAIR}, f AS (SELECT *, {_CHANGE} AS _change_type FROM s)
    SELECT coalesce(t.o_orderkey, s.o_orderkey) AS o_orderkey, {_picked("s._change_type <> 'delete'")},
      CASE WHEN t.o_orderkey IS NULL OR ({_BOTH} AND s._change_type <> 'delete') THEN s._change_type END AS _change_type,
      CASE WHEN {_BOTH} AND s._change_type = 'delete' THEN true END AS is_deleted,
      CASE WHEN {_BOTH} AND s._change_type = 'delete' THEN {_NOW} END AS deleted_at
    FROM t FULL JOIN f AS s ON t.o_orderkey = s.o_orderkey"""
)
def merge_soft_delete(spark, d):
    source = merge_source(spark, d).withColumn("_change_type", F.expr(_CHANGE))
    config = M.MergeConfig(join_fields=_KEY, delete_mode=M.DeleteMode.SOFT)
    return M.merge_with_config(merge_target(spark, d), source, config, as_of=AS_OF)


@query(
    _outer(", ".join(f"CASE WHEN t.o_orderkey IS NULL THEN s.{c} ELSE coalesce(s.{c}, t.{c}) END AS {c}" for c in _PLAIN))
)
def merge_ignore_nulls(spark, d):
    config = M.MergeConfig(join_fields=_KEY, ignore_null_updates=True)
    return M.merge(merge_target(spark, d), merge_source(spark, d), config=config)


@query(_outer(_picked("(t.o_orderstatus IS DISTINCT FROM s.o_orderstatus)")))
def merge_ignored_columns(spark, d):
    """Only a changed status triggers an update."""
    ignored = ("o_custkey", "o_totalprice", "o_orderpriority")
    config = M.MergeConfig(join_fields=_KEY, columns_to_ignore=ignored)
    return M.merge(merge_target(spark, d), merge_source(spark, d), config=config)


@query(
    _outer(
        f"""coalesce(t.o_custkey, s.o_custkey) AS o_custkey,
        CASE WHEN t.o_orderkey IS NULL THEN s.o_orderstatus ELSE t.o_orderstatus END AS o_orderstatus,
        CASE WHEN t.o_orderkey IS NULL THEN s.o_totalprice
             WHEN {_BOTH} AND s.o_totalprice > 200000 THEN t.o_totalprice + s.o_totalprice
             ELSE t.o_totalprice END AS o_totalprice,
        coalesce(t.o_orderpriority, s.o_orderpriority) AS o_orderpriority"""
    )
)
def merge_custom_set(spark, d):
    config = M.MergeConfig(
        join_fields=_KEY,
        custom_set={"o_totalprice": "target.o_totalprice + source.o_totalprice"},
        update_condition="source.o_totalprice > 200000",
    )
    return M.merge(merge_target(spark, d), merge_source(spark, d), config=config)


@query(
    _outer(
        """coalesce(t.o_custkey, s.o_custkey) AS o_custkey,
        CASE WHEN t.o_orderkey IS NULL THEN 'N' ELSE t.o_orderstatus END AS o_orderstatus,
        CASE WHEN s.o_orderkey IS NULL THEN t.o_totalprice WHEN t.o_orderkey IS NULL THEN NULL ELSE s.o_totalprice END AS o_totalprice,
        t.o_orderpriority AS o_orderpriority"""
    )
)
def merge_custom_maps(spark, d):
    """Primary keys with both an update and an insert map."""
    return M.merge(
        merge_target(spark, d),
        merge_source(spark, d),
        primary_keys=_KEY,
        when_matched_update={"o_totalprice": "source.o_totalprice"},
        when_not_matched_insert={
            "o_orderkey": "source.o_orderkey",
            "o_custkey": "source.o_custkey",
            "o_orderstatus": F.lit("N"),
        },
    )


@query(_outer(_picked("true") + ", CASE WHEN s.o_orderkey IS NOT NULL THEN upper(s.o_orderpriority) END AS channel"))
def merge_schema_evolution(spark, d):
    source = merge_source(spark, d).withColumn("channel", F.upper("o_orderpriority"))
    return M.merge(merge_target(spark, d), source, primary_keys=_KEY)


@query(
    f"""WITH {PAIR}, n AS (SELECT o_orderkey, o_totalprice, 'new' AS channel FROM s)
    SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority, NULL AS channel FROM t
    UNION ALL SELECT o_orderkey, NULL, NULL, o_totalprice, NULL, channel FROM n"""
)
def append_schema_merge(spark, d):
    new = merge_source(spark, d).select("o_orderkey", "o_totalprice", F.lit("new").alias("channel"))
    return append_rows(merge_target(spark, d), new)


@query(
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
      CASE WHEN o_orderstatus = 'P' THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice FROM orders"""
)
def update_where(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return M.update_rows(orders, {"o_orderstatus": F.lit("X"), "o_totalprice": "o_totalprice * 2"}, "o_orderstatus = 'P'")


@query("SELECT * FROM orders WHERE o_orderstatus IS NULL OR o_orderstatus <> 'F'")
def delete_where(spark, d):
    return M.delete_rows(table(spark, d, "orders"), "o_orderstatus = 'F'")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def merge_duplicate_keys(spark, d):
    return M.duplicate_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])
