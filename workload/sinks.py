"""Tables written to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tablecraft.operators import quality as Q
from tablecraft.plans.jobs import check_table, silver_job
from tablecraft.session import working_dir
from tablecraft.sources import tables as S
from workload.inputs import AS_OF, PAIR, merge_source, merge_target, table
from workload.merges import _BOTH, _CHANGED, _KEY, _NOW, _OLD, _outer, _picked
from workload.registry import query


def _database(spark) -> str:
    """A database of its own for the tables of one run, in the shared folder."""
    name = f"run_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{working_dir(spark, 'tables')}'")
    return name


@query("SELECT o_orderkey, o_orderstatus, o_totalprice, 'it''s kept' AS owner FROM orders WHERE o_totalprice > 1000")
def table_overwrite(spark, d):
    """Created with a property, filled, and replaced by a part of itself."""
    name = f"{_database(spark)}.orders"
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    S.create_table(spark, name, orders, ["o_orderstatus"], {"owner_team": "it's kept"})
    S.write(orders, name, S.WriteMode.OVERWRITE, partition_by=["o_orderstatus"])
    S.write(S.read(spark, name).where("o_totalprice > 1000"), name, S.WriteMode.OVERWRITE, partition_by=["o_orderstatus"])
    owner = spark.sql(f"SHOW TBLPROPERTIES {name} ('owner_team')").first()["value"]
    return S.read(spark, name).withColumn("owner", F.lit(owner))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS o_totalprice, CASE WHEN o_orderkey % 2 = 1 THEN o_orderstatus END AS o_orderstatus FROM orders")
def table_append(spark, d):
    """Two appends; the second brings a column and lacks another."""
    name = f"{_database(spark)}.orders"
    orders = table(spark, d, "orders")
    S.write(orders.where("o_orderkey % 2 = 0").select("o_orderkey", "o_totalprice"), name, S.WriteMode.APPEND)
    S.write(orders.where("o_orderkey % 2 = 1").select("o_orderkey", "o_orderstatus"), name, S.WriteMode.APPEND)
    return S.read(spark, name)


@query(_outer(_picked("true")))
def table_merge(spark, d):
    """A merge by the key that the table's properties name."""
    name = f"{_database(spark)}.orders"
    target = merge_target(spark, d)
    S.create_table(spark, name, target, properties={S.PRIMARY_KEY: "o_orderkey"})
    S.write(target, name, S.WriteMode.APPEND)
    S.write(merge_source(spark, d), name, S.WriteMode.MERGE)
    return S.read(spark, name)


@query(_outer(_picked("true")))
def table_merge_partitions(spark, d):
    """A merge into a partitioned table: matched partitions are replaced, the others appended to or left alone."""
    name = f"{_database(spark)}.orders"
    target = merge_target(spark, d)
    S.write(target, name, S.WriteMode.OVERWRITE, partition_by=["o_orderstatus"])
    S.write(merge_source(spark, d), name, S.WriteMode.UPSERT, keys=_KEY)
    if S.layout(spark, name) != ["o_orderstatus"]:
        raise AssertionError("the merge lost the partitioning")
    return S.read(spark, name)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE o_totalprice END AS o_totalprice, o_orderstatus FROM orders WHERE NOT (o_orderstatus = 'F' AND o_totalprice < 50000)")
def table_change_partitions(spark, d):
    """Updates and deletes in a partitioned table."""
    name = f"{_database(spark)}.orders"
    S.write(table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), name, S.WriteMode.OVERWRITE, partition_by=["o_orderstatus"])
    S.delete_from_table(spark, name, "o_orderstatus = 'F' AND o_totalprice < 50000")
    S.update_table(spark, name, {"o_totalprice": F.lit(0)}, "o_orderkey % 5 = 0")
    return S.read(spark, name)


@query(
    _outer(
        _picked(_CHANGED)
        + f""", CASE WHEN t.o_orderkey IS NULL THEN {_NOW} ELSE TIMESTAMP '2020-01-01 00:00:00' END AS created_date,
        CASE WHEN t.o_orderkey IS NULL OR ({_BOTH} AND {_CHANGED}) THEN {_NOW} ELSE TIMESTAMP '2020-01-01 00:00:00' END AS last_modified_date"""
    )
)
def table_merge_audited(spark, d):
    """The first audited merge creates the table, the second changes it."""
    name = f"{_database(spark)}.orders"
    S.write(merge_target(spark, d), name, S.WriteMode.MERGE_AUDITED, keys=_KEY, as_of="2020-01-01 00:00:00")
    S.write(merge_source(spark, d), name, S.WriteMode.MERGE_AUDITED, keys=_KEY, as_of=AS_OF)
    return S.read(spark, name)


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'open' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderstatus <> 'P'")
def table_update_delete(spark, d):
    name = f"{_database(spark)}.orders"
    S.write(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), name, S.WriteMode.APPEND)
    S.update_table(spark, name, {"o_orderstatus": F.lit("open")}, "o_orderstatus = 'O'")
    S.delete_from_table(spark, name, "o_orderstatus = 'P'")
    return S.read(spark, name)


@query("SELECT event_id, user_id, event_type, value FROM events")
def csv_events(spark, d):
    """All events as CSV files and back."""
    path = working_dir(spark, "csv")
    events = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    events.write.csv(path, header=True)
    return S.read_csv(spark, path, "event_id bigint, user_id bigint, event_type string, value double")


@query("SELECT c_custkey AS customer_key, c_mktsegment FROM customer WHERE c_custkey IS NOT NULL")
def silver_job_customers(spark, d):
    """Bronze table to silver table, with a check that holds."""
    base = _database(spark)
    S.write(table(spark, d, "customer"), f"{base}.bronze", S.WriteMode.APPEND)
    options = {
        "table_name": "customer",
        "rename_columns": [{"original_name": "c_custkey", "new_name": "customer_key"}],
        "select_columns": ["customer_key", "c_mktsegment"],
    }
    checks = [Q.Check("not_null", {"column": "customer_key"}, "has_key"), Q.Check("row_count_between", {"min": 1, "max": 10**12}, "rows")]
    silver_job(spark, f"{base}.bronze", f"{base}.silver", options, checks)
    return S.read(spark, f"{base}.silver")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P'")
def gate_quarantine(spark, d):
    """A gate that closes: the bad rows are in the quarantine table."""
    base = _database(spark)
    S.write(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), f"{base}.orders", S.WriteMode.APPEND)
    checks = [Q.Check("is_in_list", {"column": "o_orderstatus", "allowed": ["O", "F", None]}, "status")]
    try:
        check_table(spark, f"{base}.orders", checks, f"{base}.bad")
    except ValueError:
        return S.read(spark, f"{base}.bad").select("o_orderkey", "o_totalprice")
    raise AssertionError("the gate let bad rows pass")


@query("SELECT CAST(count(*) AS BIGINT) AS rows, 0 AS problems FROM lineitem")
def observed_rows(spark, d):
    """Rows counted while they are written, and the schema as expected."""
    name = f"{_database(spark)}.lineitem"
    counted, seen = Q.observed(table(spark, d, "lineitem"), "written")
    S.write(counted, name, S.WriteMode.OVERWRITE)
    problems = Q.schema_problems(S.read(spark, name), {"l_orderkey": "long", "l_quantity": "double"})
    return spark.range(1).select(F.lit(seen.get["rows"]).cast("bigint").alias("rows"), F.lit(len(problems)).alias("problems"))
