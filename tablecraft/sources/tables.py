"""Reading and writing catalog tables and Parquet paths."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from datetime import datetime
from enum import Enum
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecraft.operators.merge import (
    DeleteMode,
    Expression,
    MergeConfig,
    audited_upsert,
    delete_rows,
    merge_with_config,
    merge_with_keys,
    update_rows,
)
from tablecraft.session import working_dir


class WriteMode(Enum):
    APPEND = "append"
    OVERWRITE = "overwrite"
    MERGE = "merge"
    MERGE_CDC = "merge_cdc"
    UPSERT = "upsert"
    MERGE_AUDITED = "merge_audited"


def read(spark: SparkSession, table: str, options: Mapping[str, str] | None = None) -> DataFrame:
    """A catalog table, or a Parquet path when the name contains a slash."""
    reader = spark.read.options(**(options or {}))
    return reader.parquet(table) if "/" in table else reader.table(table)


def read_csv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """CSV files with a declared schema; a broken row fails the job."""
    return spark.read.csv(path, schema=schema, header=header, mode="FAILFAST")


def _laid_out(df: DataFrame, partition_by: Sequence[str]) -> DataFrame:
    """Gather the rows of a partition value, in files of even size.

    Rebalancing splits a large value over several tasks and joins small ones,
    which a plain repartition by the value would not.
    """
    return df.hint("rebalance", *partition_by) if partition_by else df


def create_table(
    spark: SparkSession,
    name: str,
    like: DataFrame,
    partition_by: Sequence[str] = (),
    properties: Mapping[str, str] | None = None,
) -> bool:
    """Create an empty Parquet table with the schema of ``like`` unless it exists."""
    if spark.catalog.tableExists(name):
        return False
    writer = like.limit(0).write.format("parquet")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.saveAsTable(name)
    _set_properties(spark, name, properties or {})
    return True


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _set_properties(spark: SparkSession, name: str, properties: Mapping[str, str]) -> None:
    if properties:
        pairs = ", ".join(f"{_quoted(k)} = {_quoted(v)}" for k, v in properties.items())
        spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ({pairs})")


def _properties(spark: SparkSession, name: str) -> dict[str, str]:
    """The properties a user has set; Spark keeps its own under reserved names."""
    if not spark.catalog.tableExists(name):
        return {}
    found = spark.sql(f"SHOW TBLPROPERTIES {name}").collect()
    return {r["key"]: r["value"] for r in found if not r["key"].startswith(("transient", "spark.sql", "option."))}


def layout(spark: SparkSession, name: str) -> list[str]:
    """The columns a table is partitioned by; none where there is no such table."""
    if not spark.catalog.tableExists(name):
        return []
    return [c.name for c in spark.catalog.listColumns(name) if c.isPartition]


def overwrite(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> None:
    """Replace a table and its schema, also when ``df`` reads that table; its properties and its partitioning stay.

    Spark refuses to overwrite a table it is reading. The new rows then go to a
    table beside it, which takes the old one's place when it is complete; the
    old one goes last. The places of partitions don't follow a new name, so
    those rows are copied back.
    """
    spark = df.sparkSession
    properties = _properties(spark, name)
    partition_by = list(partition_by) or [c for c in layout(spark, name) if c in df.columns]

    def replace(place: str, rows: DataFrame = df) -> None:
        writer = _laid_out(rows, partition_by).write.format("parquet").mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.saveAsTable(place)

    try:
        replace(name)
    except AnalysisException as error:
        if not (error.getCondition() or "").startswith("UNSUPPORTED_OVERWRITE"):
            raise
        staged, old = f"{name}__staged", f"{name}__old"
        replace(staged)
        if partition_by:
            replace(name, spark.table(staged))
            spark.sql(f"DROP TABLE {staged}")
        else:
            spark.sql(f"DROP TABLE IF EXISTS {old}")
            spark.sql(f"ALTER TABLE {name} RENAME TO {old}")
            spark.sql(f"ALTER TABLE {staged} RENAME TO {name}")
            spark.sql(f"DROP TABLE {old}")
    _set_properties(spark, name, properties)


def _partitions(df: DataFrame, columns: Sequence[str]) -> set[tuple]:
    """The partitions that rows belong to: at most as many as the catalog lists for a table."""
    return {tuple(r) for r in df.select(*columns).distinct().collect()}


def _within(columns: Sequence[str], partitions: set[tuple]) -> Column:
    """Whether a row belongs to one of the partitions; a form that prunes the others from a scan."""
    if not partitions:
        return F.lit(False)
    if len(columns) == 1:
        known = [v for (v,) in partitions if v is not None]
        found = F.col(columns[0]).isin(known) if known else F.lit(False)
        return found | F.col(columns[0]).isNull() if len(known) < len(partitions) else found
    one = [reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lit(v)) for c, v in zip(columns, p)]) for p in partitions]
    return reduce(lambda a, b: a | b, one)


def _partition_spec(columns: Sequence[str], partition: tuple) -> str:
    shown = [("null" if v is None else _quoted(str(v).lower() if isinstance(v, bool) else str(v))) for v in partition]
    return ", ".join(f"`{c}` = {v}" for c, v in zip(columns, shown))


def change_partitions(
    spark: SparkSession, name: str, touched: DataFrame, change: Callable[[DataFrame], DataFrame]
) -> None:
    """Replace the partitions that ``touched`` names by what ``change`` makes of their rows; all other files stay.

    The changed rows are first written beside the table. Those that belong to a
    partition that was not read are appended to it, then the read ones are
    replaced, and those left without a row are dropped: a job that dies in
    between has lost no row, and the same merge again gives the same table.
    Columns the table lacks are added.
    """
    columns = layout(spark, name)
    target = spark.table(name)
    read_ones = _partitions(touched, columns)
    changed = change(target.where(_within(columns, read_ones)))
    types = {f.name: f.dataType for f in target.schema.fields}
    if any(types.get(f.name, f.dataType) != f.dataType for f in changed.schema.fields) or not {*types} <= {*changed.columns}:
        raise ValueError(f"the rows of {name} may gain columns, but not change or lose any")
    place = working_dir(spark, "changed-partitions")
    changed.write.parquet(place)
    staged = spark.read.schema(changed.schema).parquet(place)
    made = _partitions(staged, columns)
    _add_columns(spark, name, changed)
    order = spark.table(name).columns

    def insert(rows: DataFrame, overwrite: bool) -> None:
        _laid_out(rows.select(*order), columns).write.insertInto(name, overwrite=overwrite)

    if made - read_ones:
        insert(staged.where(_within(columns, made - read_ones)), overwrite=False)
    if made & read_ones:
        mode = "spark.sql.sources.partitionOverwriteMode"
        before = spark.conf.get(mode)
        spark.conf.set(mode, "dynamic")
        try:
            insert(staged.where(_within(columns, made & read_ones)), overwrite=True)
        finally:
            spark.conf.set(mode, before)
    for gone in read_ones - made:
        spark.sql(f"ALTER TABLE {name} DROP IF EXISTS PARTITION ({_partition_spec(columns, gone)})")


def _add_columns(spark: SparkSession, name: str, df: DataFrame) -> None:
    known = spark.table(name).columns
    added = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name not in known)
    if added:
        spark.sql(f"ALTER TABLE {name} ADD COLUMNS ({added})")


def append_rows(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of both, with the columns of both; nulls where a side lacks one."""
    return existing.unionByName(new, allowMissingColumns=True)


def append(df: DataFrame, name: str, partition_by: Sequence[str] = (), merge_schema: bool = True) -> None:
    """Append to a table, adding columns the table lacks when ``merge_schema`` is set."""
    spark = df.sparkSession
    if not spark.catalog.tableExists(name):
        create_table(spark, name, df, partition_by)
    table = spark.table(name)
    new = [f for f in df.schema.fields if f.name not in table.columns]
    if new and not merge_schema:
        raise ValueError(f"{name} lacks columns {[f.name for f in new]}")
    if new:
        _add_columns(spark, name, df)
        table = spark.table(name)
    aligned = df.withColumns(
        {f.name: F.lit(None).cast(f.dataType) for f in table.schema.fields if f.name not in df.columns}
    )
    _laid_out(aligned.select(*table.columns), partition_by).write.insertInto(name)


def write(
    df: DataFrame,
    name: str,
    mode: WriteMode,
    *,
    partition_by: Sequence[str] = (),
    keys: Sequence[str] = (),
    config: MergeConfig | None = None,
    merge_schema: bool = True,
    as_of: str | datetime | Column | None = None,
) -> None:
    """Append to, overwrite or merge into a table.

    A merge by keys without ``keys`` uses those in the table's ``primary_key`` property (names joined by commas).
    An audited merge creates the table when it is absent, adds and backfills its audit columns, and stamps ``as_of``.
    """
    if mode is WriteMode.APPEND:
        append(df, name, partition_by, merge_schema)
    elif mode is WriteMode.OVERWRITE:
        overwrite(df, name, partition_by)
    else:
        spark = df.sparkSession
        create_table(spark, name, df, partition_by)
        target = spark.table(name)
        if mode is WriteMode.MERGE_CDC:
            if config is None:
                raise ValueError("merge_cdc needs a MergeConfig")
            keys = list(config.join_fields)

            def merged(rows: DataFrame) -> DataFrame:
                return merge_with_config(rows, df, config, with_schema_evolution=merge_schema, as_of=as_of)

        elif mode is WriteMode.MERGE_AUDITED:
            keys = _keys_of(spark, name, keys)

            def merged(rows: DataFrame) -> DataFrame:
                return audited_upsert(df, rows, keys, as_of)

        else:
            keys = _keys_of(spark, name, keys)

            def merged(rows: DataFrame) -> DataFrame:
                return merge_with_keys(rows, df, keys, with_schema_evolution=merge_schema)

        columns = layout(spark, name)
        # Audit columns that the table lacks are filled in all of its rows; a hard delete drops all rows without a source row.
        whole = mode is WriteMode.MERGE_AUDITED and not {"created_date", "last_modified_date"} <= {*target.columns}
        whole = whole or (mode is WriteMode.MERGE_CDC and config.delete_mode is DeleteMode.HARD)
        if columns and not whole:
            change_partitions(spark, name, matched_partitions(target, df, keys, columns), merged)
        else:
            overwrite(merged(target), name, partition_by)


def matched_partitions(target: DataFrame, source: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The partitions of a target that hold a key of the source."""
    asked = source.select(*keys).distinct()
    return target.select(*dict.fromkeys([*keys, *columns])).join(asked, list(keys), "left_semi").select(*columns)


PRIMARY_KEY = "primary_key"


def _keys_of(spark: SparkSession, name: str, keys: Sequence[str]) -> list[str]:
    """The given keys, else those the table's properties name."""
    named = _properties(spark, name).get(PRIMARY_KEY, "")
    found = list(keys) or [k.strip() for k in named.split(",") if k.strip()]
    if not found:
        raise ValueError(f"no keys given, and {name} names none in its property {PRIMARY_KEY}")
    return found


def update_table(
    spark: SparkSession,
    name: str,
    set_expr: Mapping[str, Expression],
    condition: Expression | None = None,
    partition_by: Sequence[str] = (),
) -> None:
    """Set columns of a table's rows where the condition is true, of all rows without one."""
    _change_rows(spark, name, condition, partition_by, lambda rows: update_rows(rows, set_expr, condition))


def delete_from_table(
    spark: SparkSession, name: str, condition: Expression | None = None, partition_by: Sequence[str] = ()
) -> None:
    """Drop a table's rows where the condition is true, all rows without one."""
    _change_rows(spark, name, condition, partition_by, lambda rows: delete_rows(rows, condition))


def _change_rows(
    spark: SparkSession, name: str, condition: Expression | None, partition_by: Sequence[str], change: Callable[[DataFrame], DataFrame]
) -> None:
    """Change a table's rows; of a partitioned one, only the partitions with a row where the condition is true."""
    columns = layout(spark, name)
    if condition is None or not columns or list(partition_by) not in ([], columns):
        overwrite(change(spark.table(name)), name, partition_by)
    else:
        found = spark.table(name).where(F.expr(condition) if isinstance(condition, str) else condition)
        change_partitions(spark, name, found, change)
