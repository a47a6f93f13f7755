"""Tables, feeds and loaders."""

from __future__ import annotations

from datetime import datetime

import pytest
from helpers import rows
from pyspark.sql import functions as F

from tablecraft.operators.merge import DeleteMode, MergeConfig
from tablecraft.session import working_dir
from tablecraft.sources import feed as feeds
from tablecraft.sources import tables as S


@pytest.fixture
def name(spark, request):
    table = "t_" + "".join(c if c.isalnum() else "_" for c in request.node.name).lower()
    yield table
    spark.sql(f"DROP TABLE IF EXISTS {table}")


@pytest.fixture
def df(spark):
    return spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")


def test_create_table_once(spark, df, name):
    assert S.create_table(spark, name, df, properties={"owner_team": "x"})
    assert not S.create_table(spark, name, df)
    assert spark.table(name).count() == 0
    assert spark.sql(f"SHOW TBLPROPERTIES {name} ('owner_team')").first()["value"] == "x"


def test_overwrite_a_table_from_itself(spark, df, name):
    S.overwrite(df, name)
    S.overwrite(spark.table(name).where("id = 1").withColumn("w", F.lit(5)), name)
    assert rows(S.read(spark, name)) == [(1, "a", 5)]
    assert [t.name for t in spark.catalog.listTables() if t.name.startswith(name)] == [name]


def test_append_adds_columns(spark, df, name):
    S.write(df, name, S.WriteMode.APPEND)
    more = spark.createDataFrame([("x", 3)], "w string, id int")
    S.write(more, name, S.WriteMode.APPEND)
    assert rows(spark.table(name), "id", "v", "w") == [(1, "a", None), (2, "b", None), (3, None, "x")]
    with pytest.raises(ValueError, match="lacks"):
        S.write(more.withColumn("z", F.lit(1)), name, S.WriteMode.APPEND, merge_schema=False)


def test_partitioned_table(spark, df, name):
    S.write(df, name, S.WriteMode.OVERWRITE, partition_by=["v"])
    S.write(df.select("v", "id"), name, S.WriteMode.APPEND)
    assert spark.table(name).where("v = 'a'").count() == 2


def test_merge_modes(spark, df, name):
    S.write(df, name, S.WriteMode.UPSERT, keys=["id"])
    new = spark.createDataFrame([(2, "B"), (3, "c")], df.schema)
    S.write(new, name, S.WriteMode.MERGE, keys=["id"])
    assert rows(spark.table(name)) == [(1, "a"), (2, "B"), (3, "c")]
    config = MergeConfig(["id"], custom_set={"v": "concat(target.v, source.v)"})
    S.write(new, name, S.WriteMode.MERGE_CDC, config=config)
    assert rows(spark.table(name)) == [(1, "a"), (2, "BB"), (3, "cc")]
    with pytest.raises(ValueError, match="MergeConfig"):
        S.write(new, name, S.WriteMode.MERGE_CDC)


def test_read_paths_and_csv(spark, df, tmp_path):
    df.write.parquet(str(tmp_path / "p"))
    assert rows(S.read(spark, str(tmp_path / "p"))) == rows(df)
    (tmp_path / "m.csv").write_text("Number,Name\n1,Kuramon\n2,Pabumon\n")
    assert rows(S.read_csv(spark, str(tmp_path / "m.csv"), "Number int, Name string")) == [(1, "Kuramon"), (2, "Pabumon")]


FEED = "id int, _change_type string, _commit_timestamp timestamp, _commit_version bigint"


@pytest.fixture
def feed(spark):
    return spark.createDataFrame([(i, "insert", datetime(2025, 1, 1 + i), i) for i in range(5)], FEED)


@pytest.fixture
def log(spark):
    data = [(i, datetime(2025, 1, 1 + i), "WRITE") for i in range(5)]
    return spark.createDataFrame(data, "version bigint, timestamp timestamp, operation string")


def test_feed_bounds(feed):
    def ids(df):
        return [r[0] for r in rows(df, "id")]

    assert ids(feeds.from_version(feed, 3)) == [3, 4]
    assert ids(feeds.between(feed, since_version=0, ending_version=1)) == [0, 1]
    assert ids(feeds.between(feed, since_date="2025-01-02 00:00:00", since_version=4, ending_date="2025-01-03 00:00:00")) == [1, 2]
    assert ids(feeds.between(feed)) == [0, 1, 2, 3, 4]


def test_load_tables(df, feed):
    config = {"a": {"table_name": "x", "read_cdc": True}, "b": {"table_name": "y"}}
    loaded = feeds.load_tables(config, lambda n: df, lambda n: feed, starting_version=0)
    assert loaded["a"]["dataframe"].count() == 5 and loaded["b"]["dataframe"] is df
    assert "dataframe" not in config["a"]
    with pytest.raises(ValueError, match="table_name"):
        feeds.load_tables({"a": {}}, lambda n: df)
    with pytest.raises(ValueError, match="read_feed"):
        feeds.load_tables(config, lambda n: df, starting_version=1)


def test_load_targets(df, feed, log):
    target = feed.select(F.lit(3).alias("bronze_commit_version"))
    config = {"a": {"table_name": "x", "target_table_name": "t", "read_cdc": True}}
    read = {"x": df, "t": target}.__getitem__
    bulk = feeds.load_targets(config, read, lambda n: feed, lambda n: log, is_bulk_load=True)
    assert {r["bronze_commit_version"] for r in bulk["a"]["dataframe"].collect()} == {4}
    later = feeds.load_targets(config, read, lambda n: feed, lambda n: log)
    assert rows(later["a"]["dataframe"], "id") == [(3,), (4,)]
    with pytest.raises(ValueError, match="target_table_name"):
        feeds.load_targets({"a": {"table_name": "x", "read_cdc": True}}, read, lambda n: feed, lambda n: log)


def test_incremental_load(feed, log):
    target_log = log.where("version = 2")
    loaded = feeds.load_incremental(
        {"a": {"table_name": "x"}}, "t", lambda n: feed, lambda n: target_log if n == "t" else log
    )
    assert rows(loaded["a"]["dataframe"], "id") == [(2,), (3,), (4,)]
    assert feeds.incremental_feed(feed, log, log.limit(0)).count() == 5
    assert feeds.incremental_feed(feed, log.limit(0), target_log).count() == 5


def test_working_dir_is_the_shared_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    first, second = working_dir(spark, "x"), working_dir(spark, "x")
    assert first.startswith(root) and first != second


def test_overwrite_keeps_properties_and_writes_a_self_reading_table_once(spark):
    from tablecraft.sources import tables as S

    name = "kept_properties"
    rows_of = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    S.create_table(spark, name, rows_of, properties={"owner_team": "it's a \\ team"})
    S.overwrite(rows_of, name)
    S.overwrite(spark.table(name).where("id > 1"), name)
    assert [tuple(r) for r in spark.table(name).collect()] == [(2, "b")]
    found = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}
    assert found["owner_team"] == "it's a \\ team"
    assert not spark.catalog.tableExists(f"{name}__staged")
    spark.sql(f"DROP TABLE {name}")


def files(spark, name, where):
    return {r[0] for r in spark.table(name).where(where).select("_metadata.file_path").distinct().collect()}


@pytest.fixture
def parts(spark, name):
    """A table partitioned by p, one of whose values is null, with keys 0 to 7."""
    rows = [(n, f"v{n}", ["a", "b", None, "it's"][n % 4]) for n in range(8)]
    S.write(spark.createDataFrame(rows, "id int, v string, p string"), name, S.WriteMode.OVERWRITE, partition_by=["p"])
    return {(n, f"v{n}", ["a", "b", None, "it's"][n % 4]) for n in range(8)}


def content(spark, name):
    return {(r.id, r.v, r.p) for r in spark.table(name).collect()}


def test_merge_rewrites_only_matched_partitions(spark, name, parts):
    kept, appended = files(spark, name, "p = 'b'"), files(spark, name, "p = 'it\\'s'")
    source = spark.createDataFrame([(0, "new", "a"), (6, "moved", "it's"), (9, "more", "c")], "id int, v string, p string")
    S.write(source, name, S.WriteMode.UPSERT, keys=["id"])
    want = {r for r in parts if r[0] not in (0, 6)} | {(0, "new", "a"), (6, "moved", "it's"), (9, "more", "c")}
    assert content(spark, name) == want
    assert S.layout(spark, name) == ["p"]
    assert files(spark, name, "p = 'b'") == kept
    assert appended < files(spark, name, "p = 'it\\'s'")
    S.write(source, name, S.WriteMode.UPSERT, keys=["id"])
    assert content(spark, name) == want


def test_merge_adds_columns_to_a_partitioned_table(spark, name, parts):
    source = spark.createDataFrame([(1, "x", "b", 5)], "id int, v string, p string, w int")
    S.write(source, name, S.WriteMode.UPSERT, keys=["id"])
    assert S.layout(spark, name) == ["p"]
    assert rows(spark.table(name).where("w is not null"), "id", "v", "p", "w") == [(1, "x", "b", 5)]
    assert content(spark, name) == {r for r in parts if r[0] != 1} | {(1, "x", "b")}


def test_update_and_delete_keep_partitions(spark, name, parts):
    kept = files(spark, name, "p = 'a'")
    S.update_table(spark, name, {"v": F.lit("z")}, "id = 1")
    S.delete_from_table(spark, name, "p is null")
    S.delete_from_table(spark, name, F.col("id") > 100)
    assert content(spark, name) == {(i, "z" if i == 1 else v, p) for i, v, p in parts if p is not None}
    assert S.layout(spark, name) == ["p"] and files(spark, name, "p = 'a'") == kept
    S.update_table(spark, name, {"p": F.lit("b")}, "id = 0")
    assert (0, "v0", "b") in content(spark, name) and len(content(spark, name)) == 6
    S.update_table(spark, name, {"v": F.lit("all")})
    assert S.layout(spark, name) == ["p"] and {r[1] for r in content(spark, name)} == {"all"}
    S.delete_from_table(spark, name)
    assert spark.table(name).count() == 0


def test_partitions_by_two_columns(spark, name):
    data = [(n, n % 2 == 0, datetime(2025, 1, 1 + n % 3)) for n in range(12)]
    frame = spark.createDataFrame(data, "id int, even boolean, at timestamp").withColumn("day", F.to_date("at")).drop("at")
    S.write(frame, name, S.WriteMode.OVERWRITE, partition_by=["even", "day"])
    kept = files(spark, name, "not even or day <> date'2025-01-01'")
    S.delete_from_table(spark, name, "even and day = date'2025-01-01'")
    assert spark.table(name).count() == 10 and files(spark, name, "true") == kept


def test_cdc_merge_into_partitions(spark, name, parts):
    kept = files(spark, name, "p = 'b'")
    changes = spark.createDataFrame([(0, "d", "a", "delete"), (3, "u", "it's", "update_postimage")], "id int, v string, p string, _change_type string")
    S.write(changes, name, S.WriteMode.MERGE_CDC, config=MergeConfig(["id"], delete_mode=DeleteMode.SOFT), merge_schema=False, as_of="2025-01-01 00:00:00")
    assert content(spark, name) == {(i, "u" if i == 3 else v, p) for i, v, p in parts}
    assert rows(spark.table(name).where("is_deleted"), "id") == [(0,)]
    assert files(spark, name, "p = 'b'") == kept
    S.write(changes, name, S.WriteMode.MERGE_CDC, config=MergeConfig(["id"], delete_mode=DeleteMode.HARD), merge_schema=False)
    assert {r[0] for r in content(spark, name)} == {0, 3} and S.layout(spark, name) == ["p"]
