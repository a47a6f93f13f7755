"""Registered queries give the rows of their SQL, on every plan they may take."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import re

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tablecraft.operators.sizing import SMALL_SOURCE_ROWS_CONF
from tablecraft.operators.skew import MAX_GROUP_ROWS_CONF

SF_DIR = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    yield connection
    connection.close()


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, decimal.Decimal):
        return f"{float(value):.9g}"
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return None if value is None else str(value)


def _sorted(records):
    plain = [tuple(_plain(v) for v in r) for r in records]
    return sorted(plain, key=lambda r: tuple((v is not None, v or "") for v in r))


def _compare(spark, duck, name):
    df = queries()[name](spark, SF_DIR)
    columns = sorted(df.columns)
    found = _sorted([[r[c] for c in columns] for r in df.collect()])
    result = duck.execute(oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    expected = _sorted([[r[names.index(c)] for c in columns] for r in result.fetchall()])
    assert found == expected


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    _compare(spark, duck, name)


# Queries whose plan depends on the size of a key or of a merge source.
SIZE_DEPENDENT = [
    "cdc_to_scd", "scd2_merge", "scd2_replay", "feature_asof", "feature_lookback", "feature_lookup", "training_set",
    "missing_keys", "matching_keys", "nearby_places", "dq_quarantine", "dq_unique", "lineage_entities",
    "merge_audited", "merge_keys", "merge_hard_delete", "merge_soft_delete", "merge_condition", "merge_many_per_key",
    "merge_custom_maps", "merge_ignore_nulls", "merge_schema_evolution", "stream_scd2",
]


@pytest.mark.parametrize("name", SIZE_DEPENDENT)
def test_query_with_large_keys_and_large_sources(spark, duck, name):
    spark.conf.set(MAX_GROUP_ROWS_CONF, "5")
    spark.conf.set(SMALL_SOURCE_ROWS_CONF, "-1")
    try:
        _compare(spark, duck, name)
    finally:
        spark.conf.unset(MAX_GROUP_ROWS_CONF)
        spark.conf.unset(SMALL_SOURCE_ROWS_CONF)


def test_every_query_has_sql():
    # Those of the training-data operators and their pipeline are tested against brute force.
    def own(names):
        return {n for n in names if not re.fullmatch(r"op\d+_.*|pipeline", n)}

    assert own(queries()) == own(oracle_sql())


def test_entry(spark):
    assert entry(spark).count() > 0
