"""Key-wise operators that hold when one key owns a large share of the rows.

A plain window or join sends all rows of a key to one task. The functions here
first ask which keys are too large for a task. When there are none the plan is
the ordinary one. Otherwise only the large keys are treated: windows cut their
rows into consecutive segments and carry one row per segment across the cuts,
joins salt them. No row is dropped or sampled; a key that is wrongly taken for
large costs time but changes no result.

The question is answered by a frequent-items sketch over a hash of the key: one
pass over the key columns, no shuffle, one small row per task. It finds every
key with more rows than an average shuffle partition, and there are fewer of
those than partitions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_GROUP_ROWS_CONF = "tablecraft.maxGroupRows"
DEFAULT_MAX_GROUP_ROWS = 2_000_000

# Limits of the sketch: counters Spark allows, counters of a small one, groups that merge larger ones.
MAX_COUNTERS = 1_000_000
SMALL_SKETCH = 4096
SKETCH_GROUPS = 64

_SEGMENT = "__segment"
LEFT_SALT = "__left_salt"
RIGHT_SALT = "__right_salt"


def max_group_rows(spark: SparkSession) -> int:
    """Rows of one key that a single task may hold."""
    return int(spark.conf.get(MAX_GROUP_ROWS_CONF, str(DEFAULT_MAX_GROUP_ROWS)))


def _shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def key_hash(keys: Sequence[str]) -> Column:
    """64-bit hash of the key. Collisions only mark a small key as large."""
    return F.xxhash64(*[F.col(k) for k in keys])


def heavy_keys(df: DataFrame, keys: Sequence[str]) -> dict[int, int]:
    """Hashes of the keys with more rows than one task may hold, and how many rows they have.

    A sketch of m counters errs by at most 3.5 / m of all rows, here less than a
    quarter of an average partition. Small sketches meet in one task. Larger
    ones, which a large cluster needs, meet in groups of tasks; each group names
    four times as many keys as there are partitions, so a key it leaves out has
    at most a quarter of an average partition there as well.
    """
    partitions = _shuffle_partitions(df.sparkSession)
    counters = min(16 * partitions, MAX_COUNTERS)
    hashed = df.select(key_hash(keys).alias("h"))
    if counters <= SMALL_SKETCH:
        grouped = hashed.groupBy()
    else:
        grouped = hashed.withColumn("g", F.pmod(F.spark_partition_id(), F.lit(SKETCH_GROUPS))).groupBy("g")
    named = min(4 * partitions, counters)
    top = grouped.agg(F.expr(f"approx_top_k(h, {named}, {max(counters, 1024)})").alias("top"))
    found = (
        top.select(F.explode("top").alias("t"))
        .groupBy("t.item")
        .agg(F.sum("t.count").alias("n"))
        .where(F.col("n") > max_group_rows(df.sparkSession))
        .orderBy(F.col("n").desc(), "item")
        .limit(partitions)
    )
    return {row["item"]: row["n"] for row in found.collect()}


def _pieces(spark: SparkSession, n: int) -> int:
    """How many tasks should share ``n`` rows."""
    return min(_shuffle_partitions(spark), -(-n // max_group_rows(spark)))


def common_type(spark: SparkSession, a: T.DataType, b: T.DataType) -> T.DataType:
    """The type Spark itself would coerce both to; only analysed, nothing runs."""
    if a == b:
        return a
    both = F.coalesce(F.lit(None).cast(a), F.lit(None).cast(b))
    return spark.range(0).select(both.alias("c")).schema["c"].dataType


def _place(df: DataFrame, order: Sequence[str]) -> Column:
    """The order columns as one value that sorts like them; times as numbers, which travel unchanged."""

    def number(name: str) -> Column:
        dtype = df.schema[name].dataType
        if isinstance(dtype, T.TimestampType):
            return F.unix_micros(F.col(name))
        if isinstance(dtype, T.TimestampNTZType):
            return F.unix_micros(F.col(name).cast("timestamp"))
        if isinstance(dtype, T.DateType):
            return F.unix_date(F.col(name)).cast("long")
        return F.col(name)

    return F.struct(*[number(name).alias(f"o{i}") for i, name in enumerate(order)])


# Rows per segment that are looked at to place the cuts.
CUT_SAMPLE = 100


def _cut_points(df: DataFrame, place: Column, is_heavy: Column, n: int) -> list[Column]:
    """Places that part the ``n`` rows of the large keys into about equal shares, one per allowed group.

    The whole order counts, so many rows of one instant are parted as well. A bounded random sample names the cuts;
    they only decide how even the segments are.
    """
    segments = _pieces(df.sparkSession, n)
    if segments < 2:
        return []
    drawn = df.where(is_heavy).select(place.alias("p")).orderBy(F.rand(1)).limit(CUT_SAMPLE * segments)
    rows = [r["p"] for r in drawn.orderBy("p").collect()]
    kind = df.select(place.alias("p")).schema["p"].dataType
    chosen = [rows[i * len(rows) // segments] for i in range(1, segments)] if rows else []
    distinct = [c for i, c in enumerate(chosen) if i == 0 or c != chosen[i - 1]]
    return [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(c, kind.fields)]) for c in distinct]


def _segment_number(position: Column, cuts: list[Column]) -> Column:
    """How many cuts lie below the position, by binary search over the array of cuts."""
    step, steps = 1, []
    while step <= len(cuts):
        steps.append(step)
        step *= 2
    points = F.array(*cuts)

    def descend(low: Column, width: Column) -> Column:
        return F.when(F.try_element_at(points, low + width) < position, low + width).otherwise(low)

    halving = F.array(*[F.lit(s) for s in reversed(steps)])
    return F.aggregate(halving, F.lit(0), descend)


def carry(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: Mapping[str, Column],
    *,
    forward: bool = False,
    include_current: bool = False,
    measured: DataFrame | None = None,
) -> DataFrame:
    """Add, per row, the nearest non-null value before (or after) it within its key.

    ``values`` maps new column names to expressions. The nearest earlier row in
    ``order`` with a non-null value supplies the result, the nearest later one
    when ``forward`` is set; the row itself counts with ``include_current``.
    This covers ``lag`` / ``lead`` of a non-null value, ``last(ignore nulls)``
    and as-of lookups. ``order`` must be total within a key for a stable result.
    """
    ordering = [F.col(c).desc() if forward else F.col(c).asc() for c in order]
    stop = Window.currentRow if include_current else -1

    def nearest(window_keys: list[str]) -> dict[str, Column]:
        w = (
            Window.partitionBy(*[F.col(k) for k in window_keys])
            .orderBy(*ordering)
            .rowsBetween(Window.unboundedPreceding, stop)
        )
        return {name: F.last(value, ignorenulls=True).over(w) for name, value in values.items()}

    heavy = heavy_keys(df if measured is None else measured, keys)
    if not heavy:
        return df.withColumns(nearest(list(keys)))

    is_heavy = key_hash(keys).isin(list(heavy))
    position = _place(df, order)
    cuts = _cut_points(df, position, is_heavy, sum(heavy.values()))
    if not cuts:
        return df.withColumns(nearest(list(keys)))

    segment = F.when(is_heavy, _segment_number(position, cuts)).otherwise(F.lit(0))
    cut = df.withColumn(_SEGMENT, segment)

    # One row per large key and segment: the value nearest to the far end of the
    # segment, then carried over the following segments.
    pick = F.min_by if forward else F.max_by
    rank = F.struct(*[F.col(c) for c in order])
    last_of = [
        pick(F.struct(value.alias("v")), F.when(value.isNotNull(), rank)).alias(name)
        for name, value in values.items()
    ]
    per_segment = cut.where(is_heavy).groupBy(*keys, _SEGMENT).agg(*last_of)
    across = (
        Window.partitionBy(*[F.col(k) for k in keys])
        .orderBy(F.col(_SEGMENT).desc() if forward else F.col(_SEGMENT).asc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    key_names = [f"__carried_key_{i}" for i in range(len(keys))]
    carried = per_segment.select(
        *[F.col(k).alias(n) for k, n in zip(keys, key_names)],
        F.col(_SEGMENT).alias("__segment_of"),
        *[F.last(F.col(name), ignorenulls=True).over(across).alias(f"__carried_{name}") for name in values],
    )

    local = cut.withColumns(nearest([*keys, _SEGMENT]))
    match = F.col(_SEGMENT) == F.col("__segment_of")
    for k, n in zip(keys, key_names):
        match = match & F.col(k).eqNullSafe(F.col(n))
    joined = local.join(carried, match, "left")
    return joined.select(
        *[F.col(c) for c in df.columns if c not in values],
        *[F.coalesce(F.col(name), F.col(f"__carried_{name}.v")).alias(name) for name in values],
    )


def salt_pair(
    left: DataFrame,
    right: DataFrame,
    left_keys: Sequence[str],
    right_keys: Sequence[str],
) -> tuple[DataFrame, DataFrame, bool]:
    """Add matching salt columns when the left side has large keys.

    Rows of a large left key get a salt by their place, so equal rows spread as
    well; only the right rows of those keys are repeated, once per salt. Keys are
    hashed in the type in which the join compares them. Returns the two frames
    and whether ``LEFT_SALT = RIGHT_SALT`` has to be part of the join condition.
    """
    spark = left.sparkSession
    types = [
        common_type(spark, left.schema[k].dataType, right.schema[r].dataType) for k, r in zip(left_keys, right_keys)
    ]

    def compared(keys: Sequence[str]) -> list[Column]:
        return [F.col(f"`{k}`").try_cast(t) for k, t in zip(keys, types)]

    names = [f"__compared_{i}" for i in range(len(types))]
    heavy = heavy_keys(left.select(*[c.alias(n) for c, n in zip(compared(left_keys), names)]), names)
    if not heavy:
        return left, right, False
    hashes = list(heavy)
    n_salts = _pieces(spark, max(heavy.values()))
    place = F.pmod(F.monotonically_increasing_id(), F.lit(n_salts))
    salt = F.when(F.xxhash64(*compared(left_keys)).isin(hashes), place).otherwise(F.lit(0))
    repeats = F.when(
        F.xxhash64(*compared(right_keys)).isin(hashes), F.sequence(F.lit(0), F.lit(n_salts - 1))
    ).otherwise(F.array(F.lit(0)))
    return (
        left.withColumn(LEFT_SALT, salt.cast("int")),
        right.withColumn(RIGHT_SALT, F.explode(repeats)),
        True,
    )


def skew_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    *,
    null_safe: bool = False,
) -> DataFrame:
    """Equi-join on ``keys`` in which large keys of the left side are salted.

    ``how`` is ``left``, ``inner``, ``left_semi`` or ``left_anti``. The key
    columns appear once, as on the left side; other names must differ.
    """
    if how not in {"left", "inner", "left_semi", "left_anti"}:
        raise ValueError(f"unsupported join type: {how}")
    right_keys = [f"__right_{k}" for k in keys]
    right = right.withColumnsRenamed(dict(zip(keys, right_keys)))
    left, right, salted = salt_pair(left, right, keys, right_keys)
    terms = [
        F.col(k).eqNullSafe(F.col(r)) if null_safe else F.col(k) == F.col(r)
        for k, r in zip(keys, right_keys)
    ]
    if salted:
        terms.append(F.col(LEFT_SALT) == F.col(RIGHT_SALT))
    match = reduce(lambda a, b: a & b, terms)
    return left.join(right, match, how).drop(*right_keys, LEFT_SALT, RIGHT_SALT)
