"""How filters interact: what each one removes alone, after others, and in every order.

Method: the rows of each part are numbered by id. Every filter has, per part and range of numbers, a posting list: the
sorted numbers of the rows that fail it; so have the rows marked good and toxic. A range bounds what a task holds, however
large its part. Within a range all lists are merged at once: the merge gallops, by doubling steps and a binary search,
over the rows of one list up to the next row of any other. That gives the size of each pattern of lists; the sizes of all
unions and differences are sums of these, added up over ranges. What a step of an order removes is the difference of its
filter's lists and the union of those before it.

Defined results: a null text is empty; a null part is the empty string; rows that repeat an id are counted one by one and
share its marks; of labels that repeat an id the largest counts; a row without an id has no marks and repeats no row; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations, permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecraft.llm.common import discard, keep, numbered

BLANK = r"[\x20\x09-\x0D]+"
# A text in more rows than this share of an average task's is joined by broadcasting.
HOT_SHARE = 0.25
# Rows of a part whose numbers make one range.
RANGE_ROWS = 1024


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions of four filters on a text: too short, too repetitive, too many capitals, odd symbols."""
    words = F.filter(F.split(text, BLANK), lambda w: w != "")
    count, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": count < 200,
        "B": 100 * distinct < 50 * count,
        "C": 100 * capitals > 2 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def repeats(df: DataFrame, id_col: str, key_col: str) -> DataFrame:
    """``df`` (stored) with ``repeats``: whether a smaller id has the same key anywhere in the table.

    Keys of many rows are few, and sent to every task; the others are joined by key.
    """
    groups = df.groupBy(key_col).agg(F.min(id_col).alias("__least"), F.count("*").alias("__rows"))
    groups = keep(groups.filter("__rows > 1").withColumnRenamed(key_col, "__key"), "equal-texts")
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    limit = int(HOT_SHARE * df.count() / width) + 1
    # At most width / HOT_SHARE keys have more rows.
    hot = F.broadcast(groups.filter(F.col("__rows") > limit).select("__key", "__least"))
    same = F.col(key_col) == F.col("__key")
    rest = df.join(hot, same, "left_anti").join(groups.filter(F.col("__rows") <= limit).select("__key", "__least"), same, "left")
    repeated = F.coalesce(F.col(id_col) > F.col("__least"), F.lit(False)).alias("repeats")
    return df.join(hot, same).select(*df.columns, repeated).union(rest.select(*df.columns, repeated))


def gallop(values: np.ndarray, target: int, at: int) -> int:
    """First place from ``at`` on with a value of at least ``target``: doubling steps, then a binary search."""
    step, end = 1, len(values)
    while at + step < end and values[at + step] < target:
        at += step
        step *= 2
    return at + int(np.searchsorted(values[at : min(at + step + 1, end)], target))


def pattern_sizes(lists: list[np.ndarray]) -> dict[int, int]:
    """Sizes of the intersection patterns (bit n: in list n) of sorted lists without repeats, by one merge of all."""
    sizes: dict[int, int] = {}
    at = [0] * len(lists)
    heads = {n: int(own[0]) for n, own in enumerate(lists) if len(own)}
    while heads:
        least = min(heads.values())
        among = [n for n, head in heads.items() if head == least]
        pattern = sum(1 << n for n in among)
        if len(among) == 1:
            own = among[0]
            others = [head for n, head in heads.items() if n != own]
            to = gallop(lists[own], min(others), at[own]) if others else len(lists[own])
            count = to - at[own]
            at[own] = to
        else:
            count = 1
            for n in among:
                at[n] += 1
        sizes[pattern] = sizes.get(pattern, 0) + count
        for n in among:
            if at[n] < len(lists[n]):
                heads[n] = int(lists[n][at[n]])
            else:
                del heads[n]
    return sizes


def posting_lists(df: DataFrame, part_col: str, id_col: str, members: dict[str, Column]) -> DataFrame:
    """(part, range, n_rows, and a sorted list of row numbers for each of ``members``)."""
    flags = [F.coalesce(c, F.lit(False)).alias(f"in_{name}") for name, c in members.items()]
    plain = df.select(F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(id_col).alias("id"), *flags)
    rows = numbered(plain, ["part"], ["id"], "number")
    lists = [F.sort_array(F.collect_list(F.when(F.col(f"in_{name}"), F.col("number")))).alias(name) for name in members]
    return rows.groupBy("part", F.floor(F.col("number") / RANGE_ROWS).alias("range")).agg(F.count("*").alias("n_rows"), *lists)


def _merged(names: list[str]) -> callable:
    """Pattern sizes of ranges; pattern 0 is the rows in no list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            columns = [batch.column(name) for name in names]
            for n, (part, rows) in enumerate(zip(batch.column("part").to_pylist(), batch.column("n_rows").to_pylist(), strict=True)):
                sizes = pattern_sizes([column[n].values.to_numpy() for column in columns])
                out += [(part, pattern, size) for pattern, size in sizes.items()]
                out.append((part, 0, rows - sum(sizes.values())))
            cells = list(zip(*out, strict=True)) if out else [[]] * 3
            kinds = (pa.string(), pa.int32(), pa.int64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], ["part", "pattern", "size"])

    return run


def patterns(lists: DataFrame, names: list[str]) -> DataFrame:
    """(part, pattern, size): rows of each part by the lists they are in, one bit each in the order of ``names``."""
    found = lists.select("part", "n_rows", *names).mapInArrow(_merged(names), "part string, pattern int, size long")
    return found.groupBy("part", "pattern").agg(F.sum("size").alias("size"))


def every_order(sizes: DataFrame, names: str, good: int, toxic: int) -> DataFrame:
    """Counts per part, order and step from pattern sizes; ``good`` and ``toxic`` are the bits of the two marks.

    One aggregation gives, per part, what each filter removes after each set of others; orders are looked up from it.
    """
    spark, every = sizes.sparkSession, range(len(names))
    pattern, size = F.col("pattern"), F.col("size")
    cells, steps = [], []
    for own in every:
        others = [n for n in every if n != own]
        for count in range(len(names)):
            for before in combinations(others, count):
                cells.append((own, sum(1 << n for n in before), factorial(count) * factorial(len(names) - 1 - count)))
    for order in permutations(every):
        done = 0
        for step, own in enumerate(order):
            steps.append(("".join(names[n] for n in order), step + 1, own, done))
            done |= 1 << own
    fails = lambda n: pattern.bitwiseAND(F.lit(1 << n)) != 0
    # What a filter removes after a set of others, and how many orders have it there: a fixed list.
    listed = F.array(*[F.struct(F.lit(own).alias("own"), F.lit(done).alias("done"), F.lit(orders).alias("orders")) for own, done, orders in cells])
    met = sizes.select("part", "pattern", "size", F.explode(listed).alias("cell")).select("part", "pattern", "size", "cell.*")
    own_fails = F.expr("(pattern & shiftleft(1, own)) != 0")
    earlier = F.expr("(pattern & done) != 0")
    removed = own_fails & ~earlier
    filters = (1 << len(names)) - 1
    alone = own_fails & (F.expr(f"pattern & {filters}") == F.expr("shiftleft(1, own)"))
    total = lambda condition: F.sum(F.when(condition, size).otherwise(0))
    cell = met.groupBy("part", "own", "done", "orders").agg(
        total(~own_fails & ~earlier).alias("kept"),
        total(removed).alias("removed"),
        total(own_fails & earlier).alias("redundant"),
        total(alone).alias("unique_fails"),
        total(removed & fails(good)).alias("good_lost"),
        total(removed & fails(toxic)).alias("toxic_lost"),
    )
    shares = cell.groupBy("part", "own").agg(F.sum(F.col("removed") * F.col("orders")).alias("shapley"))
    step_rows = spark.createDataFrame(steps, "filter_order string, step int, own int, done int")
    counts = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return (
        cell.join(shares, ["part", "own"])
        .join(F.broadcast(step_rows), ["own", "done"])
        .select("part", "filter_order", "step", *[F.col(c).cast("long").alias(c) for c in counts])
    )


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """The five filters in all 120 orders per part: one row per part, order and step.

    Filters: A to D of ``text_filters``, and E, a text equal to that of a smaller id. Counts: kept after the step, removed
    by it, redundant (fails it, removed before), unique_fails (fails it alone), good_lost and toxic_lost (removed by it and
    so labelled), shapley (removed by its filter, summed over all orders).
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    plain = docs.select(F.col(id_col).alias("id"), F.col(part_col).alias("part"), text.alias("text"))
    failures = text_filters(F.col("text"))
    same = F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("same")
    facts = keep(plain.select("id", "part", same, *[c.alias(name) for name, c in failures.items()]), "audited")
    marks = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    )
    marked = repeats(facts, "id", "same").withColumnRenamed("repeats", "E").join(marks, F.col("id") == F.col("__id"), "left")
    names = [*failures, "E", "good", "toxic"]
    lists = keep(posting_lists(marked, "part", "id", {name: F.col(name) for name in names}), "posting-lists")
    sizes = keep(patterns(lists, names), "patterns")
    discard(facts)
    discard(lists)
    return every_order(sizes, "ABCDE", 5, 6)


# DuckDB: the same counts from one row per document, part, order and step.
AUDIT_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents
), words AS (
  SELECT doc_id, part, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM texts
), first_ids AS (
  SELECT text, min(doc_id) AS least FROM texts GROUP BY text
), marks AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id
), facts AS (
  SELECT w.part, coalesce(m.good, 0) AS good, coalesce(m.toxic, 0) AS toxic,
    (CASE WHEN len(words) < 200 THEN 1 ELSE 0 END)
    + (CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * length(regexp_replace(w.text, '[^A-Z]', '', 'g')) > 2 * length(w.text) THEN 4 ELSE 0 END)
    + (CASE WHEN regexp_matches(w.text, '[#$%&*|]') THEN 8 ELSE 0 END)
    + (CASE WHEN w.doc_id > f.least THEN 16 ELSE 0 END) AS fails
  FROM words w JOIN first_ids f ON w.text = f.text LEFT JOIN marks m ON w.doc_id = m.doc_id
), sizes AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM facts GROUP BY part, fails
), filters AS (
  SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS t(name, bit)
), orders AS (
  SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM filters a, filters b, filters c, filters d, filters e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5
), steps AS (
  SELECT filter_order, step, bits[step] AS own, list_sum(bits[1:step]) - bits[step] AS done
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), counted AS (
  SELECT part, filter_order, step, own,
    sum(CASE WHEN fails & own = 0 AND fails & done = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN fails & own <> 0 AND fails & done = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN fails & own <> 0 AND fails & done <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails = own THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN fails & own <> 0 AND fails & done = 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN fails & own <> 0 AND fails & done = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM sizes, steps GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step,
  CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM counted
"""
