"""Benchmark decontamination with spaced seeds.

Fixed masks pick some of the tokens of a stretch and ignore the others, so that a stretch still hashes alike when an
ignored token was replaced. Hashes of the benchmark and of the documents are joined; every hit names a diagonal, an item
laid over a document at one offset. The two texts are compared along the whole diagonal, and its longest stretch in which
at most one in five tokens differs is the overlap.

A document's hashes first meet a bitmap that is filled from all hashes of the benchmark and sized by their number, so only
likely hits, as places, are shuffled; the join itself is on the full hashes. Tokens travel once per item and document
that meet, however many hits they have. Benchmarks of any size are joined the same way.

Tokens are runs of letters and digits in lower case. An overlap is reported when it has at least ``least_tokens`` equal
tokens, or all tokens of a shorter item. Items shorter than a mask are hashed as a whole.

Defined results: null or empty texts and items match nothing; repeated rows match each by themselves; equal rows of one item
id are one item, different texts of one id match by themselves; a null id is reported as null; ids keep their types.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecraft.llm.common import WordHashes, keep, lists, mixed, multiplier, small, without_documents
from tablecraft.operators.sizing import is_small

# Characters beyond ASCII that are no letters or digits, and a table that blanks those within ASCII.
_FOREIGN_MARK = re.compile(r"[^\w\x00-\x7f]")
_BLANKED = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
# Fixed masks of five tokens; 1 counts, 0 is ignored. Twelve tokens with two replaced still agree in one of them.
MASKS = ("11111", "1101011", "11001101")
LEAST_TOKENS = 10
# One in so many tokens of an overlap may differ.
ONE_IN = 5
# Points of the bitmap (bits) for each hash of the benchmark, and at least and at most; at most 32 MB.
POINTS_EACH, LEAST_POINTS, MOST_POINTS = 64, 1 << 16, 1 << 28
# Tokens that a task hashes at once.
HELD_TOKENS = 1 << 15


def tokens(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Hashes of the tokens of a text."""
    if not text:
        return np.empty(0, np.uint64)
    text = text.lower()
    if not text.isascii():
        text = _FOREIGN_MARK.sub(" ", text)
    return hashes.of(text.encode().translate(_BLANKED).split())


def seeds(ids: np.ndarray, masks: list[str]) -> Iterator[tuple[str, np.ndarray]]:
    """For each mask, one hash per place where it fits; the number of a token within the mask counts, not its place."""
    largest = max((m.count("1") for m in masks), default=0)
    ranked = [mixed(ids * multiplier(rank)) for rank in range(largest)] if len(ids) else []
    for mask in masks:
        count = len(ids) - len(mask) + 1
        if count <= 0:
            yield mask, np.empty(0, np.uint64)
            continue
        total = np.full(count, int(mask, 2), np.uint64)
        for rank, at in enumerate(i for i, bit in enumerate(mask) if bit == "1"):
            total += ranked[rank][at : at + count]
        # Sums of spread values are spread.
        yield mask, total


def _item_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        found = [tokens(text, hashes).view(np.int64) for text in batch.column("text").to_pylist()]
        yield pa.record_batch([batch.column("item"), batch.column("item_id"), lists(found, pa.int64())], ["item", "item_id", "tokens"])


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shortest = min(map(len, MASKS))
    for batch in batches:
        columns: list[list[np.ndarray]] = [[], [], []]
        spans = []
        for item, own in zip(batch.column("item").to_pylist(), batch.column("tokens"), strict=True):
            ids = own.values.to_numpy().view(np.uint64)
            masks = [m for m in MASKS if len(m) <= len(ids)] if len(ids) >= shortest else ["1" * len(ids)] * bool(len(ids))
            for mask, found in seeds(ids, masks):
                for column, value in zip(columns, (found.view(np.int64), np.full(len(found), item), np.arange(len(found))), strict=True):
                    column.append(value)
                spans.append(np.full(len(found), len(mask)))
        cells = [np.concatenate(c) if c else np.empty(0, np.int64) for c in (*columns, spans)]
        yield pa.record_batch([pa.array(c.astype(np.int64)) for c in cells], ["seed", "item", "item_at", "span"])


def _hits(bitmap: bytes, lengths: list[int]) -> callable:
    masks = sorted({*MASKS, *("1" * n for n in lengths)})
    points = len(bitmap) * 8

    def found_in(rows: list[int], parts: list[np.ndarray], known: np.ndarray) -> pa.RecordBatch:
        """Likely hits of some documents, whose tokens are hashed as one row; hits across documents don't count."""
        ids = np.concatenate(parts) if parts else np.empty(0, np.uint64)
        ends = np.cumsum([len(p) for p in parts]).astype(np.int64)
        owners, found, places = [], [], []
        for mask, own in seeds(ids, masks):
            hit = np.flatnonzero(known[(own & np.uint64(points - 1)).view(np.int64)])
            doc = np.searchsorted(ends, hit, "right")
            inside = hit + len(mask) <= ends[doc]
            hit, doc = hit[inside], doc[inside]
            owners.append(np.array(rows, np.int64)[doc])
            found.append(own[hit].view(np.int64))
            places.append(hit - (ends[doc] - np.array([len(p) for p in parts], np.int64)[doc]))
        columns = [np.concatenate(c) if c else np.empty(0, np.int64) for c in (owners, found, places)]
        return pa.record_batch([pa.array(c) for c in columns], ["row", "seed", "at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        known = np.unpackbits(np.frombuffer(bitmap, np.uint8), bitorder="little").view(bool)
        rows, parts, held = [], [], 0
        for batch in batches:
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text"), strict=True):
                own = tokens(text.as_py(), hashes)
                rows.append(row)
                parts.append(own)
                held += len(own)
                if held >= HELD_TOKENS:
                    yield found_in(rows, parts, known)
                    rows, parts, held = [], [], 0
        if rows:
            yield found_in(rows, parts, known)

    return run


def longest_stretch(equal: np.ndarray) -> tuple[int, int, int]:
    """The longest stretch, from equal to equal, in which at most one in ``ONE_IN`` differs: from, to, equal places."""
    if not equal.any():
        return 0, 0, 0
    sums = np.concatenate([[0], np.cumsum(np.where(equal, 1, 1 - ONE_IN))])
    # A stretch from i to j is allowed if sums[j] >= sums[i]; the largest such j is found among the maxima from the right.
    highest = np.maximum.accumulate(sums[::-1])[::-1]
    to = np.searchsorted(-highest, -sums, "right") - 1
    start = int((to - np.arange(len(sums))).argmax())
    same = np.flatnonzero(equal[start : to[start]])
    return start + int(same[0]), start + int(same[-1]) + 1, len(same)


def _measured(least_tokens: int) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            docs, items, out = [], [], []
            for n in range(batch.num_rows):
                own = tokens(batch.column("text")[n].as_py(), hashes).view(np.int64)
                for met in batch.column("met")[n].values:
                    item = met["tokens"].values.to_numpy()
                    best = None
                    for shift in met["shifts"].as_py():
                        first, last = max(0, -shift), min(len(item), len(own) - shift)
                        start, to, same = longest_stretch(item[first:last] == own[first + shift : last + shift])
                        if same >= min(least_tokens, len(item)):
                            found = (same, -(first + shift + start), -(first + start), to - start)
                            best = found if best is None else max(best, found)
                    if best:
                        docs.append(n)
                        items.append(met["item_id"])
                        out.append((-best[1], -best[2], best[3], best[0], len(item)))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            kind = batch.schema.field("met").type.value_type.field("item_id").type
            yield pa.record_batch(
                [batch.column("doc_id").take(pa.array(docs, pa.int64())), pa.array([i.as_py() for i in items], kind), *(pa.array(c, pa.int32()) for c in columns)],
                ["doc_id", "item_id", *(f.split()[0] for f in MATCHES.split(", "))],
            )

    return run


MATCHES = "doc_at int, item_at int, length int, equal int, item_length int"


def _bitmap(codes: DataFrame) -> bytes:
    """A bitmap of all seeds: bits are gathered by byte before they reach the driver."""
    wanted = min(max(POINTS_EACH * codes.count(), LEAST_POINTS), MOST_POINTS)
    points = 1 << (wanted - 1).bit_length()
    point = F.pmod(F.col("seed"), F.lit(points))
    cells = codes.select(point.alias("point")).selectExpr("shiftright(point, 3) cell", "shiftleft(1, cast(point % 8 as int)) bit")
    cells = cells.groupBy("cell").agg(F.bit_or("bit").alias("bits"))
    table = np.zeros(points // 8, np.uint8)
    for rows in cells.toLocalIterator(prefetchPartitions=True):
        table[rows["cell"]] = rows["bits"]
    return table.tobytes()


def _sized(df: DataFrame) -> DataFrame:
    """A stored frame marked for broadcasting when its rows and bytes are few."""
    return F.broadcast(df) if is_small(df) else df


def matches(docs: DataFrame, benchmark: DataFrame, least_tokens: int = LEAST_TOKENS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """Overlaps of documents with benchmark items: the longest stretch of each document and item.

    Columns: doc_id, item_id, doc_at and item_at (token where the stretch begins), length, equal (tokens that agree)
    and item_length. ``docs`` is read twice and has to give its rows in the same order, as stored tables do.
    """
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    items = items.filter("text is not null").withColumn("item", F.monotonically_increasing_id())
    items = keep(items.select("item", "item_id", "text").mapInArrow(_item_tokens, f"item long, item_id {item_kind}, tokens array<long>"), "items")
    codes = keep(items.select("item", "tokens").mapInArrow(_item_seeds, "seed long, item long, item_at long, span long"), "seeds")
    shortest = min(map(len, MASKS))
    lengths = [r["span"] for r in codes.filter(F.col("span") < shortest).select("span").distinct().collect()]
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    hits = plain.select("row", "text").mapInArrow(_hits(_bitmap(codes), lengths), "row long, seed long, at long")
    met = hits.join(_sized(codes.select("seed", "item", "item_at")), "seed").select("row", "item", (F.col("at") - F.col("item_at")).cast("int").alias("shift"))
    met = met.groupBy("row", "item").agg(F.collect_set("shift").alias("shifts"))
    met = met.join(_sized(items), "item").groupBy("row").agg(F.collect_list(F.struct("item_id", "tokens", "shifts")).alias("met"))
    met = keep(met, "met")
    # Only the ids of the rows that met an item go out to the documents; their texts then come to the items.
    rows = small(met.select("row"))
    found = plain.join(rows, "row", "left_semi").join(met, "row").select("doc_id", "text", "met")
    return found.mapInArrow(_measured(least_tokens), f"doc_id {kind}, item_id {item_kind}, {MATCHES}")


def clean_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that match an item; rows are judged one by one, whatever their id."""
    numbered = keep(docs.withColumn("__row", F.monotonically_increasing_id()), "documents")
    found = matches(numbered, benchmark, id_col="__row", text_col=text_col, **options).select("doc_id")
    return without_documents(numbered, found, "__row").drop("__row")
