"""K-d tree partitioning of documents into shards of near equal bytes.

Equal texts are one group with the sum of their bytes and the smallest of their metadata; groups are placed, not rows, so
equal texts lie in one shard. All groups start in one cell. A cell that stands for k shards is split along its widest
metadata dimension, so that the two sides get bytes in the proportion of what floor(k / 2) and ceil(k / 2) shards have
room for, until every cell is one shard. Without heavy groups, a split of a cell with an even k is its weighted median.

Heavy groups, those with over a sixteenth of a shard's bytes, would make such cuts coarse. They are at most 16 a shard and
are placed first, the largest first, each in the emptiest shard; the tree fills the room that is left. Only a heavy group
that fits in no shard is cut, by the order of its ids, into as few pieces as fill the shards.

Dimensions are whole numbers from 0 to 65535. Within a dimension, groups with equal values are ordered by a hash of
their text, so a split can cut through a value that holds a third of all rows. Widths are those of the middle nine tenths
of the cell's groups.

The place of a split is found for all cells of a level at once: the bytes of 4096 slices of each cell's range are
summed (partial sums first), the slice that holds the split is divided again, and so on; only sums, cells x slices at
most, and the heavy groups reach the driver. Nothing is sorted or sampled.

Defined results: a null text has no bytes and is equal to an empty one; null metadata is a value of its own; an empty table
gives no rows; rows that repeat an id are rows of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecraft.llm.common import discard, keep, numbered, small

SHARDS = 24
OVERHEAD = 8
SLICE_BITS = 12
ROUNDS = 4
# A key is 16 bits of the dimension above 32 bits of hash.
KEY_BITS = 48
# A group with more than this part of a shard's bytes is placed by itself; a shard may be over its bytes by SLACK for it.
HEAVY_PARTS = 16
SLACK = 0.02


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", overhead: int = OVERHEAD) -> DataFrame:
    """``docs`` with doc_id, size (UTF-8 bytes and ``overhead``), text_crc32 and the hash of the text as its group."""
    text = _text(text_col)
    return docs.withColumns(
        {
            "doc_id": F.col(id_col).cast("long"),
            "size": (F.octet_length(text) + overhead).cast("long"),
            "text_crc32": F.crc32(text),
            "__group": F.xxhash64(text),
        }
    )


def scaled(value: Column, largest: float) -> Column:
    """A number from 0 to ``largest`` as a dimension."""
    return F.least(F.greatest(value / largest, F.lit(0.0)), F.lit(1.0)).cast("double") * 65535


def hashed(value: Column) -> Column:
    """A category as a dimension: its order carries no meaning, equal values are equal."""
    return F.pmod(F.xxhash64(value.cast("string")), F.lit(65536))


def document_dimensions() -> dict[str, Column]:
    """Length (logarithm), language and source."""
    return {
        "length": scaled(F.log2("size"), 40.0),
        "language": hashed(F.coalesce(F.col("lang").cast("string"), F.lit(""))),
        "source": hashed(F.coalesce(F.col("source").cast("string"), F.lit(""))),
    }


def _by_cell(values: list, cell: Column) -> Column:
    return F.array(*[F.lit(v) for v in values])[cell]


def _keys(dims: list[str], axes: list[int]) -> Column:
    """A group's place along the axis of its cell."""
    names = F.array(*[F.col(f"__dim_{d}") for d in dims])
    return F.shiftleft(names[_by_cell(axes, F.col("__cell"))], 32) + F.pmod("__group", F.lit(1 << 32))


def _widest(rows: DataFrame, dims: list[str], cells: int) -> list[int]:
    quantiles = [F.percentile_approx(f"__dim_{d}", [0.05, 0.95], 1000).alias(d) for d in dims]
    found = {r["__cell"]: [r[d][1] - r[d][0] for d in dims] for r in rows.groupBy("__cell").agg(*quantiles).collect()}
    return [max(range(len(dims)), key=lambda i: found.get(c, [0] * len(dims))[i]) for c in range(cells)]


def _splits(groups: DataFrame, dims: list[str], axes: list[int], shards: list[int], lower: list[float]) -> list[int]:
    """For each cell, the key below which it has the share ``lower`` of its bytes, to a thousandth of a shard."""
    cells = len(axes)
    low, bits = [0] * cells, KEY_BITS
    wanted: list[float | None] = [None] * cells
    close, widths = [0.0] * cells, [0] * cells
    keyed = groups.select("__cell", "__bytes", _keys(dims, axes).alias("key"))
    for _ in range(ROUNDS):
        step = bits - SLICE_BITS
        inside = F.col("key") - _by_cell(low, F.col("__cell"))
        slices = (
            keyed.filter((inside >= 0) & (inside < (1 << bits)))
            .groupBy("__cell", F.shiftright(inside, step).alias("slice"))
            .agg(F.sum("__bytes").alias("bytes"))
            .collect()
        )
        by_cell: list[dict[int, int]] = [{} for _ in range(cells)]
        for row in slices:
            by_cell[row["__cell"]][row["slice"]] = row["bytes"]
        for cell, found in enumerate(by_cell):
            if wanted[cell] is None:
                size = sum(found.values())
                close[cell], wanted[cell] = size / shards[cell] / 1000, size * lower[cell]
            target = wanted[cell]
            for number in sorted(found):
                if target < found[number]:
                    break
                target -= found[number]
            else:
                number = max(found, default=0)
                target = found.get(number, 0)
            low[cell] += number << step
            wanted[cell], widths[cell] = target, found.get(number, 0)
        bits = step
        if all(width <= limit for width, limit in zip(widths, close, strict=True)):
            break
    # The last slice goes to the side that then is nearer to its bytes.
    return [at + ((1 << bits) if 2 * rest > width else 0) for at, rest, width in zip(low, wanted, widths, strict=True)]


def _heavy_pieces(heavy: list, target: float, shards: int) -> tuple[list[tuple[int, int, int, int]], list[float]]:
    """Where heavy groups go, as (group, first row, row after the last, shard), and the bytes that each shard then has."""
    load, pieces = [0.0] * shards, []
    for group in sorted(heavy, key=lambda g: (-g["__bytes"], g["__group"])):
        start, rows, each = 0, group["__rows"], group["__bytes"] / group["__rows"]
        while start < rows:
            shard = min(range(shards), key=lambda i: (load[i], i))
            room = target - load[shard]
            fits = (rows - start) * each <= room + target * SLACK
            taken = rows - start if fits else min(max(1, round(room / each)), rows - start)
            pieces.append((group["__group"], start, start + taken, shard))
            load[shard] += taken * each
            start += taken
    return pieces, load


def _tree(groups: DataFrame, dims: list[str], room: list[float]) -> DataFrame:
    """Cells of ``groups`` as shards with bytes in the proportion of their ``room``: (__group, __shard)."""
    current, kept, stored = groups.withColumn("__cell", F.lit(0)), [(0, len(room))], []
    while any(k > 1 for _, k in kept):
        axes = _widest(current, dims, len(kept))
        # Cells in order of their first shard; a cell of one shard has no upper side.
        places, following, lower = [], [], []
        for first, k in kept:
            places.append((len(following), len(following) + (k > 1)))
            following.append((first, k // 2 if k > 1 else 1))
            if k > 1:
                following.append((first + k // 2, k - k // 2))
            below, all_room = sum(room[first : first + max(k // 2, 1)]), sum(room[first : first + k])
            lower.append(below / all_room if all_room else max(k // 2, 1) / k)
        splits = _splits(current, dims, axes, [k for _, k in kept], lower)
        upper = _keys(dims, axes) >= _by_cell(splits, F.col("__cell"))
        lower_cell, upper_cell = (_by_cell([p[side] for p in places], F.col("__cell")) for side in (0, 1))
        # Stored, as the next cells are computed from these several times over.
        current = keep(current.withColumn("__cell", F.when(upper, upper_cell).otherwise(lower_cell)), "cells")
        stored.append(current)
        kept = following
    for old in stored[:-1]:
        discard(old)
    return current.select("__group", _by_cell([first for first, _ in kept], F.col("__cell")).cast("int").alias("__shard"))


Plan = tuple[list[tuple[int, int, int, int]], DataFrame]


def _planned(rows: DataFrame, dims: list[str], shards: int) -> Plan:
    """The pieces of heavy groups, and the shard of every other group, for rows with __group, size and dimensions."""
    groups = keep(
        rows.groupBy("__group").agg(
            F.sum("size").alias("__bytes"), F.count("*").alias("__rows"), *[F.min(f"__dim_{d}").alias(f"__dim_{d}") for d in dims]
        ),
        "groups",
    )
    target = (groups.agg(F.sum("__bytes")).first()[0] or 0) / shards
    is_heavy = F.col("__bytes") > target / HEAVY_PARTS
    heavy = groups.filter(is_heavy).select("__group", "__bytes", "__rows").collect()
    pieces, load = _heavy_pieces(heavy, target, shards)
    return pieces, _tree(groups.filter(~is_heavy), dims, [max(target - used, 0.0) for used in load])


def _placed(rows: DataFrame, plan: Plan, order: str) -> DataFrame:
    """``rows`` (with __group) and their __shard; the rows of a group that is cut go by ``order``."""
    pieces, light = plan
    spark, parts = rows.sparkSession, {}
    for piece in pieces:
        parts.setdefault(piece[0], []).append(piece)
    if not parts:
        return rows.join(light, "__group")
    heavy = small(spark.createDataFrame([(g,) for g in parts], "__group long"))
    out = rows.join(heavy, "__group", "left_anti").join(light, "__group")
    whole = [(g, found[0][3]) for g, found in parts.items() if len(found) == 1]
    if whole:
        out = out.unionByName(rows.join(small(spark.createDataFrame(whole, "__group long, __shard int")), "__group"))
    cut = [piece for found in parts.values() if len(found) > 1 for piece in found]
    if cut:
        ids = small(spark.createDataFrame([(g,) for g in {piece[0] for piece in cut}], "__group long"))
        counted = numbered(rows.join(ids, "__group", "left_semi"), ["__group"], [order], "__n")
        ranges = small(spark.createDataFrame(cut, "__g long, __from long, __to long, __shard int"))
        found = counted.join(
            ranges, (F.col("__group") == F.col("__g")) & (F.col("__n") >= F.col("__from")) & (F.col("__n") < F.col("__to"))
        )
        out = out.unionByName(found.drop("__g", "__n", "__from", "__to"))
    return out


def _measured(docs: DataFrame, dimensions: dict[str, Column] | None, columns: dict) -> tuple[DataFrame, list[str]]:
    dimensions = document_dimensions() if dimensions is None else dimensions
    dims = [c.cast("long").alias(f"__dim_{d}") for d, c in dimensions.items()]
    return keep(sizes(docs, **columns).select("doc_id", "size", "text_crc32", "__group", *dims), "sizes"), list(dimensions)


def partition(docs: DataFrame, shards: int = SHARDS, dimensions: dict[str, Column] | None = None, **columns) -> DataFrame:
    """One row per document: doc_id, size, text_crc32 and shard (0 to ``shards`` - 1)."""
    rows, dims = _measured(docs, dimensions, columns)
    placed = _placed(rows, _planned(rows, dims, shards), "doc_id")
    return placed.select("doc_id", "size", "text_crc32", F.col("__shard").alias("shard"))


def slots(placed: DataFrame, shard_col: str = "shard") -> DataFrame:
    """``placed`` with the place of each row in its shard, gapless from 0, by id."""
    order = [c for c in ("doc_id", "text_crc32", "size") if c in placed.columns]
    return numbered(placed, [shard_col], order, "slot")


def write_shards(
    docs: DataFrame,
    path: str,
    shards: int = SHARDS,
    dimensions: dict[str, Column] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    **columns,
) -> None:
    """Write ``docs`` below ``path``, one folder per shard, without gathering a shard in one task.

    A row finds its shard by its text, so rows that repeat an id are written once each. A column ``shard`` of ``docs``
    gives way to the number of the shard.
    """
    rows, dims = _measured(docs, dimensions, {"id_col": id_col, "text_col": text_col, **columns})
    plan = _planned(rows, dims, shards)
    whole = docs.drop("shard").withColumns({"__group": F.xxhash64(_text(text_col)), "__id": F.col(id_col).cast("long")})
    placed = _placed(whole, plan, "__id").withColumnRenamed("__shard", "shard").drop("__group", "__id")
    placed.hint("rebalance", "shard").write.partitionBy("shard").parquet(path)
