"""N-gram Jaccard join with PartEnum signatures.

A document is the set of its distinct word n-grams. Two documents link when the Jaccard similarity of their sets is at
least ``over / under``, compared in whole numbers. Links are exact; signatures only choose which pairs are compared.

Steps, each over stored tables:

1. Equal word sequences form a class; one set stands for it.
2. First look: in one part of the feature domain, count the features that no other class has. A set with more such
   features than a linked partner may lack has no partner, and leaves.
3. PartEnum: sets are banded by size so that linked sets lie in the same or in neighbouring bands. For each band, the
   bound on the symmetric difference fixes a first-level partition of the domain, split again into second-level
   parts; a signature is a subset of the second-level parts of one first-level part. By the pigeonhole principle,
   linked sets share a signature that is not empty, or all their signatures are kept.
4. A few sets that share a signature are compared with each other. More of them make a crowd, and crowds of one band that
   have sets in common make a family. Linked sets of a family share one of their rarer elements there, so places of
   these take the place of signatures: most sets of a family have no partner and are in none of them. What is crowded
   again makes families once more, of sets that are alike, and all sets of such a family are compared with one of them, the
   hub (the set with most company), not with each other: a set has one hub a band, however many crowds it is in. Two sets
   that were compared with one hub need a comparison of their own only if one of them is not linked with it; then their
   differences from the hub overlap, and a prefix of the rarer elements of these differences finds the pair. Crowded places
   in that index get a hub each, so no group is ever compared pair by pair.
5. Links make components.

Features are 64-bit hashes; two different features or word sequences get the same one with a probability of 2^-64 a
pair.

Defined results: null or wordless texts have an empty set and link with nothing; a text with fewer words than n is one
feature; rows that repeat an id are documents of their own that share it; a null id is treated as an id larger than
all others and reported as null.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablecraft.llm.common import WordHashes, discard, keep, lists, mixed, multiplier, small, text_bytes, window_hashes, without_documents
from tablecraft.llm.components import components

# Sets that share a signature and are compared pair by pair; with more, one of them is the hub.
PAIRED_SETS = 6
# Comparisons per member that a place of the index may cost; a place that would cost more gets a hub, and the places
# below it may cost eight times as much, so that this ends after a few rounds.
PAIRED_MEMBERS = 48


def features(text: bytes | None, size: int, hashes: WordHashes) -> tuple[int, int, np.ndarray]:
    """128 bits for the word sequence, as two signed numbers, and the sorted distinct features."""
    words = text.lower().split() if text else []
    if not words:
        return 0, 0, np.empty(0, np.uint64)
    whole = xxhash.xxh3_128_intdigest(b" ".join(words))
    high, low = np.array([whole >> 64, whole & 0xFFFFFFFFFFFFFFFF], np.uint64).view(np.int64).tolist()
    ids = hashes.of(words)
    found = window_hashes(ids, size if len(ids) >= size else len(ids))
    return high, low, np.unique(found)


def _scan(size: int, look: int) -> callable:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            high, low, counts, first = [], [], [], []
            for text in text_bytes(batch, "text"):
                a, b, found = features(text, size, hashes)
                high.append(a)
                low.append(b)
                counts.append(len(found))
                first.append(found[found < np.uint64(look)].view(np.int64))
            yield pa.record_batch(
                [
                    *(batch.column(c) for c in ("doc_id", "text_hash")),
                    *(pa.array(c, pa.int64()) for c in (high, low, counts)),
                    lists(first, pa.int64()),
                ],
                ["doc_id", "text_hash", "high", "low", "n_shingles", "first"],
            )

    return scan


def _sets(size: int) -> callable:
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            high, low, found = [], [], []
            for text in text_bytes(batch, "text"):
                a, b, items = features(text, size, hashes)
                high.append(a)
                low.append(b)
                found.append(items.view(np.int64))
            yield pa.record_batch(
                [batch.column("sid"), batch.column("wanted"), pa.array(high, pa.int64()), pa.array(low, pa.int64()), lists(found, pa.int64())],
                ["sid", "wanted", "high", "low", "items"],
            )

    return sets


def bands(largest: int, over: int, under: int) -> list[tuple[int, int]]:
    """Size bands (from, to): linked sets lie in one band or in two neighbouring ones."""
    out, low = [], 1
    while low <= largest:
        high = low * under // over
        out.append((low, high))
        low = high + 1
    out.append((low, low * under // over))
    return out


def levels(distance: int) -> tuple[int, int, int, int]:
    """First-level parts, spare ones among them, second-level parts and how many of these a signature leaves out.

    Two sets at most ``distance`` apart differ by no more than the left out number in one first-level part, and in as
    many more as are spare.
    """
    if distance <= 2:
        return distance + 1, 0, 1, 0
    needed = distance // 2 + 1
    return needed + needed // 8, needed // 8, 3, 1


def part_signatures(items: np.ndarray, band: int, distance: int) -> np.ndarray:
    """The signatures of a set in one band: any two sets at most ``distance`` apart share one.

    Signatures of no element say nothing. A set in which they come from no more first-level parts than are spare leaves
    them out: one part more than that agrees with a partner, so they share another signature of this set, and the
    partner, which has the same elements there, has it as well.
    """
    first, spare, second, left_out = levels(distance)
    spread = mixed(items + multiplier(7 + band))
    part = ((spread >> np.uint64(32)) * np.uint64(first)) >> np.uint64(32)
    inner = ((spread & np.uint64(0xFFFFFFFF)) * np.uint64(second)) >> np.uint64(32)
    sums = np.zeros(first * second, np.uint64)
    np.add.at(sums, (part * np.uint64(second) + inner).astype(np.int64), mixed(items))
    sums = sums.reshape(first, second)
    base = mixed(np.arange(first, dtype=np.uint64) + np.uint64(band << 32))
    out, empty = [], []
    for number, chosen in enumerate(combinations(range(second), second - left_out)):
        total = base + np.uint64(number)
        for at in chosen:
            total = mixed(total + sums[:, at] * multiplier(at))
        out.append(total)
        empty.append((sums[:, list(chosen)] == 0).all(1))
    out, empty = np.stack(out), np.stack(empty)
    return out[~empty] if empty.any(0).sum() <= spare else out.ravel()


def band_signatures(items: np.ndarray, over: int, under: int, limits: list[tuple[int, int]]) -> Iterator[tuple[int, np.ndarray]]:
    """Bands and the PartEnum signatures of a set there: its own band and, where a larger partner may lie there, the next."""
    size = len(items)
    own = int(np.searchsorted([low for low, _ in limits], size, side="right")) - 1
    for band in (own, own + 1):
        if band == own or size * under // over >= limits[band][0]:
            distance = (under - over) * 2 * limits[band][1] // (under + over)
            yield band, part_signatures(items, band, distance)


def signatures(items: np.ndarray, over: int, under: int, limits: list[tuple[int, int]]) -> np.ndarray:
    """All PartEnum signatures of a set."""
    return np.concatenate([found for _, found in band_signatures(items, over, under, limits)])


def _signed(over: int, under: int) -> callable:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limits = bands(1, over, under)
        for batch in batches:
            sids = batch.column("sid")
            for at in range(0, len(sids), 512):
                found, owners, of_band = [], [], []
                column = batch.column("items").slice(at, 512)
                for sid, items in zip(sids.slice(at, 512).to_pylist(), column, strict=True):
                    values = items.values.to_numpy().view(np.uint64)
                    if len(values) >= limits[-1][0]:
                        limits = bands(2 * len(values), over, under)
                    for band, own in band_signatures(values, over, under, limits):
                        found.append(own)
                        owners.append(np.full(len(own), sid, np.int64))
                        of_band.append(np.full(len(own), band, np.int32))
                columns = (np.concatenate(found).view(np.int64), np.concatenate(owners), np.concatenate(of_band))
                yield pa.record_batch(list(map(pa.array, columns)), ["place", "sid", "band"])

    return sign


def _crowds(places: DataFrame) -> DataFrame:
    """Rows (place, sid, band) of the places that hold two sets or more, with the number of sets."""
    counts = places.groupBy("place").agg(F.count("*").alias("company")).filter("company > 1")
    return keep(places.join(counts, "place"), "crowds")


def _families(crowds: DataFrame) -> DataFrame:
    """Sets of each band with their company and the ``component`` of crowds that have sets in common."""
    member = F.xxhash64("band", "sid")
    company = crowds.groupBy("band", "sid").agg(F.sum("company").alias("company")).withColumn("node", member)
    nodes = crowds.select("place", member.alias("node"))
    least = nodes.groupBy("place").agg(F.min("node").alias("least"))
    families = keep(components(nodes.join(least, "place"), "node", "least"), "families")
    return company.join(families, "node")


def _family_spokes(crowds: DataFrame) -> DataFrame:
    """Each set beside the hub of its family, the set with most company there; at most one hub per set and band.

    Sets that share a place are in one family. The sizes in a band are close, so the hub is as large as its sets, about.
    """
    company = _families(crowds)
    hubs = company.groupBy("component").agg(F.max_by("sid", F.struct("company", "sid")).alias("hub"))
    return company.join(hubs, "component").filter("sid != hub").select("hub", "sid").distinct()


def _rare_crowds(crowds: DataFrame, sets: DataFrame, over: int, under: int) -> DataFrame:
    """Crowds of the same form, by rare elements: linked sets that share a place share one of these.

    A set has at least ``over / under`` of its elements in common with a partner, which is in its family. So the elements
    that a family has most often, one fewer than that share, can't be all that they have in common: one of the rarer ones
    is. A set that has too few elements in common with its whole family is in no crowd.
    """
    families = _families(crowds).select("component", "band", "sid")
    rows = families.join(sets, "sid").select(
        "component",
        "band",
        "sid",
        F.ceil(F.size("items") * F.lit(over) / F.lit(under)).alias("needed"),
        F.explode("items").alias("element"),
    )
    rows = keep(rows, "family-elements")
    counts = rows.groupBy("component", "element").agg(F.count("*").alias("often")).filter("often > 1")
    ranked = Window.partitionBy("component", "sid").orderBy(F.desc("often"), F.desc("element"))
    return _crowds(
        rows.join(counts, ["component", "element"])
        .withColumn("rank", F.row_number().over(ranked))
        .filter("rank >= needed")
        .select(F.xxhash64("component", "element").alias("place"), "sid", "band")
    )


def _spokes(crowds: DataFrame) -> DataFrame:
    """Each set of a place beside the hub of the place: the set with most company over all places."""
    company = crowds.groupBy("sid").agg(F.sum("company").alias("company"))
    hubs = (
        crowds.select("place", "sid")
        .join(company, "sid")
        .groupBy("place")
        .agg(F.max_by("sid", F.struct("company", "sid")).alias("hub"))
    )
    return crowds.join(hubs, "place").filter("sid != hub").select("hub", "sid").distinct()


def _compared(pairs: DataFrame, sets: DataFrame, over: int, under: int, differences: bool) -> DataFrame:
    """Pairs (hub, sid) with ``linked`` and, if wanted, the elements in which the two sets differ."""
    left = sets.select(F.col("sid").alias("hub"), F.col("items").alias("hub_items"))
    both = pairs.join(left, "hub").join(sets, "sid")
    added = F.array_except("items", "hub_items")
    both = both.select(
        "hub",
        "sid",
        F.size("hub_items").alias("hub_size"),
        F.size("items").alias("size"),
        added.alias("added"),
        *([F.array_except("hub_items", "items").alias("removed")] if differences else []),
    )
    common = F.col("size") - F.size("added")
    linked = under * common >= over * (F.col("hub_size") + F.col("size") - common)
    return both.withColumn("linked", linked).drop(*([] if differences else ["added"]))


def _deltas(spokes: DataFrame, over: int, under: int) -> DataFrame:
    """Index rows (hub, element, sid, listed, asks): ``listed`` rows can be found, ``asks`` rows look for partners.

    Let D be the difference of a set from the hub. If x is not linked with the hub but with y, then D(x) and D(y) share
    more than (|D(y)| + c (|hub| - |y|)) / 2 elements, c = (under - over) / (under + over). So each set lists the
    rarest elements of its difference, one more than it could do without, and each unlinked set asks with all of its;
    if neither is linked with the hub, the bound holds both ways and a listed element meets a listed one.
    """
    useful = (
        spokes.groupBy("hub")
        .agg(F.count("*").alias("n"), F.count_if(~F.col("linked")).alias("asking"))
        .filter("n > 1 and asking > 0")
        .select("hub")
    )
    size = F.size("added") + F.size("removed")
    shared = F.floor(
        (size * (under + over) + (under - over) * (F.col("hub_size") - F.col("size"))) / F.lit(2 * (under + over))
    )
    rows = spokes.join(useful, "hub").select(
        "hub",
        "sid",
        "linked",
        (size - F.greatest(shared, F.lit(0))).alias("listing"),
        F.explode(F.concat("added", "removed")).alias("element"),
    )
    rows = keep(rows, "differences")
    counts = rows.groupBy("hub", "element").agg(F.count("*").alias("company"))
    ranked = Window.partitionBy("hub", "sid").orderBy("company", "element")
    return (
        rows.join(counts, ["hub", "element"])
        .withColumn("listed", F.row_number().over(ranked) <= F.col("listing"))
        .filter("company > 1 and (listed or not linked)")
        .select("hub", "element", "sid", "listed", (~F.col("linked")).alias("asks"))
    )


def _links(sets: DataFrame, over: int, under: int) -> DataFrame:
    """Links (hub, sid) that join all linked sets into their components."""
    signed = keep(sets.mapInArrow(_signed(over, under), "place long, sid long, band int"), "signatures")
    crowds = _crowds(signed)
    discard(signed)
    found, allowed = [], PAIRED_MEMBERS
    for by_signatures in (True, False):
        few = crowds.filter(F.col("company") <= PAIRED_SETS).select("place", "sid")
        pairs = (
            few.withColumnRenamed("sid", "hub").join(few, "place").filter("hub < sid").select("hub", "sid").distinct()
        )
        compared = keep(_compared(pairs, sets, over, under, differences=False), "pairs")
        found.append(compared.filter("linked").select("hub", "sid"))
        crowds = crowds.filter(F.col("company") > PAIRED_SETS)
        if not crowds.limit(1).count():
            break
        if by_signatures:
            crowds = _rare_crowds(crowds, sets, over, under)
    spokes_of = _family_spokes
    while crowds.limit(1).count():
        spokes = keep(_compared(spokes_of(crowds), sets, over, under, differences=True), "spokes")
        found.append(spokes.filter("linked").select("hub", "sid"))
        rows = keep(_deltas(spokes, over, under), "index")
        places = rows.groupBy("hub", "element").agg(
            F.count("*").alias("company"),
            F.count_if(F.col("listed") & ~F.col("asks")).alias("linked"),
            F.count_if("asks").alias("asking"),
            F.count_if(F.col("listed") & F.col("asks")).alias("both"),
        )
        work = F.col("linked") * F.col("asking") + F.col("both") * (F.col("both") - 1)
        places = places.filter(work > 0).select(
            "hub", "element", "company", (work <= allowed * F.col("company")).alias("light")
        )
        rows = keep(rows.join(places, ["hub", "element"]), "places")
        few = rows.filter("light")
        a, b = few.filter("listed").alias("a"), few.filter("asks").alias("b")
        pairs = (
            a.join(b, ["hub", "element"])
            .filter("a.sid != b.sid and (b.listed or not a.asks)")
            .select(F.least("a.sid", "b.sid").alias("hub"), F.greatest("a.sid", "b.sid").alias("sid"))
            .distinct()
        )
        compared = keep(_compared(pairs, sets, over, under, differences=False), "pairs")
        found.append(compared.filter("linked").select("hub", "sid"))
        crowds = keep(
            rows.filter("not light").select(
                F.xxhash64("hub", "element").alias("place"), "sid", "company"
            ),
            "crowds",
        )
        allowed *= 8
        spokes_of = _spokes
    return functools.reduce(DataFrame.union, found, sets.select(F.col("sid").alias("hub"), "sid").limit(0))


def ngram_join(
    docs: DataFrame, size: int = 5, over: int = 80, under: int = 100, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Group documents whose n-gram sets have a Jaccard similarity of at least ``over / under``.

    Returns one row per row of ``docs``: doc_id, n_shingles, class_id (smallest id with the same words), component_id
    (smallest id reachable over links, itself included), text_hash (``xxhash64``, to tell rows of one id apart). ASCII letters are lower-cased; words are separated by ASCII
    white space. See the module for the method and for nulls, empty texts and repeated rows.
    """
    if not 0 < over <= under:
        raise ValueError("the similarity must be over 0 and at most 1")
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # A set may lack the share (under - over) / under of its features in a partner. The first look covers half as much
    # again and a twentieth of all features, so that most sets without a partner show more than that.
    look = min(2**64 - 1, 2**64 * (30 * (under - over) + under) // (20 * under))
    scanned = keep(
        plain.withColumn("text_hash", F.xxhash64("text")).mapInArrow(
            _scan(size, look), "doc_id long, text_hash long, high long, low long, n_shingles long, first array<long>"
        ),
        "scanned",
    )
    rows = keep(scanned.drop("first"), "documents")
    classes = (
        rows.filter("n_shingles > 0")
        .groupBy("high", "low")
        .agg(F.min("doc_id").alias("class_id"), F.first("n_shingles").alias("n"))
    )
    owned = (
        scanned.select("high", F.explode("first").alias("feature"))
        .groupBy("feature")
        .agg(F.min("high").alias("high"), F.max("high").alias("other"))
        .filter("high = other")
        .groupBy("high")
        .agg(F.count("*").alias("owned"))
    )
    likely = classes.join(owned, "high", "left").filter(
        F.coalesce("owned", F.lit(0)) * under <= F.col("n") * (under - over)
    )
    likely = keep(likely.select("high", "low", "class_id"), "likely")
    discard(scanned)
    wanted = small(likely.select(F.col("high").alias("sid"), F.col("low").alias("wanted"), F.col("class_id").alias("doc_id")))
    found = plain.join(wanted, plain["doc_id"].eqNullSafe(wanted["doc_id"])).select("sid", "wanted", "text")
    sets = keep(
        found.mapInArrow(_sets(size), "sid long, wanted long, high long, low long, items array<long>")
        .filter("sid = high and wanted = low")
        .groupBy("sid")
        .agg(F.first("items").alias("items")),
        "sets",
    )
    joined = components(_links(sets, over, under), "hub", "sid")
    joined = keep(joined, "components")
    members = likely.select(F.col("high").alias("node"), "class_id").join(joined, "node")
    least = members.groupBy("component").agg(F.min("class_id").alias("component_id"))
    labels = members.join(least, "component").select(F.col("node").alias("high"), "component_id")
    classes = classes.join(labels, "high", "left").select(
        F.col("high").alias("h"), F.col("low").alias("l"), "class_id", F.coalesce("component_id", "class_id").alias("component_id")
    )
    classes = small(keep(classes, "classes"))
    return rows.join(classes, (F.col("high") == F.col("h")) & (F.col("low") == F.col("l")) & (F.col("n_shingles") > 0), "left").select(
        "doc_id",
        "n_shingles",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
        "text_hash",
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the smallest id of each group kept; rows without an id and rows with an empty set stay.

    Rows that repeat an id are judged by their texts: those of an id and a text that stay or go do so together.
    """
    groups = ngram_join(docs, id_col=id_col, text_col=text_col, **options).filter("doc_id != component_id")
    row = F.xxhash64(F.col(id_col).cast("long"), F.xxhash64(F.col(text_col).cast("string")))
    keyed = docs.withColumn("__row", F.when(F.col(id_col).isNotNull(), row))
    return without_documents(keyed, groups.select(F.xxhash64("doc_id", "text_hash")), "__row").drop("__row")
