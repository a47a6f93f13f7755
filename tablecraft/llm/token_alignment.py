"""Alignment of two tokenizers' tokens over the same bytes, and how often their ids meet.

Method: all tokens of both tokenizers of some documents are laid out by their byte ranges, one document behind the other.
They are lexsorted by start; the running maximum of the ends tells where a group breaks: where a token starts at or
beyond it. Tokens that overlap, directly or over others, so fall into one group, and groups end where tokens of both
tokenizers end. Every token of one side is linked with every token of the other side of its group.

An id pair's count is the number of documents that hold it linked. Documents come in chunks of bounded size: a chunk
lists its id pairs once, with the number of its documents that hold each, and its documents refer to that list by place.
Only these lists are summed over the corpus and joined back, a row per chunk and pair; documents are not exploded into
pairs. Chunks then meet their counts by chunk number.

Defined results: a text that is null or empty, or whose tokens do not spell a blank and the text in both tokenizers, has
no tokens; rows that repeat an id are documents of their own; the id column keeps its type; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecraft.llm.common import discard, keep, lists

# Links of the documents of a chunk at most; a single document may have more.
CHUNK_LINKS = 1 << 22
# Links that are listed at once.
SLICE_LINKS = 1 << 19
# UTF-8 bytes of the documents that are tokenized at once; a single document may be longer.
SLICE_BYTES = 1 << 20
# Links of a group beyond which its ids are listed once each, with the number of times.
LARGE_GROUP = 1 << 10


class Side:
    """A tokenizer: ids of texts, and the bytes of each id."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], spelled: list[bytes]):
        self.encode, self._spelled = encode, spelled
        self._sizes = np.array([len(s) for s in spelled], np.int64)

    def ids(self, texts: list[str], wanted: list[bytes]) -> list[np.ndarray | None]:
        """Ids of each text, or None where they don't spell the wanted bytes."""
        out = []
        for own, target in zip(self.encode(texts), wanted, strict=True):
            same = b"".join(map(self._spelled.__getitem__, own)) == target
            out.append(np.array(own, np.int64) if same else None)
        return out

    def ends(self, ids: np.ndarray) -> np.ndarray:
        return np.cumsum(self._sizes[ids])


def byte_side(ranks: str, pattern: str) -> Side:
    """A byte-level vocabulary given as ranks; it gets a blank before the text."""
    import tiktoken

    with open(ranks, "rb") as lines:
        known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encode = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=known, special_tokens={}).encode_ordinary
    spelled = [b""] * (max(known.values()) + 1)
    for token, number in known.items():
        spelled[number] = token
    return Side(lambda texts: [encode(" " + t) for t in texts], spelled)


def piece_side(model: str) -> Side:
    """A piece vocabulary with byte fallback; it adds the blank by itself."""
    from sentencepiece import SentencePieceProcessor

    pieces = SentencePieceProcessor(model_file=model)
    spelled = []
    for n in range(pieces.get_piece_size()):
        piece = pieces.id_to_piece(n)
        spelled.append(bytes([int(piece[3:5], 16)]) if pieces.is_byte(n) else piece.replace("▁", " ").encode())
    return Side(lambda texts: pieces.encode(texts, num_threads=1), spelled)


def public_sides() -> tuple[Side, Side]:
    import public_tokenizers as files

    return byte_side(files.path("byte_bpe_50k.tiktoken"), files.PATTERN), piece_side(files.path("piece_bpe_32k.model"))


def coalesced(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of every token of both sides, from the ends of their byte ranges (each begins where the last ended)."""
    starts = np.concatenate([[0], ends_a[:-1], [0], ends_b[:-1]]) if len(ends_a) and len(ends_b) else np.empty(0, np.int64)
    ends = np.concatenate([ends_a, ends_b])
    order = np.lexsort((ends, starts))
    reach = np.maximum.accumulate(ends[order])
    breaks = np.ones(len(order), np.int64)
    breaks[1:] = starts[order][1:] >= reach[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(breaks) - 1
    return group[: len(ends_a)], group[len(ends_a) :]


class _Members:
    """The ids of one side in each group: all of them, or each once with the number of times it is there."""

    def __init__(self, ids: np.ndarray, group: np.ndarray, sizes: np.ndarray, once: bool):
        self.ids, self.times, self.sizes = ids, np.ones(len(ids), np.int64), sizes
        if once:
            keys, self.times = np.unique(group << 32 | ids, return_counts=True)
            self.ids, self.sizes = keys & 0xFFFFFFFF, np.bincount(keys >> 32, minlength=len(sizes))
        self.firsts = np.cumsum(self.sizes) - self.sizes


class Layout:
    """Some documents' tokens in groups, side by side."""

    def __init__(self, ids_a: list[np.ndarray], ids_b: list[np.ndarray], sides: tuple[Side, Side]):
        self.a, self.b = np.concatenate(ids_a), np.concatenate(ids_b)
        self.n_a, self.n_b = np.array([len(i) for i in ids_a]), np.array([len(i) for i in ids_b])
        group_a, group_b = coalesced(sides[0].ends(self.a), sides[1].ends(self.b))
        self.groups = int(group_a[-1]) + 1 if len(group_a) else 0
        self.size_a, self.size_b = np.bincount(group_a, minlength=self.groups), np.bincount(group_b, minlength=self.groups)
        # Documents end where tokens of both sides end, so each group lies in one document.
        cuts = np.concatenate([[0], np.cumsum(self.n_a)])
        firsts = np.concatenate([group_a, [self.groups]])[cuts]
        self.n_groups = np.diff(firsts)
        self.links = self.size_a * self.size_b
        sums = np.concatenate([[0], np.cumsum(self.links)])
        self.n_links = np.diff(sums[firsts])
        self._firsts, self._large = firsts, bool(len(self.links)) and int(self.links.max()) > LARGE_GROUP
        self._of_a, self._of_b = _Members(self.a, group_a, self.size_a, self._large), _Members(self.b, group_b, self.size_b, self._large)

    def linked(self, doc_from: int, doc_to: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, id pair and times of the links of the documents from ``doc_from`` to ``doc_to``; pairs may repeat."""
        groups = slice(int(self._firsts[doc_from]), int(self._firsts[doc_to]))
        size_a, size_b = self._of_a.sizes[groups], self._of_b.sizes[groups]
        links = size_a * size_b
        group = np.repeat(np.arange(len(links)), links)
        within = np.arange(int(links.sum())) - np.repeat(np.cumsum(links) - links, links)
        a = self._of_a.firsts[groups][group] + within // size_b[group]
        b = self._of_b.firsts[groups][group] + within % size_b[group]
        doc = np.searchsorted(self._firsts, groups.start + group, "right") - 1
        return doc, self._of_a.ids[a] << 32 | self._of_b.ids[b], self._of_a.times[a] * self._of_b.times[b]

    def written(self, texts: tuple[np.ndarray, ...]) -> Iterator[bytes]:
        """``a1,a2|b1;a3|b2,b3`` for each document; ``texts`` holds the numbers followed by each mark."""
        number = np.arange(self.groups)
        last_a, last_b = np.cumsum(self.size_a) - 1, np.cumsum(self.size_b) - 1
        marks_a, marks_b = np.zeros(len(self.a), bool), np.zeros(len(self.b), bool)
        marks_a[last_a], marks_b[last_b] = True, True
        words = np.empty(len(self.a) + len(self.b), object)
        at_a = np.arange(len(self.a)) + np.repeat((last_b + 1 - self.size_b)[number], self.size_a)
        at_b = np.arange(len(self.b)) + np.repeat((last_a + 1)[number], self.size_b)
        words[at_a] = np.where(marks_a, texts[1][self.a], texts[0][self.a])
        words[at_b] = np.where(marks_b, texts[2][self.b], texts[0][self.b])
        at = 0
        for size in (self.n_a + self.n_b).tolist():
            yield b"".join(words[at : at + size].tolist())[:-1]
            at += size


def _marked(size: int) -> tuple[np.ndarray, ...]:
    out = []
    for mark in (b",", b"|", b";"):
        words = np.empty(size, object)
        words[:] = [b"%d" % n + mark for n in range(size)]
        out.append(words)
    return tuple(out)


class _Chunk:
    """Documents whose links are listed together."""

    def __init__(self):
        self.slices: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.rows: list[pa.RecordBatch] = []
        self.links = 0

    def add(self, rows: pa.RecordBatch, layout: Layout) -> None:
        """``rows`` without their links, which are counted per document and pair."""
        self.rows.append(rows)
        self.links += int(layout.n_links.sum())
        at = 0
        # A document with more links than a slice is listed by itself.
        sums = np.cumsum(layout.n_links)
        while at < rows.num_rows:
            base = int(sums[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(sums, base + SLICE_LINKS, "right")))
            doc, pair, times = layout.linked(at, to)
            order = np.lexsort((pair, doc))
            doc, pair = doc[order], pair[order]
            first = np.ones(len(pair), bool)
            first[1:] = (doc[1:] != doc[:-1]) | (pair[1:] != pair[:-1])
            begins = np.flatnonzero(first)
            if len(begins):
                times = np.add.reduceat(times[order], begins)
            self.slices.append((np.bincount(doc[begins] - at, minlength=to - at), pair[begins], times))
            at = to

    def close(self, number: int) -> Iterator[pa.RecordBatch]:
        """The documents with places in the chunk's list, then the list itself."""
        known, place, docs = np.unique(np.concatenate([s[1] for s in self.slices]), return_inverse=True, return_counts=True)
        times = np.concatenate([s[2] for s in self.slices])
        sizes = np.concatenate([s[0] for s in self.slices])
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        at = 0
        for rows in self.rows:
            own = slice(cuts[at], cuts[at + rows.num_rows])
            offsets = pa.array((cuts[at : at + rows.num_rows + 1] - cuts[at]).astype(np.int32))
            columns = [pa.ListArray.from_arrays(offsets, pa.array(v[own].astype(np.int32))) for v in (place, times)]
            chunk = pa.array(np.full(rows.num_rows, number))
            nothing = pa.nulls(rows.num_rows, pa.list_(pa.int64())), pa.nulls(rows.num_rows, pa.list_(pa.int32()))
            yield pa.record_batch([chunk, *rows.columns, *columns, *nothing], _names(rows.schema.names))
            at += rows.num_rows
        if not len(known):
            return
        blank = [pa.nulls(1, f.type) for f in self.rows[0].schema]
        listed = [lists([known], pa.int64()), lists([docs.astype(np.int32)], pa.int32())]
        nothing = [pa.nulls(1, pa.list_(pa.int32()))] * 2
        yield pa.record_batch([pa.array([number]), *blank, *nothing, *listed], _names(self.rows[0].schema.names))


DOCUMENT = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]


def _names(own: list[str]) -> list[str]:
    return ["chunk", *own, "places", "times", "pairs", "pair_docs"]


def _aligned(make_sides: Callable, chunk_links: int) -> Callable:
    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = make_sides()
        texts = _marked(1 + max(len(s._spelled) for s in sides))
        base, number, chunk = TaskContext.get().partitionId() << 32, 0, _Chunk()
        for batch in batches:
            sizes = [len(t.as_buffer()) if t.is_valid else 0 for t in batch.column("text")]
            at = 0
            while at < batch.num_rows:
                to, held = at + 1, sizes[at]
                while to < batch.num_rows and held + sizes[to] <= SLICE_BYTES:
                    held += sizes[to]
                    to += 1
                chunk.add(*_document_rows(batch.slice(at, to - at), sides, texts))
                at = to
                if chunk.links >= chunk_links:
                    yield from chunk.close(base + number)
                    number, chunk = number + 1, _Chunk()
        if chunk.rows:
            yield from chunk.close(base + number)

    return aligned


def _document_rows(part: pa.RecordBatch, sides: tuple[Side, Side], marked: tuple[np.ndarray, ...]) -> tuple[pa.RecordBatch, Layout]:
    nothing = np.empty(0, np.int64)
    texts = part.column("text").to_pylist()
    ids = [[nothing] * len(texts), [nothing] * len(texts)]
    full = [n for n, text in enumerate(texts) if text]
    wanted = [b" " + texts[n].encode() for n in full]
    found = [side.ids([texts[n] for n in full], wanted) for side in sides]
    for n, a, b in zip(full, *found, strict=True):
        if a is not None and b is not None:
            ids[0][n], ids[1][n] = a, b
    layout = Layout(*ids, sides)
    sums = ["" if not size else hashlib.sha256(text).hexdigest() for size, text in zip(layout.n_a.tolist(), layout.written(marked), strict=True)]
    columns = [pa.array(v.astype(np.int64)) for v in (layout.n_a, layout.n_b, layout.n_groups, layout.n_links)]
    return pa.record_batch([part.column("doc_id"), *columns, pa.array(sums, pa.string())], DOCUMENT), layout


def _scored(docs: pa.Table, counts: pa.Table) -> pa.Table:
    """Per document of a chunk: links whose count is the best of their A id, and the sum of the counts of all links."""
    size = counts.num_rows
    count, best = np.zeros(size + 1, np.int64), np.zeros(size + 1, np.int64)
    place = counts.column("place").to_numpy()
    count[place], best[place] = counts.column("count").to_numpy(), counts.column("best").to_numpy()
    columns = [docs.column(name) for name in DOCUMENT]
    # A list column of a table has its rows back to back in each of its chunks.
    places, times = (np.concatenate([c.flatten().to_numpy() for c in docs.column(n).chunks]) for n in ("places", "times"))
    owner = np.repeat(np.arange(docs.num_rows), np.concatenate([c.value_lengths().to_numpy() for c in docs.column("places").chunks]))
    sums = []
    for value in (best, count):
        total = np.zeros(docs.num_rows, np.int64)
        np.add.at(total, owner, value[places] * times)
        sums.append(pa.array(total))
    return pa.table([*columns, *sums], names=[*DOCUMENT, "n_best", "count_sum"])


def align(docs: DataFrame, sides: Callable = public_sides, id_col: str = "doc_id", text_col: str = "text", chunk_links: int = CHUNK_LINKS) -> tuple[DataFrame, DataFrame]:
    """Documents and id pairs.

    Documents: the id, n_a and n_b (tokens), n_groups, n_links, groups_sha256, n_best (links whose count is the highest
    of their A id), count_sum (counts over all links). Pairs: a, b, count (documents) and best.
    """
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = plain.schema["doc_id"].dataType.simpleString()
    document = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
    schema = f"chunk long, {document}, places array<int>, times array<int>, pairs array<long>, pair_docs array<int>"
    laid = keep(plain.mapInArrow(_aligned(sides, chunk_links), schema), "aligned")
    listed = laid.filter("pairs is not null").select("chunk", F.posexplode(F.arrays_zip("pairs", "pair_docs")).alias("place", "pair"))
    listed = listed.select("chunk", "place", F.col("pair.pairs").alias("pair"), F.col("pair.pair_docs").alias("docs"))
    counted = listed.groupBy("pair").agg(F.sum("docs").alias("count"))
    counted = keep(counted.select("pair", F.shiftright("pair", 32).cast("int").alias("a"), "count"), "pair-counts")
    # One row per id of A at most: bounded by its vocabulary.
    highest = F.broadcast(counted.groupBy("a").agg(F.max("count").alias("highest")))
    counted = counted.join(highest, "a").select(
        "pair", "a", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("b"), "count", (F.col("count") == F.col("highest")).alias("best")
    )
    asked = listed.join(counted, "pair").select((F.col("chunk") + 0).alias("of_chunk"), "place", "count", F.col("best").cast("int").alias("best"))
    own = laid.filter("pairs is null").drop("pairs", "pair_docs")
    scored = own.groupBy("chunk").cogroup(asked.groupBy("of_chunk")).applyInArrow(_scored, document + ", n_best long, count_sum long")
    return scored, counted.drop("pair")
