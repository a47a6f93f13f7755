"""Token ids of documents in compressed files, and back.

Layout: a folder of Parquet files, one row per block; Spark's committer writes them, so a lost task leaves no half file.
A block is coded by itself (``range_coder``) and holds up to ``BLOCK`` ids of consecutive documents:

* ``file``, ``block``: the blocks of one file follow each other; files follow each other in the order of ids,
* ``first``: place of the block's first id in its file; ``n_ids``: its ids,
* ``doc``: number, in the file, of the document of the first id; ``doc_ids``, ``lengths``: the documents with ids in the
  block and how many of them; a document may run over any number of blocks,
* ``coded``: header (``HEADER``: mark, version, ids, CRC-32 of the ids, CRC-32 of what follows) and the coded words.

Documents are written in ascending order of their id: rows are range-partitioned by it, encoded, cut and coded in one
pass; equal ids are told apart by their place in the input, so a repeated id fills no single task. Reading decodes many
blocks side by side, checks both checksums, and raises ``ValueError`` on damage.

Ids come from the tokenizers library. It drops white space and never joins across it, so texts are cut at ASCII white
space and each distinct stretch goes through the library once per task and bound, many plain ones in one text.

Defined results: a null or empty text is the closing id alone; rows that repeat an id are documents of their own, in the
order of the input; null ids come first; the id column keeps its type; an empty table gives no rows.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablecraft.llm import range_coder
from tablecraft.llm.common import lists, small
from tablecraft.session import working_dir

CLOSING_ID = 1
FILE_BYTES = 32 << 20
CACHED_STRETCHES = 1_000_000
# Stretches that go through the library in one text.
JOINED_STRETCHES = 1024
SLICE_ROWS = 256
# Mark, version, ids, CRC-32 of the ids as unsigned 32-bit little-endian numbers, CRC-32 of the coded words.
HEADER = "<4sHHIII"
MARK, VERSION = b"TCTI", 1


class WordEncoder:
    """Ids of texts by a vocabulary of the tokenizers library that drops white space."""

    def __init__(self, path: str):
        # One core per task.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self.size = self._tokenizer.get_vocab_size()
        self._added = [t.content.encode() for t in self._tokenizer.get_added_tokens_decoder().values()]
        # Bytes of the text that each id stands for, where an entry has one character a byte and a mark at the end of words.
        self._bytes = np.zeros(self.size, np.int64)
        for entry, number in self._tokenizer.get_vocab().items():
            self._bytes[number] = len(entry.removesuffix("</w>"))
        self._forget()

    def _forget(self) -> None:
        # Known stretches by number; the ids of stretch n are those from firsts[n] to firsts[n + 1].
        self._known: dict[bytes, int] = {}
        self._firsts, self._ids = np.zeros(1, np.int64), np.empty(0, np.uint32)

    def _together(self, stretches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of plain stretches from one call on all of them, and how many each has, told by the bytes of the ids."""
        text = b" ".join(stretches).decode()
        ids = np.array(self._tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        ends, wanted = np.cumsum(self._bytes[ids]), np.cumsum([len(s) for s in stretches])
        last = np.searchsorted(ends, wanted)
        if not len(ends) or ends[-1] != wanted[-1] or (ends[last] != wanted).any():
            return self._apart(stretches)
        return ids, np.diff(last, prepend=-1)

    def _apart(self, stretches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self._tokenizer.encode_batch_fast([s.decode() for s in stretches], add_special_tokens=False)]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(counts.sum())), counts

    def _learn(self, stretches: list[bytes]) -> None:
        # ASCII and the letters from U+00C0 to U+00FF keep their bytes in lower case and by composition, others may not;
        # special ids stand for texts of their own.
        plain, others = [], []
        for own in stretches:
            simple = own.isascii() or max(own) <= 0xC3 and b"\xc2" not in own
            (plain if simple and not any(mark in own for mark in self._added) else others).append(own)
        parts = [self._together(plain[at : at + JOINED_STRETCHES]) for at in range(0, len(plain), JOINED_STRETCHES)]
        parts.append(self._apart(others))
        stretches = plain + others
        self._known.update(zip(stretches, range(len(self._known), len(self._known) + len(stretches)), strict=True))
        ends = np.cumsum(np.concatenate([counts for _, counts in parts])) + len(self._ids)
        self._firsts = np.concatenate([self._firsts, ends])
        self._ids = np.concatenate([self._ids, *(ids for ids, _ in parts)])

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts behind each other, and how many each text has."""
        parts = [text.encode().split() for text in texts]
        if len(self._known) > CACHED_STRETCHES:
            self._forget()
        if new := set().union(*parts).difference(self._known):
            self._learn(list(new))
        counts = np.array([len(own) for own in parts])
        number = np.fromiter(map(self._known.__getitem__, chain.from_iterable(parts)), np.int64, int(counts.sum()))
        first, size = self._firsts[number], self._firsts[number + 1] - self._firsts[number]
        ends = np.cumsum(size)
        ids = self._ids[np.repeat(first - ends + size, size) + np.arange(int(size.sum()))]
        return ids, np.diff(np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])])


def public_encoder() -> WordEncoder:
    import public_tokenizers as files

    return WordEncoder(files.path("word_bpe_49k.json"))


def pack_block(ids: np.ndarray, coded: bytes) -> bytes:
    return struct.pack(HEADER, MARK, VERSION, 0, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(coded)) + coded


def unpack_block(block: bytes) -> tuple[int, int, bytes]:
    """Ids, their checksum, and the coded words."""
    if len(block) < struct.calcsize(HEADER):
        raise ValueError("a block is shorter than its header")
    mark, version, _, count, ids_crc32, coded_crc32 = struct.unpack_from(HEADER, block)
    coded = block[struct.calcsize(HEADER) :]
    if mark != MARK or version != VERSION:
        raise ValueError("not a block of token ids of this version")
    if zlib.crc32(coded) != coded_crc32:
        raise ValueError("the coded words of a block are damaged")
    return count, ids_crc32, coded


def pack_blocks(ids: np.ndarray, vocabulary: int, size: int) -> list[bytes]:
    """Blocks of ``size`` ids each, the last one perhaps shorter."""
    blocks = []
    for at in range(0, len(ids), size * range_coder.LANES):
        own = ids[at : at + size * range_coder.LANES]
        lanes = -(-len(own) // size)
        steps = min(size, len(own))
        filled = np.zeros(lanes * steps, own.dtype)
        filled[: len(own)] = own
        coded = range_coder.encode(filled.reshape(lanes, steps).T, vocabulary)
        blocks += [pack_block(own[n * steps : (n + 1) * steps], c) for n, c in enumerate(coded)]
    return blocks


def unpack_blocks(blocks: list[bytes], vocabulary: int) -> list[np.ndarray]:
    """The ids of blocks, checked."""
    out = []
    for at in range(0, len(blocks), range_coder.LANES):
        parts = [unpack_block(b) for b in blocks[at : at + range_coder.LANES]]
        found = range_coder.decode([c for *_, c in parts], max(n for n, *_ in parts), vocabulary)
        found = np.ascontiguousarray(found.T).astype("<u4")
        for own, (count, ids_crc32, _) in zip(found, parts, strict=True):
            if zlib.crc32(own[:count].tobytes()) != ids_crc32:
                raise ValueError("the ids of a block do not match their checksum")
            out.append(own[:count])
    return out


class _File:
    """Collects the documents of one file and cuts them into blocks."""

    NAMES = ["file", "block", "first", "n_ids", "doc", "doc_ids", "lengths", "vocabulary", "coded"]

    def __init__(self, number: int, vocabulary: int, size: int, id_type: pa.DataType):
        self._number, self._vocabulary, self._size, self._id_type = number, vocabulary, size, id_type
        self._ids, self._doc_ids, self._lengths = [], [], []
        self._held = self._blocks = self._docs = 0

    def add(self, doc_ids: pa.Array, ids: np.ndarray, lengths: np.ndarray) -> Iterator[pa.RecordBatch]:
        self._doc_ids.append(doc_ids)
        self._ids.append(ids)
        self._lengths.extend(lengths.tolist())
        self._held += len(ids)
        while self._held >= self._size * range_coder.LANES:
            yield self._blocked(self._size * range_coder.LANES)

    def close(self) -> Iterator[pa.RecordBatch]:
        if self._held:
            yield self._blocked(self._held)

    def _blocked(self, count: int) -> pa.RecordBatch:
        """Blocks of the first ``count`` ids; what is left stays for later."""
        ids, lengths = np.concatenate(self._ids), np.array(self._lengths)
        doc_ids = pa.concat_arrays(self._doc_ids)
        ends = np.cumsum(lengths)
        firsts = np.arange(0, count, self._size)
        lasts = np.minimum(firsts + self._size, count)
        from_doc, to_doc = np.searchsorted(ends, firsts, "right"), np.searchsorted(ends, lasts, "left")
        own = [np.arange(a, b + 1) for a, b in zip(from_doc, to_doc, strict=True)]
        parts = [
            np.minimum(ends[n], last) - np.maximum(ends[n] - lengths[n], first)
            for n, first, last in zip(own, firsts, lasts, strict=True)
        ]
        offsets = np.concatenate([[0], np.cumsum([len(n) for n in own])]).astype(np.int32)
        batch = pa.record_batch(
            [
                pa.array(np.full(len(firsts), self._number, np.int32)),
                pa.array(np.arange(len(firsts), dtype=np.int32) + self._blocks),
                pa.array(firsts + self._blocks * self._size),
                pa.array((lasts - firsts).astype(np.int32)),
                pa.array(from_doc + self._docs),
                pa.ListArray.from_arrays(pa.array(offsets), doc_ids.take(pa.array(np.concatenate(own)))),
                lists(parts, pa.int32()),
                pa.array(np.full(len(firsts), self._vocabulary, np.int32)),
                pa.array(pack_blocks(ids[:count], self._vocabulary, self._size), pa.binary()),
            ],
            self.NAMES,
        )
        self._blocks += len(firsts)
        done = int(np.searchsorted(ends, count, "right"))
        self._docs += done
        left = int(ends[-1]) - count
        self._ids, self._held = [ids[count:]] if left else [], left
        self._doc_ids = [doc_ids.slice(done)]
        # The rest of a document that was cut keeps its number.
        self._lengths = [n for n in [int(ends[done]) - count, *lengths[done + 1 :].tolist()]] if done < len(ends) else []
        return batch


def _write(make_encoder: Callable, closing: int, size: int) -> Callable:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, out = make_encoder(), None
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                if out is None:
                    out = _File(TaskContext.get().partitionId(), encode.size, size, part.column("doc_id").type)
                ids, lengths = encode([text or "" for text in part.column("text").to_pylist()])
                yield from out.add(part.column("doc_id"), np.insert(ids, np.cumsum(lengths), closing), lengths + 1)
        if out:
            yield from out.close()

    return write


def write(docs: DataFrame, path: str, encoder: Callable = public_encoder, closing: int = CLOSING_ID, id_col: str = "doc_id", text_col: str = "text", block: int = range_coder.BLOCK, file_bytes: int = FILE_BYTES) -> None:
    """Write the ids of all documents below ``path``, which must not exist. ``file_bytes`` is the text of a file."""
    if not 0 < block <= range_coder.BLOCK:
        raise ValueError(f"a block has 1 to {range_coder.BLOCK} ids")
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    total = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    kind = plain.schema["doc_id"].dataType.simpleString()
    schema = f"file int, block int, first long, n_ids int, doc long, doc_ids array<{kind}>, lengths array<int>, vocabulary int, coded binary"
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    files = max(min(width, -(-total // (file_bytes // 8))), -(-total // file_bytes), 1)
    ordered = plain.repartitionByRange(files, F.asc_nulls_first("doc_id"), "row").sortWithinPartitions(F.asc_nulls_first("doc_id"), "row")
    ordered.select("doc_id", "text").mapInArrow(_write(encoder, closing, block), schema).write.parquet(path)


def _pieces(with_ids: bool) -> Callable:
    """Per block and document: where the piece begins, its ids and their checksum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, range_coder.LANES):
                part = batch.slice(at, range_coder.LANES)
                vocabulary = part.column("vocabulary")[0].as_py()
                found = unpack_blocks(part.column("coded").to_pylist(), vocabulary)
                lengths = part.column("lengths")
                counts = lengths.value_lengths().to_numpy()
                sizes = lengths.flatten().to_numpy().astype(np.int64)
                flat = np.concatenate(found)
                cuts = np.concatenate([[0], np.cumsum(sizes)])
                rows = np.repeat(np.arange(part.num_rows), counts)
                within = np.arange(len(sizes)) - np.repeat(np.cumsum(counts) - counts, counts)
                base = part.column("first").to_numpy()[rows] - np.concatenate([[0], np.cumsum([len(f) for f in found])])[rows]
                own = [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                columns = [
                    part.column("file").take(pa.array(rows)),
                    pa.array(part.column("doc").to_numpy()[rows] + within),
                    part.column("doc_ids").flatten(),
                    pa.array(cuts[:-1] + base),
                    pa.array(sizes),
                    pa.array([zlib.crc32(o.tobytes()) for o in own], pa.int64()),
                ]
                names = ["file", "doc", "doc_id", "at", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(lists([o.astype(np.int32) for o in own], pa.int32()))
                    names.append("ids")
                yield pa.record_batch(columns, names)

    return run


def _times(matrix: tuple[int, ...], vector: int) -> int:
    out = 0
    for row in matrix:
        if not vector:
            break
        if vector & 1:
            out ^= row
        vector >>= 1
    return out


def zero_bits(doublings: int = 48) -> list[tuple[int, ...]]:
    """What appending 8, 16, 32, ... zero bits does to a CRC-32: linear maps, one row per bit."""
    power, out = (0xEDB88320, *(1 << n for n in range(31))), []
    for _ in range(doublings + 3):
        out.append(power)
        power = tuple(_times(power, row) for row in power)
    return out[3:]


def joined_crc32(first: int, second: int, n_bytes: int, zeros: list[tuple[int, ...]]) -> int:
    """CRC-32 of two stretches from theirs; ``n_bytes`` is the length of the second, ``zeros`` from ``zero_bits``."""
    for n in range(n_bytes.bit_length()):
        if n_bytes >> n & 1:
            first = _times(zeros[n], first)
    return first ^ second


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    zeros = zero_bits()
    for batch in batches:
        sums = []
        for lengths, parts in zip(batch.column("lengths").to_pylist(), batch.column("sums").to_pylist(), strict=True):
            value = parts[0]
            for part, length in zip(parts[1:], lengths[1:], strict=True):
                value = joined_crc32(value, part, 4 * length, zeros)
            sums.append(value)
        names = [n for n in batch.schema.names if n not in ("lengths", "sums")]
        yield pa.record_batch([*(batch.column(n) for n in names), pa.array(sums, pa.int64())], [*names, "ids_crc32"])


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if wanted, ids.

    Blocks are decoded wherever they are; the pieces of a document meet by its number.
    """
    blocks = spark.read.parquet(path)
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.groupBy("file").agg(F.sum("n_ids").alias("ids"))
    # One row per file, of which there is one per ``file_bytes`` of text.
    starts = small(starts.select("file", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base")))
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    ids = ["ids"] if with_ids else []
    schema = f"file int, doc long, doc_id {kind}, at long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    pieces = blocks.mapInArrow(_pieces(with_ids), schema).groupBy("file", "doc").agg(
        F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("at", "n_tokens", "ids_crc32", *ids))).alias("pieces")
    )
    pieces = pieces.select(
        "file",
        "doc_id",
        F.col("pieces")[0]["at"].alias("at"),
        F.aggregate("pieces.n_tokens", F.lit(0).cast("long"), lambda a, b: a + b).alias("n_tokens"),
        *([F.flatten("pieces.ids").alias("ids")] if with_ids else []),
        F.col("pieces.n_tokens").alias("lengths"),
        F.col("pieces.ids_crc32").alias("sums"),
    )
    schema = f"file int, doc_id {kind}, at long, n_tokens long" + ", ids array<int>" * with_ids + ", ids_crc32 long"
    found = pieces.mapInArrow(_joined, schema).join(starts, "file")
    return found.select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *ids)


def write_and_read(docs: DataFrame, with_ids: bool = False, **options) -> DataFrame:
    """Documents through files below the shared folder: what ``read`` gives for what ``write`` wrote."""
    path = working_dir(docs.sparkSession, "token-files")
    write(docs, path, **options)
    return read(docs.sparkSession, path, with_ids)
