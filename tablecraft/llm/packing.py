"""Best-fit packing of token sequences by the sum-of-squares rule.

Documents are turned into ids, cut into pieces of at most ``capacity`` ids (the first piece of a document takes the
rest), and pieces are placed one by one: of all open sequences with room, and a new one, each piece goes where the sum
over all gaps g of (number of open sequences with gap g) squared becomes smallest. Only the counts per gap matter, so
one placement looks at ``capacity`` numbers at most.

At scale: full pieces need no placing. The others are dealt evenly over groups of at most ``group_pieces``, in any
order, each packed in one task, longest piece first. Sum of squares leaves unfilled sequences at its end; their pieces
are placed anew by best fit, in the group, and then once more together with what as many other groups left as fit one
task. Nothing is gathered beyond a group.

Defined results: a null or empty text is the closing id alone; rows that repeat an id are packed as rows of their own;
an empty table gives no rows.
"""

from __future__ import annotations

import base64
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecraft.llm.common import keep

CAPACITY = 1024
CLOSING_ID = 2
GROUP_PIECES = 250_000
SPECIAL = "<|endoftext|>"
PIECES = 250_000
CACHED_CHUNKS = 300_000
SPECIAL = "<|endoftext|>"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", sequence_id long, offset long"


class Encoder:
    """Byte-level BPE ids of whole texts, as little-endian unsigned 32-bit numbers.

    ``vocabulary`` is a file for the tokenizers library, ``ranks`` the same vocabulary as ranks, which the faster
    library reads; it gives the same ids, except for a text that holds the special token's own text, which goes to the
    tokenizers library.
    """

    def __init__(self, vocabulary: str, ranks: str, pattern: str):
        import tiktoken

        with open(ranks, "rb") as lines:
            known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._encode = tiktoken.Encoding(
            "bytes", pat_str=pattern, mergeable_ranks=known, special_tokens={}
        ).encode_ordinary
        self._vocabulary = vocabulary
        self._whole = None

    def __call__(self, text: str) -> bytes:
        if SPECIAL not in text:
            return array("I", self._encode(text)).tobytes()
        if self._whole is None:
            from tokenizers import Tokenizer

            self._whole = Tokenizer.from_file(self._vocabulary)
        return array("I", self._whole.encode(text, add_special_tokens=False).ids).tobytes()


def public_encoder() -> Encoder:
    import public_tokenizers as files

    return Encoder(files.path("byte_bpe_50k.json"), files.path("byte_bpe_50k.tiktoken"), files.PATTERN)


def cuts(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``total`` ids."""
    first = total % capacity or min(total, capacity)
    return [(0, first), *((at, capacity) for at in range(first, total, capacity))]


def _cut(make_encoder: callable, capacity: int, with_ids: bool) -> callable:
    closing = array("I", [CLOSING_ID]).tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = make_encoder()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows, ids = [], []
                part = batch.slice(at, 256)
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    packed = encode(text or "") + closing
                    for number, (start, length) in enumerate(cuts(len(packed) // 4, capacity)):
                        own = packed[4 * start : 4 * (start + length)]
                        rows.append((doc_id, number, start, length, zlib.crc32(own)))
                        if with_ids:
                            ids.append(np.frombuffer(own, np.uint32).astype(np.int32))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), *[pa.int64()] * 3), strict=True)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                if rows:
                    yield pa.record_batch(columns, names)

    return cut


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence and offset of each piece, and the gap that each sequence is left with.

    Ties go to the sequence that the piece fills most; of sequences with equal gaps, to the last opened.
    """
    open_count = np.zeros(capacity + 1, np.int64)
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    gaps: list[int] = []
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for at, length in enumerate(lengths.tolist()):
        # Sum of squares after placing into a sequence of gap g, less the sum before: 2 (n[g - length] - n[g] + 1).
        before = open_count[length:]
        change = open_count[: capacity + 1 - length] - before + 1
        # A sequence that is filled leaves the counts; half a unit more than the others, rounded up.
        change[0] = 1 - before[0]
        change[before == 0] = capacity * len(lengths) + 1
        best = int(change.argmin())
        if change[best] <= open_count[capacity - length]:
            gap = best + length
            number = by_gap[gap].pop()
            open_count[gap] -= 1
        else:
            gap, number = capacity, len(gaps)
            gaps.append(capacity)
        sequence[at], offset[at] = number, capacity - gap
        gaps[number] = left = gap - length
        if left:
            open_count[left] += 1
            by_gap[left].append(number)
    return sequence, offset, np.array(gaps, np.int64)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``sum_of_squares``, but each piece, longest first, goes where it leaves the smallest gap."""
    open_count = np.zeros(capacity + 1, bool)
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    gaps: list[int] = []
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for at in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[at])
        best = int(open_count[length:].argmax())
        if open_count[length + best]:
            gap = length + best
            number = by_gap[gap].pop()
            open_count[gap] = bool(by_gap[gap])
        else:
            gap, number = capacity, len(gaps)
            gaps.append(capacity)
        sequence[at], offset[at] = number, capacity - gap
        gaps[number] = left = gap - length
        if left:
            by_gap[left].append(number)
            open_count[left] = True
    return sequence, offset, np.array(gaps, np.int64)


def placed_pieces(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sum of squares, longest piece first; the pieces of unfilled sequences are then placed anew by best fit."""
    order = np.argsort(-lengths, kind="stable")
    sequence, offset = np.empty_like(lengths), np.empty_like(lengths)
    sequence[order], offset[order], gaps = sum_of_squares(lengths[order], capacity)
    loose = gaps[sequence] > 0
    if loose.any():
        renumbered = np.cumsum(gaps == 0) - 1
        sequence[~loose] = renumbered[sequence[~loose]]
        filled = int((gaps == 0).sum())
        own, offset[loose], gaps = best_fit(lengths[loose], capacity)
        sequence[loose] = own + filled
        gaps = np.concatenate([np.zeros(filled, np.int64), gaps])
    return sequence, offset, gaps


def _place(capacity: int, round_number: int) -> callable:
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches) if (batches := [b for b in batches if b.num_rows]) else None
        if table is None:
            return
        table = table.combine_chunks()
        lengths = table.column("length").to_numpy()
        sequence, offset, gaps = placed_pieces(lengths, capacity)
        base = (round_number << 60) + (TaskContext.get().partitionId() << 32)
        table = table.append_column("sequence_id", pa.array(sequence + base))
        table = table.append_column("offset", pa.array(offset)).append_column("gap", pa.array(gaps[sequence]))
        yield from table.to_batches(max_chunksize=20_000)

    return place


def tokenized(docs: DataFrame, encoder: callable = public_encoder, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of all documents: doc_id, piece, start, length, ids_crc32 and, if wanted, the ids themselves."""
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return plain.mapInArrow(_cut(encoder, capacity, with_ids), PIECES + (", ids array<int>" if with_ids else ""))


def pack(docs: DataFrame, encoder: callable = public_encoder, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Place all pieces: the columns of ``tokenized`` with sequence_id and offset (gapless from 0 in each sequence)."""
    pieces = keep(tokenized(docs, encoder, capacity, id_col, text_col, with_ids), "pieces")
    schema = PLACED + (", ids array<int>" if with_ids else "")
    names = [field.split()[0] for field in schema.split(", ")]
    keyed = [c for c in names if c not in ("sequence_id", "offset")]
    full = pieces.filter(F.col("length") == capacity).withColumns(
        {"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")}
    )
    rest = pieces.filter(F.col("length") < capacity).select(*keyed)
    groups = -(-rest.count() // group_pieces) or 1
    placed_schema = ", ".join(f for f in schema.split(", ") if f.split()[0] in keyed) + ", sequence_id long, offset long, gap long"
    placed = keep(rest.repartition(groups).mapInArrow(_place(capacity, 0), placed_schema), "placed")
    out = full.select(*names)
    if groups > 1:
        left = placed.filter("gap > 0").select(*keyed)
        again = -(-left.count() // group_pieces) or 1
        again = left.repartition(again).mapInArrow(_place(capacity, 1), placed_schema)
        out = out.union(placed.filter("gap = 0").select(*names)).union(keep(again, "placed-again").select(*names))
    else:
        out = out.union(placed.select(*names))
    return out
