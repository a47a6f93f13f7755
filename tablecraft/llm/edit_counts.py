"""Edit-aware token counts with a segment tree of pre-tokens per document.

A text's pre-tokens (the vocabulary's own pattern) are kept with their lengths and token counts, in runs of ``RUN``
pre-tokens, under a tree of sums. An edit touches the pre-tokens it overlaps and two before it; from there the text is
split anew until a boundary behind the edit falls on an old one, from where everything stays as it was. Only what lies
between is encoded again, and only the sums above the touched runs change.

State of a document: its text, and the arrays ``lengths`` and ``counts`` of its pre-tokens; the tree is built from them
with additions alone. Edits are (start, length, text) in code points of the text as it is when they come, in order.

Defined results: a null text is empty and has no pre-tokens; null edits change nothing; an edit beyond the end is cut to
it; repeated rows are documents of their own.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecraft.llm.common import lists

RUN = 64
CACHED_PIECES = 400_000
STATE = "doc_id long, text string, lengths array<int>, counts array<int>"
EDITS = "array<struct<start:int,length:int,text:string>>"
RESULT = STATE + ", n_before long, n_tokens long, n_pretokens long, n_encoded long"


class Counter(dict):
    """Token counts of pre-tokens, remembered up to a bound, and the pattern that finds pre-tokens."""

    def __init__(self, ranks: str, pattern: str):
        import regex
        import tiktoken

        super().__init__()
        with open(ranks, "rb") as lines:
            known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._encode = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=known, special_tokens={}).encode_ordinary
        self.pattern = regex.compile(pattern)

    def __missing__(self, piece: str) -> int:
        if len(self) >= CACHED_PIECES:
            self.clear()
        count = self[piece] = len(self._encode(piece))
        return count

    def pieces(self, text: str) -> tuple[list[int], list[int]]:
        """Lengths and token counts of all pre-tokens."""
        found = self.pattern.findall(text)
        return list(map(len, found)), list(map(self.__getitem__, found))


def public_counter() -> Counter:
    import public_tokenizers as files

    return Counter(files.path("byte_bpe_50k.tiktoken"), files.PATTERN)


class TokenTree:
    """Pre-tokens of a text in runs, under a tree of sums of lengths and of token counts."""

    def __init__(self, text: str, lengths: list[int], counts: list[int], counter: Counter):
        self.text, self._counter = text, counter
        self.encoded = 0
        self._build(lengths, counts)

    def _build(self, lengths: list[int], counts: list[int]) -> None:
        self.runs = [(lengths[i : i + RUN], counts[i : i + RUN]) for i in range(0, len(lengths), RUN)] or [([], [])]
        self.leaves = 1 << (len(self.runs) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.leaves), [0] * (2 * self.leaves)
        for number, (own_lengths, own_counts) in enumerate(self.runs):
            self.chars[self.leaves + number], self.tokens[self.leaves + number] = sum(own_lengths), sum(own_counts)
        for node in range(self.leaves - 1, 0, -1):
            self._sum(node)

    def _sum(self, node: int) -> None:
        self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
        self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def _find(self, place: int) -> tuple[int, int]:
        """The run that holds the character at ``place`` (the last run at the end), and the run's first character."""
        node, before = 1, 0
        while node < self.leaves:
            node *= 2
            if place - before >= self.chars[node] and self.chars[node + 1]:
                before += self.chars[node]
                node += 1
        return min(node - self.leaves, len(self.runs) - 1), before

    def _set(self, run: int, lengths: list[int], counts: list[int]) -> None:
        self.runs[run] = (lengths, counts)
        node = self.leaves + run
        self.chars[node], self.tokens[node] = sum(lengths), sum(counts)
        while node > 1:
            node //= 2
            self._sum(node)

    def edit(self, start: int, length: int, text: str) -> None:
        """Replace ``length`` characters from ``start`` by ``text``."""
        start = min(max(start, 0), len(self.text))
        length = min(max(length, 0), len(self.text) - start)
        # Two pre-tokens before the touched one, which may lie in runs before.
        run, first = self._find(start)
        bounds = list(accumulate(self.runs[run][0], initial=first))
        inside = max(sum(b <= start for b in bounds[:-1]) - 1, 0)
        head = inside - 2
        while head < 0 and run:
            run -= 1
            first -= self.chars[self.leaves + run]
            head += len(self.runs[run][0])
        head = max(head, 0)
        lengths, counts = self.runs[run]
        begin = first + sum(lengths[:head])
        new = self.text[:start] + text + self.text[start + length :]
        shift = len(text) - length
        # Old boundaries from the touched run on, as far as they are needed.
        touched, old, at = run, begin, head
        own_lengths, own_counts = [], []
        place = begin
        matches = self._counter.pattern.finditer(new, begin)
        end = start + len(text)
        while True:
            # Does an old boundary lie here, behind the edit?
            while old + shift < place or old < start + length:
                while touched < len(self.runs) and at >= len(self.runs[touched][0]):
                    touched, at = touched + 1, 0
                if touched == len(self.runs):
                    break
                old += self.runs[touched][0][at]
                at += 1
            if place >= end and old + shift == place and old >= start + length:
                break
            match = next(matches, None)
            if match is None:
                break
            place = match.end()
            own_lengths.append(place - match.start())
            own_counts.append(self._counter[match.group()])
            self.encoded += 1
        last = min(touched, len(self.runs) - 1)
        tail = self.runs[last] if touched < len(self.runs) else ([], [])
        if touched == len(self.runs):
            at = 0
        merged = (lengths[:head] + own_lengths, counts[:head] + own_counts)
        if last == run:
            merged = (merged[0] + tail[0][at:], merged[1] + tail[1][at:])
        else:
            for between in range(run + 1, last):
                self._set(between, [], [])
            self._set(last, tail[0][at:], tail[1][at:])
        self.text = new
        self._set(run, *merged)
        if len(merged[0]) > 4 * RUN:
            self._build(*self.arrays())

    def arrays(self) -> tuple[list[int], list[int]]:
        return [n for own, _ in self.runs for n in own], [n for _, own in self.runs for n in own]


def _state(make_counter: callable) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = make_counter()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [counter.pieces(t or "") for t in part.column("text").to_pylist()]
                arrays = [lists([np.array(f[side], np.int32) for f in found], pa.int32()) for side in (0, 1)]
                yield pa.record_batch([part.column("doc_id"), part.column("text"), *arrays], ["doc_id", "text", "lengths", "counts"])

    return run


def trees(docs: DataFrame, counter: callable = public_counter, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The state of every document: doc_id, text, lengths and counts of its pre-tokens."""
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return plain.mapInArrow(_state(counter), STATE)


def _edited(make_counter: callable) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = make_counter()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts, lengths, counts, numbers = [], [], [], []
                for text, own, own_counts, edits in zip(
                    part.column("text").to_pylist(), part.column("lengths"), part.column("counts"), part.column("edits").to_pylist(), strict=True
                ):
                    tree = TokenTree(text or "", own.as_py() or [], own_counts.as_py() or [], counter)
                    before = tree.total
                    for edit in edits or []:
                        if edit is not None:
                            tree.edit(edit["start"] or 0, edit["length"] or 0, edit["text"] or "")
                    new_lengths, new_counts = tree.arrays()
                    texts.append(tree.text)
                    lengths.append(np.array(new_lengths, np.int32))
                    counts.append(np.array(new_counts, np.int32))
                    numbers.append((before, tree.total, len(new_lengths), tree.encoded))
                columns = zip(*numbers, strict=True) if numbers else [[]] * 4
                yield pa.record_batch(
                    [part.column("doc_id"), pa.array(texts, pa.string()), lists(lengths, pa.int32()), lists(counts, pa.int32()), *(pa.array(c, pa.int64()) for c in columns)],
                    [f.split()[0] for f in RESULT.split(", ")],
                )

    return run


def apply_edits(state: DataFrame, edits: Column | str = "edits", counter: callable = public_counter) -> DataFrame:
    """New state of documents after ``edits`` (a column of ``EDITS``), with the counts before and after.

    Adds n_before, n_tokens, n_pretokens and n_encoded (pre-tokens encoded again).
    """
    column = F.col(edits) if isinstance(edits, str) else edits
    plain = state.select("doc_id", "text", "lengths", "counts", column.cast(EDITS).alias("edits"))
    return plain.mapInArrow(_edited(counter), RESULT)


def sample_edits(text: Column) -> Column:
    """Three edits that depend on a text alone: a word doubled at a quarter, a cut in the middle, a passage at the end."""
    text = F.coalesce(text, F.lit(""))
    size = F.length(text)

    def edit(start: Column, length: Column, new: Column) -> Column:
        return F.struct(start.cast("int").alias("start"), length.cast("int").alias("length"), new.alias("text"))

    return F.array(
        edit(F.floor(size / 4), F.lit(0), F.substring(text, 1, 7)),
        edit(F.floor(size / 2), F.least(F.lit(20), F.floor(size / 8)), F.lit("")),
        edit(F.floor(3 * size / 4), F.lit(3), F.concat(F.lit(" \n"), F.substring(text, 3, 12), F.lit("'s 12  "))),
    )
