from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tablecraft.llm import token_alignment as m

BASE = [*range(33, 127), *range(161, 173), *range(174, 256)]


@pytest.fixture(scope="module")
def references():
    byte = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    byte.encode_special_tokens = True
    # Characters that stand for the bytes of a byte-level entry.
    chars = {chr(b): b for b in BASE} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in BASE)}
    entries = {n: bytes(chars[c] for c in t) for t, n in byte.get_vocab(with_added_tokens=False).items() if all(c in chars for c in t)}
    return byte, entries, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def tokens(text, references):
    byte, entries, pieces = references
    a = [(i, entries[i]) for i in byte.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in pieces.encode(text):
        piece = pieces.id_to_piece(i)
        b.append((i, bytes([int(piece[3:5], 16)]) if pieces.is_byte(i) else piece.replace("▁", " ").encode()))
    target = (" " + text).encode()
    if not text or b"".join(x for _, x in a) != target or b"".join(x for _, x in b) != target:
        return [], []
    return a, b


def ends(side):
    at, out = 0, []
    for _, own in side:
        at += len(own)
        out.append(at)
    return out


def groups(a, b):
    """Groups by the definition: cut where tokens of both sides end."""
    cuts = sorted(set(ends(a)) & set(ends(b)))
    out = [([], []) for _ in cuts]
    for n, side in enumerate((a, b)):
        for (own, _), end in zip(side, ends(side), strict=True):
            out[int(np.searchsorted(cuts, end))][n].append(own)
    return out


def brute(docs, references):
    found = [(i, *tokens(t or "", references)) for i, t in docs]
    grouped = [groups(a, b) for _, a, b in found]
    links = [Counter((x, y) for ga, gb in own for x in ga for y in gb) for own in grouped]
    count = Counter(pair for own in links for pair in own)
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    rows = []
    for (i, a, b), own, linked in zip(found, grouped, links, strict=True):
        text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in own)
        digest = hashlib.sha256(text.encode()).hexdigest() if a else ""
        n_best = sum(n for p, n in linked.items() if count[p] == best[p[0]])
        rows.append((i, len(a), len(b), len(own), sum(linked.values()), n_best, sum(n * count[p] for p, n in linked.items()), digest))
    return sorted(rows, key=str), {(x, y, n, n == best[x]) for (x, y), n in count.items()}


def run(spark, docs, kind="long", **options):
    frame = spark.createDataFrame(docs, f"doc_id {kind}, text string").repartition(3)
    found, pairs = m.align(frame, **options)
    rows = found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()
    return sorted(map(tuple, rows), key=str), {tuple(r) for r in pairs.select("a", "b", "count", "best").collect()}


PARTS = ["the ", "The", "\n", "  ", "don't ", "é", "É", "12", "<|endoftext|>", "<s>", "</s>", "<0x0A>", "中文", "\t", "İ", "\U0001f600", "́", "--", " ", "naïve ", "unbelievable ", "\r", "a" * 30]


def odd_texts(n, seed=4):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.choice([1, 2, 5, 30]))) for _ in range(n)]


@pytest.mark.parametrize("chunk_links", [1, 300, 1 << 22])
def test_alignment_equals_brute_force(spark, references, chunk_links):
    docs = [*enumerate(odd_texts(150)), (900, None), (901, ""), (902, " "), (903, "x▁y"), (904, "\x00a"), (5, "the same id"), (5, "the same id"), (None, "no id")]
    assert run(spark, docs, chunk_links=chunk_links) == brute(docs, references)


def test_large_groups_and_long_texts(spark, references, monkeypatch):
    monkeypatch.setattr(m, "LARGE_GROUP", 4)
    monkeypatch.setattr(m, "SLICE_LINKS", 50)
    docs = [(n, t * 3) for n, t in enumerate(odd_texts(60, 9))] + [(100, "\U0001f600" * 300 + " end"), (101, "word " * 3000)]
    assert run(spark, docs) == brute(docs, references)


def test_groups_of_random_ranges():
    rng = np.random.default_rng(0)
    for _ in range(200):
        total = int(rng.integers(1, 60))
        ends_a, ends_b = (np.append(np.flatnonzero(rng.random(total - 1) < rng.random()) + 1, total) for _ in range(2))
        cuts = np.intersect1d(ends_a, ends_b)
        found = m.coalesced(ends_a, ends_b)
        assert [g.tolist() for g in found] == [np.searchsorted(cuts, e).tolist() for e in (ends_a, ends_b)]


def test_id_types_and_odd_rows(spark, odd_docs, no_docs, references):
    docs = [("a-1", "one two"), ("a-1", "three"), (None, None)]
    assert run(spark, docs, "string") == brute(docs, references)
    found, pairs = m.align(odd_docs)
    assert found.count() == odd_docs.count()
    found, pairs = m.align(no_docs)
    assert (found.count(), pairs.count()) == (0, 0)
