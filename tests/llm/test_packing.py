from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tablecraft.llm import packing as m


def check_places(rows, capacity):
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for members in sequences.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    return len(sequences)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_pieces_round_trip(spark, tokenizer):
    rng = random.Random(2)
    words = ["the", " of", "\n", "  ", "don't", "é", "12", "<|endoftext|>", "中文", " x", "\t"]
    texts = {i: "".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 200, 3000]))) for i in range(40)}
    rows = m.pack(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), with_ids=True).collect()
    found = defaultdict(list)
    for r in rows:
        found[r.doc_id].append(r)
    for i, text in texts.items():
        want = tokenizer.encode(text, add_special_tokens=False).ids + [2]
        own = sorted(found[i], key=lambda r: r.piece)
        assert [x for r in own for x in r.ids] == want
        assert [r.piece for r in own] == list(range(len(own)))
        assert all(r.length == 1024 for r in own[1:])
        for r in own:
            part = np.array(want[r.start : r.start + r.length], "<u4").tobytes()
            assert r.ids_crc32 == zlib.crc32(part)
    check_places(rows, 1024)


def test_few_sequences(spark):
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 1024, 20_000)
    sequence, offset, gaps = m.placed_pieces(lengths, 1024)
    assert len(gaps) <= 1.01 * len(m.best_fit(lengths, 1024)[2])
    used = np.zeros(len(gaps), np.int64)
    np.add.at(used, sequence, lengths)
    assert (used + gaps == 1024).all()


def test_sum_of_squares_makes_each_best_choice():
    rng = np.random.default_rng(4)
    capacity = 12
    lengths = rng.integers(1, capacity, 200)
    sequence, _, _ = m.sum_of_squares(lengths, capacity)
    gaps: dict[int, int] = {}

    def cost(values):
        counts = np.bincount([g for g in values if 0 < g], minlength=capacity + 1)
        return int((counts**2).sum())

    for number, length in zip(sequence.tolist(), lengths.tolist(), strict=True):
        options = [cost([g - (k == n) * length for n, g in gaps.items()]) for k, v in gaps.items() if v >= length]
        options.append(cost([*gaps.values(), capacity - length]))
        gaps[number] = gaps.get(number, capacity) - length
        assert cost(gaps.values()) == min(options)


def test_groups_are_packed_again(spark):
    frame = spark.createDataFrame([(i, "word " * (i % 90)) for i in range(600)], "doc_id long, text string")
    rows = m.pack(frame, capacity=100, group_pieces=50).collect()
    assert len({(r.doc_id, r.piece) for r in rows}) == len(rows)
    total = sum(r.length for r in rows)
    assert check_places(rows, 100) <= 1.1 * total / 100


def test_odd_rows(odd_docs, no_docs):
    rows = m.pack(odd_docs).collect()
    check_places(rows, 1024)
    assert [(r.piece, r.length) for r in rows if r.doc_id in (0, 1)] == [(0, 1)] * 2
    assert sum(r.doc_id == 3 for r in rows) == 2
    assert sum(r.doc_id is None for r in rows) == 2
    assert m.pack(no_docs).count() == 0
