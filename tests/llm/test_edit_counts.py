from __future__ import annotations

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tablecraft.llm import edit_counts as m

PIECES = ["a", "b ", "  ", "\n", "'s", "don't ", "12", "é", "!", " x", "the ", "   ", "\t", "ß,"]


@pytest.fixture(scope="module")
def counter():
    return m.public_counter()


def test_trees_equal_full_encoding_after_edits(counter):
    rng = random.Random(5)
    for _ in range(1500):
        text = "".join(rng.choice(PIECES) for _ in range(rng.choice([0, 1, 3, 20, 400])))
        tree = m.TokenTree(text, *counter.pieces(text), counter)
        for _ in range(rng.randint(1, 4)):
            start, length = rng.randint(0, len(tree.text)), rng.choice([0, 0, 1, 3, 40])
            new = "".join(rng.choice(PIECES) for _ in range(rng.choice([0, 1, 4, 300])))
            want = tree.text[:start] + new + tree.text[start + length :]
            tree.edit(start, length, new)
            assert tree.text == want
            assert tree.arrays() == counter.pieces(want)
            assert tree.total == sum(counter.pieces(want)[1])


def test_only_the_surroundings_are_encoded(counter):
    text = "word " * 50_000
    tree = m.TokenTree(text, *counter.pieces(text), counter)
    tree.edit(100_000, 3, "new")
    assert tree.encoded < 12


def test_counts_equal_the_tokenizer(spark, odd_docs, no_docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    state = m.trees(odd_docs)
    rows = m.apply_edits(state, m.sample_edits(m.F.col("text"))).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        assert r.n_tokens == len(tokenizer.encode(r.text, add_special_tokens=False).ids) == sum(r.counts)
        assert sum(r.lengths) == len(r.text)
    same = m.apply_edits(state, m.F.lit(None)).collect()
    assert all(r.n_before == r.n_tokens and r.n_encoded == 0 for r in same)
    assert m.apply_edits(m.trees(no_docs), m.F.lit(None)).count() == 0
