from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tablecraft.llm import range_coder
from tablecraft.llm import token_files as m


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(5)
    parts = ["the", "The ", "\n", "\t\x0b\x0c\r", "don't", "É", "é", "12", "<|endoftext|>", "<|startoftext|>x", "中文", " ", " ", "\x1c", "\x85", "İstanbul", "ΟΔΟΣ", "ß", "'s", "I'LL", "\U0001f600", "́", "--", "ﬁ", "‍", "﻿"]
    return ["".join(rng.choice(parts) + rng.choice(["", " ", ""]) for _ in range(rng.choice([1, 3, 9, 60]))) for _ in range(3000)]


def test_stretches_give_the_ids_of_whole_texts(tokenizer, odd_texts):
    encode = m.public_encoder()
    ids, lengths = encode(odd_texts)
    for text, own in zip(odd_texts, np.split(ids, np.cumsum(lengths)[:-1]), strict=True):
        assert own.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)
    assert [v.tolist() for v in encode(["", " \n"])] == [[], [0, 0]]


def test_plain_stretches_share_calls(tokenizer, odd_texts, monkeypatch):
    encode = m.public_encoder()
    apart, counted = encode._apart, []
    monkeypatch.setattr(encode, "_apart", lambda stretches: counted.extend(stretches) or apart(stretches))
    rng = random.Random(6)
    plain = ["".join(chr(rng.randrange(33, 127)) for _ in range(rng.randint(1, 12))) + rng.choice(["", "\x1c", "\x1f", "\x00", "\x7f"]) for _ in range(20_000)]
    plain += [c + rng.choice(["", "a", "é", "'S"]) + d for c in map(chr, range(0xC0, 0x100)) for d in "xÀß×!"] + ["'s", "''s", "I'LL", "<|", "|>", "</w>", "a</w>"]
    texts = [" ".join(plain[at : at + 50]) for at in range(0, len(plain), 50)] + odd_texts[:200] + ["<|endoftext|>", "a<|startoftext|>b"]
    ids, lengths = encode(texts)
    for text, own in zip(texts, np.split(ids, np.cumsum(lengths)[:-1]), strict=True):
        assert own.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)
    # Only what has characters beyond these or holds a special token goes through the library by itself.
    assert counted and all(b"<|" in s or any(c > "ÿ" or "\x7f" < c < "À" for c in s.decode()) for s in counted)
    known = set(encode._known)
    assert {p.encode() for p in plain} <= known and not {p.encode() for p in plain} & set(counted)


@pytest.mark.parametrize("vocabulary", [1, 2, 700, 49_408, 1 << 20])
@pytest.mark.parametrize("steps,lanes", [(1, 1), (2, 3), (31, 4), (33, 5), (2048, 2), (700, 40)])
def test_coder_round_trip(vocabulary, steps, lanes):
    rng = np.random.default_rng(steps * lanes)
    kinds = [rng.integers(0, vocabulary, (steps, lanes)), np.minimum(rng.zipf(1.3, (steps, lanes)), vocabulary) - 1]
    kinds += [np.zeros((steps, lanes), int), np.full((steps, lanes), vocabulary - 1), (np.arange(steps)[:, None] + np.zeros(lanes, int)) % min(vocabulary, 7)]
    for ids in kinds:
        coded = range_coder.encode(ids, vocabulary)
        assert (range_coder.decode(coded, steps, vocabulary) == ids).all()


def test_blocks_stand_alone():
    rng = np.random.default_rng(1)
    ids = np.minimum(rng.zipf(1.2, 30_000), 5000) - 1
    blocks = m.pack_blocks(ids.astype(np.uint32), 5000, 2048)
    for n in (0, 7, len(blocks) - 1):
        assert (m.unpack_blocks([blocks[n]], 5000)[0] == ids[n * 2048 : (n + 1) * 2048]).all()
    assert (np.concatenate(m.unpack_blocks(blocks[::-1], 5000)[::-1]) == ids).all()


def test_repeated_ids_take_few_bytes():
    ids = np.tile(np.arange(64, dtype=np.uint32) * 11, 64)
    assert sum(map(len, m.pack_blocks(ids, 49_408, 2048))) < 0.25 * 2 * len(ids)


def test_damage_is_found():
    block = m.pack_blocks(np.arange(500, dtype=np.uint32), 1000, 500)[0]
    for at in range(0, len(block), 7):
        if 6 <= at < 8:
            continue
        bad = bytearray(block)
        bad[at] ^= 4
        with pytest.raises(ValueError):
            m.unpack_blocks([bytes(bad)], 1000)
    with pytest.raises(ValueError):
        m.unpack_blocks([block[:10]], 1000)


def test_joined_checksums():
    rng, zeros = np.random.default_rng(3), m.zero_bits()
    for _ in range(60):
        a, b = rng.bytes(int(rng.integers(0, 300))), rng.bytes(int(rng.integers(0, 5000)))
        assert m.joined_crc32(zlib.crc32(a), zlib.crc32(b), len(b), zeros) == zlib.crc32(a + b)


def expected(pairs, tokenizer):
    out, start = [], 0
    for doc_id, text in sorted(pairs, key=lambda p: (p[0] is not None, p[0])):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    return out


def test_files_round_trip(spark, tokenizer, odd_texts):
    rng = random.Random(8)
    pairs = [(n, t) for n, t in enumerate(odd_texts[:300])] + [(1000 + n, "word and more " * rng.choice([0, 1, 500, 4000])) for n in range(12)]
    rng.shuffle(pairs)
    frame = spark.createDataFrame(pairs, "doc_id long, text string").repartition(5)
    for block, file_bytes in ((2048, 1 << 25), (100, 1 << 14)):
        rows = sorted(m.write_and_read(frame, with_ids=True, block=block, file_bytes=file_bytes).collect(), key=lambda r: r.start)
        assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32, r.ids) for r in rows] == expected(pairs, tokenizer)


def test_id_types_and_repeated_ids(spark, tokenizer):
    pairs = [("a-1", "one two"), ("a-1", "one two"), ("b", None), (None, "x"), ("a-1", "three")]
    frame = spark.createDataFrame(pairs, "doc_id string, text string").coalesce(1)
    rows = sorted(m.write_and_read(frame, with_ids=True).collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32, r.ids) for r in rows] == expected(pairs, tokenizer)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = sorted(m.write_and_read(odd_docs).collect(), key=lambda r: r.start)
    assert len(rows) == odd_docs.count()
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in rows[:2]] == [None, None]
    assert [r.n_tokens for r in rows if r.doc_id in (0, 1, 2)] == [1, 1, 1]
    assert m.write_and_read(no_docs).count() == 0
