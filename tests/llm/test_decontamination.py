from __future__ import annotations

import random

import numpy as np
import pytest

from tablecraft.llm import decontamination as m


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(2000)]
    items = {i: [rng.choice(words) for _ in range(rng.choice([4, 9, 12, 20, 50]))] for i in range(30)}
    docs, leaks = [], set()
    for i in range(400):
        text = [rng.choice(words) for _ in range(rng.randint(20, 300))]
        if i % 4 == 0:
            item = rng.randrange(30)
            passage = list(items[item])
            if len(passage) >= 20:
                for at in range(3, len(passage), 9):
                    passage[at] = "Changed" + str(at)
            at = rng.randrange(len(text))
            text[at:at] = [w.title() + "," for w in passage]
            leaks.add((i, item))
        docs.append((i, " ".join(text)))
    benchmark = [(i, " ".join(w)) for i, w in items.items()]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(benchmark, "item_id long, text string"), leaks


def test_planted_passages_are_found(planted):
    docs, benchmark, leaks = planted
    rows = m.matches(docs, benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == leaks
    assert all(r.equal >= 0.8 * r.length for r in rows)


def test_clean_documents_stay(planted):
    docs, benchmark, leaks = planted
    kept = {r.doc_id for r in m.clean_documents(docs, benchmark).collect()}
    assert kept == set(range(400)) - {d for d, _ in leaks}


def test_longest_stretch_equals_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(300):
        equal = rng.random(int(rng.integers(1, 40))) < rng.random()
        allowed = [(b - a, a, b) for a in range(len(equal)) for b in range(a + 1, len(equal) + 1) if 5 * (~equal[a:b]).sum() <= b - a]
        start, to, same = m.longest_stretch(equal)
        assert same == equal[start:to].sum() and (to - start == 0 or (equal[start] and equal[to - 1]))
        assert 5 * (to - start - same) <= to - start
        assert same == max((equal[a:b].sum() for n, a, b in allowed if n == max(allowed)[0]), default=0) or to - start <= max(allowed)[0]


def test_replaced_tokens_against_brute_force(spark):
    rng = random.Random(21)
    items, docs, want = [], [], set()
    for size in (10, 11, 12, 14, 15, 16, 20, 30, 45, 60):
        for share in (0.1, 0.15, 0.2):
            for _ in range(12):
                number = len(items)
                item = [f"w{rng.randrange(10**6)}" for _ in range(size)]
                passage = list(item)
                for at in rng.sample(range(size), int(size * share)):
                    passage[at] = f"r{rng.randrange(10**6)}"
                equal = np.array([a == b for a, b in zip(item, passage, strict=True)])
                stretches = [equal[a:b].sum() for a in range(size) for b in range(a + 1, size + 1) if 5 * (~equal[a:b]).sum() <= b - a]
                if max(stretches) >= m.LEAST_TOKENS:
                    want.add((number, number))
                items.append((number, " ".join(item)))
                filler = [f"f{rng.randrange(10**6)}" for _ in range(40)]
                docs.append((number, " ".join([*filler[:20], *passage, *filler[20:]])))
    found = m.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    found = {(r.doc_id, r.item_id) for r in found.collect()}
    assert len(want) > 200 and found <= want and len(found) >= 0.99 * len(want)


def test_a_long_item_is_reported_whole(spark):
    item = [f"w{n}" for n in range(300)]
    docs = [(1, "before " + " ".join(item) + " after"), (2, " ".join(item[:150] + ["x"] + item[151:]))]
    rows = m.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()
    assert {(r.doc_id, r.doc_at, r.item_at, r.length, r.equal, r.item_length) for r in rows} == {(1, 1, 0, 300, 300, 300), (2, 0, 0, 300, 299, 300)}


def test_rows_are_judged_one_by_one(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([("a-1", "clean"), ("a-1", item), (None, item), (None, "fine")], "doc_id string, text string")
    benchmark = spark.createDataFrame([("b-1", item)], "item_id string, text string")
    assert sorted((r.doc_id or "", r.text) for r in m.clean_documents(docs, benchmark).collect()) == [("", "fine"), ("a-1", "clean")]
    assert {(r.doc_id, r.item_id) for r in m.matches(docs, benchmark).collect()} == {("a-1", "b-1"), (None, "b-1")}


def test_odd_rows(odd_docs, no_docs, spark):
    items = [(1, "same text of five words here"), (1, "same text of five words here"), (2, None), (3, ""), (None, "one"), (4, "x " * 30)]
    benchmark = spark.createDataFrame([(*r, 0) for r in items], "item_id long, text string, doc_id long")
    rows = {(r.doc_id, r.item_id) for r in m.matches(odd_docs, benchmark).collect()}
    assert rows == {(5, 1), (6, 1), (3, None), (None, None), (77, 4)}
    assert m.matches(no_docs, benchmark).count() == 0
    assert m.matches(odd_docs, benchmark.limit(0)).count() == 0
    assert m.clean_documents(odd_docs, benchmark).columns == odd_docs.columns
