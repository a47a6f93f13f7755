from __future__ import annotations

import functools
import itertools
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tablecraft.llm import toxicity as m


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(800)]
    docs, labels = [], []
    for i in range(1500):
        text = [rng.choice(words) for _ in range(rng.randint(10, 80))]
        toxic = i % 8 == 0
        if toxic:
            for _ in range(rng.randint(1, 4)):
                text.insert(rng.randrange(len(text)), rng.choice(["Zmoron", "zidiot", "zzscum" + rng.choice(["a", "ix", "or"])]))
        docs.append((i, " ".join(text) + "."))
        if i % 5:
            labels.append((i, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy(corpus):
    docs, labels = corpus
    scores = {r.doc_id: r for r in m.score_documents(docs, labels).collect()}
    held = [i for i in scores if zlib.crc32(str(i).encode()) % 3 == 1 or i % 5 == 0]
    right = sum((scores[i].score >= 0.7) == (i % 8 == 0) for i in held)
    assert right >= 0.98 * len(held)
    texts = {r.doc_id: r.text for r in docs.collect()}
    marked = [texts[i][s.start : s.end].lower() for i, r in scores.items() for s in r.spans if i % 8 == 0]
    assert marked and all(w.startswith("z") for w in marked)


def test_labels_that_are_held_out_teach_nothing(corpus, spark):
    docs, labels = corpus
    flipped = labels.withColumn("toxic", m.F.when(m.held_out(m.F.col("doc_id")), 1 - m.F.col("toxic")).otherwise(m.F.col("toxic")))
    a, b = ({r.doc_id: r.score for r in m.score_documents(docs, x).collect()} for x in (labels, flipped))
    assert a == b


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(3)
    emission, chain = rng.normal(size=(2, 4)), rng.normal(size=4)
    mask = np.array([[True] * 4, [True] * 3 + [False]])
    marginal, pairs, total = m.forward_backward(emission, mask, chain)
    want_pairs = np.zeros((2, 2))
    for n in range(2):
        length = int(mask[n].sum())
        weights, ones, steps = [], np.zeros(length), np.zeros((2, 2))
        for path in itertools.product((0, 1), repeat=length):
            score = sum(emission[n, t] for t in range(length) if path[t]) + chain[0] * path[0]
            score += sum({(0, 0): 0.0, (0, 1): chain[1], (1, 0): chain[2], (1, 1): chain[3]}[p] for p in itertools.pairwise(path))
            weight = np.exp(score)
            weights.append(weight)
            ones += weight * np.array(path)
            for p in itertools.pairwise(path):
                steps[p] += weight
        assert np.isclose(total[n], np.log(sum(weights)))
        assert np.allclose(marginal[n, :length], ones / sum(weights))
        want_pairs += steps / sum(weights)
    assert np.allclose(pairs, want_pairs)


def test_sentences_that_occur_often_weigh_as_often():
    found, marks = [[(0,), ()], [(), (), ()], [(1,)]], [[1, 0], [0, 0, 0], [0]]
    often = m.fit_chain(found, marks, [3, 5, 2], 2)
    each = m.fit_chain([f for f, n in zip(found, (3, 5, 2), strict=True) for _ in range(n)], [f for f, n in zip(marks, (3, 5, 2), strict=True) for _ in range(n)], [1] * 10, 2)
    assert all(np.allclose(a, b) for a, b in zip(often, each, strict=True))


def test_fitting_takes_few_bytes_a_token(monkeypatch):
    monkeypatch.setattr(m, "fit_flat", functools.partial(m.fit_flat, steps=1))
    monkeypatch.setattr(m, "AT_ONCE", 256)
    sentences, length = 10_000, 20
    rows = {
        "features": pa.array([[[n % 2]] + [[]] * (length - 1) for n in range(sentences)], pa.list_(pa.list_(pa.int32()))),
        "marks": pa.array([[1] + [0] * (length - 1)] * sentences, pa.list_(pa.int32())),
        "times": pa.array([1] * sentences, pa.int64()),
    }
    batch = pa.record_batch(list(rows.values()), list(rows))
    tracemalloc.start()
    try:
        (fitted,) = m._fitted(2)(iter([batch.slice(0, 6000), batch.slice(6000)]))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(fitted.column("weights")[0]) == 3 and most < 50 * sentences * length
    (nothing,) = m._fitted(2)(iter([]))
    assert len(nothing.column("weights")[0]) == 3


def test_sentences_and_spans():
    text = "One bad. two\nbad bad three? " + "x " * 100 + "bad"
    own = [word == "bad" for word in m.TOKEN.findall(text)]
    found = m.sentences(text, own)
    assert [[text[a:b] for a, b in m.token_spans(text, s)] for s in found] == [["One", "bad"], ["bad", "bad", "three"], ["x"] * 4 + ["bad"]]


def test_rows_are_judged_one_by_one(corpus, spark):
    docs, labels = corpus
    twins = spark.createDataFrame([(90_001, "calm words here"), (90_001, "you Zmoron zidiot Zmoron"), (None, "zidiot Zmoron zidiot")], "doc_id long, text string")
    kept = m.decent_documents(docs.union(twins), labels).filter("doc_id is null or doc_id > 90000").collect()
    assert [tuple(r) for r in kept] == [(90_001, "calm words here")]


def test_text_ids(spark):
    docs = spark.createDataFrame([(f"a-{i}", t) for i, t in enumerate(["you moron here", "good words here", "such a moron", "fine"])], "doc_id string, text string")
    labels = spark.createDataFrame([(f"a-{i}", t) for i, t in enumerate([1, 0, 1, 0])], "doc_id string, toxic int")
    assert {r.doc_id for r in m.score_documents(docs, labels).collect()} == {"a-0", "a-1", "a-2", "a-3"}


def test_cover_ignores_what_is_explained():
    found = [[0, 5, 6], [0, 5, 6], [0, 5, 6], [0], [0], [1], [1], [1]]
    assert m.cover(found, [1.0] * 7, 3) == [0, 1]


@pytest.mark.parametrize(("sf", "least"), [("sf0.001", 2), ("sf0.01", 12)])
def test_few_labels_find_toxic_documents(spark, sf, least):
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    scores = [r for r in m.score_documents(docs, labels).collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1 and r.doc_id in toxic]
    assert sum(r.score >= m.THRESHOLD and toxic[r.doc_id] == 1 for r in scores) >= least
    assert sum(r.score >= m.THRESHOLD and toxic[r.doc_id] == 0 for r in scores) <= 1


def test_one_row_of_each_class_fits(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["you moron here", "good words here", "such a moron", None])], "doc_id long, text string")
    free = [i for i in range(4) if zlib.crc32(str(i).encode()) % 3 != 1]
    labels = spark.createDataFrame([(free[0], 1), (free[1], 0)], "doc_id long, toxic int")
    assert m.learn(docs, labels) is not None
    assert m.learn(docs, labels.filter("toxic = 1")) is None
    assert len({r.score for r in m.score_documents(docs, labels).collect()}) > 1


def test_odd_rows(odd_docs, no_docs, corpus, spark):
    _, labels = corpus
    none = m.score_documents(odd_docs, labels.limit(0)).collect()
    assert len(none) == odd_docs.count() and {r.score for r in none} == {0.0}
    docs, _ = corpus
    both = docs.unionByName(odd_docs.select("doc_id", "text"))
    twice = labels.unionByName(labels).unionByName(spark.createDataFrame([(None, 1), (4, None)], "doc_id long, toxic int"))
    rows = m.score_documents(both, twice).collect()
    assert len(rows) == both.count() and all(0 <= r.score <= 1 for r in rows)
    assert m.score_documents(no_docs, labels).count() == 0
    kept = m.decent_documents(odd_docs, labels)
    assert kept.columns == odd_docs.columns
