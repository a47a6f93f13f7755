from __future__ import annotations

import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from tablecraft.llm import filter_audit as m

DOCS = "doc_id long, text string, source string"
LABELS = "doc_id long, quality int, toxic int"


def fails(text: str) -> set[str]:
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = set()
    if len(words) < 200:
        out.add("A")
    if 100 * len(set(words)) < 50 * len(words):
        out.add("B")
    if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text):
        out.add("C")
    if re.search(r"[#$%&*|]", text):
        out.add("D")
    return out


def brute(docs, labels):
    rows = [(i, t or "", s or "") for i, t, s in docs]
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t] = min(least.get(t, i), i)
    parts = {}
    for i, t, s in rows:
        parts.setdefault(s, []).append((i, fails(t) | ({"E"} if i is not None and i > least[t] else set())))
    out = set()
    for part, members in parts.items():
        steps, shapley = [], Counter()
        for order in permutations("ABCDE"):
            left = members
            for at, name in enumerate(order):
                gone = [d for d in left if name in d[1]]
                all_fail = [d for d in members if name in d[1]]
                left = [d for d in left if name not in d[1]]
                shapley[name] += len(gone)
                steps.append(("".join(order), at + 1, name, len(left), len(gone), len(all_fail) - len(gone), sum(d[1] == {name} for d in members), sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone)))
        out |= {(part, o, at, *rest, shapley[name]) for o, at, name, *rest in steps}
    return out


def run(spark, docs, labels):
    frame = m.audit(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(labels, LABELS))
    rows = [tuple(r) for r in frame.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def texts(rng, n):
    words = ["alpha", "Beta", "x#y", "gamma", "é", "CAPS", "&"]
    out = []
    for _ in range(n):
        kind = rng.randrange(6)
        if kind == 0:
            out.append(rng.choice(["", " \t ", None, "short", "same text"]))
        elif kind == 1:
            out.append(" ".join(f"w{rng.randrange(400)}" for _ in range(250)))
        elif kind == 2:
            out.append("Aa bb\x0b" * 130)
        else:
            out.append(" ".join(rng.choice(words) for _ in range(rng.choice([3, 199, 200, 260]))))
    return out


@pytest.mark.parametrize("range_rows", [3, 1024])
def test_every_order_equals_brute_force(spark, monkeypatch, range_rows):
    monkeypatch.setattr(m, "RANGE_ROWS", range_rows)
    rng = random.Random(11)
    docs = [(rng.randrange(90) if rng.random() < 0.95 else None, t, rng.choice(["a", "b", None, "", "hot", "hot", "hot"])) for t in texts(rng, 120)]
    labels = [(n, rng.choice([0, 1, None]), rng.choice([0, 1])) for n in range(0, 90, 2)] + [(4, 1, 1), (None, 1, 1)]
    assert run(spark, docs, labels) == brute(docs, labels)


def test_pattern_sizes_of_random_lists():
    rng = np.random.default_rng(2)
    for _ in range(200):
        size = int(rng.integers(1, 400))
        member = rng.random((5, size)) < rng.random((5, 1)) ** 2
        lists = [np.flatnonzero(own) for own in member]
        want = Counter(int(p) for p in (member * (1 << np.arange(5))[:, None]).sum(0) if p)
        assert m.pattern_sizes(lists) == dict(want)


def test_gallop_finds_the_first_place():
    values = np.cumsum(np.random.default_rng(1).integers(1, 9, 500))
    for at in (0, 3, 499):
        for target in (0, int(values[at]), int(values[at]) + 1, int(values[-1]), int(values[-1]) + 5):
            assert m.gallop(values, target, at) == max(at, int(np.searchsorted(values, target)))


def test_repeats_of_hot_texts(spark):
    rows = [(n, b"hot" if n % 2 else bytes([n % 7])) for n in range(3000)]
    frame = spark.createDataFrame(rows, "id long, same binary")
    found = {r.id: r.repeats for r in m.repeats(frame, "id", "same").collect()}
    least = {}
    for i, key in rows:
        least.setdefault(key, i)
    assert found == {i: i > least[key] for i, key in rows}


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(3, 1, 0)], LABELS)
    rows = m.audit(odd_docs, labels).collect()
    assert {r.part for r in rows} == {"src0", "src1", ""}
    assert len(rows) == 600 * 3
    assert m.audit(no_docs, labels).count() == 0
    assert m.audit(odd_docs, labels.limit(0)).count() == 1800
