from __future__ import annotations

import random

import numpy as np
import pytest

from tablecraft.llm import ngram_join as m
from tablecraft.llm.components import components


def sets_of(texts, size):
    out = {}
    for i, text in texts.items():
        words = (text or "").encode().lower().split()
        out[i] = frozenset(tuple(words[j : j + size]) for j in range(max(1, len(words) - size + 1))) if words else frozenset()
    return out


def brute(texts, size, over, under):
    sets = sets_of(texts, size)
    parent = {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and under * len(sets[a] & sets[b]) >= over * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def family(rng, base, copies, edits, vocabulary):
    out = []
    for _ in range(copies):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            at = rng.randrange(len(words))
            kind = rng.random()
            if kind < 0.6:
                words[at] = rng.choice(vocabulary)
            elif kind < 0.8:
                words.insert(at, rng.choice(vocabulary))
            elif len(words) > 1:
                del words[at]
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize(("size", "over"), [(3, 90), (5, 80), (2, 60)])
def test_components_equal_brute_force(spark, size, over):
    rng = random.Random(size)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = []
    for n in (4, 9, 20, 60, 150):
        base = [rng.choice(vocabulary) for _ in range(n)]
        texts += family(rng, base, 40, 6, vocabulary)
        # A second base that all its own copies share, inside the first family.
        second = family(rng, base, 1, 6, vocabulary)[0].split()
        texts += family(rng, second, 30, 4, vocabulary)
    texts += [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 80))) for _ in range(60)]
    texts += ["", None, "W1 w2", "w1  W2\n", "É w2", "é w2"]
    rng.shuffle(texts)
    docs = dict(enumerate(texts))
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in m.ngram_join(frame, size, over, 100).collect()}
    assert got == brute(docs, size, over, 100)


def test_crowded_places_get_hubs_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(m, "PAIRED_MEMBERS", 1)
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(50)]
    base = [rng.choice(vocabulary) for _ in range(60)]
    texts = family(rng, base, 120, 5, vocabulary)
    docs = dict(enumerate(texts))
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in m.ngram_join(frame, 3, 90, 100).collect()}
    assert got == brute(docs, 3, 90, 100)


def test_sets_have_one_hub_a_band(spark):
    places = {k: (3, range(k, k + 8)) for k in range(12)} | {100: (4, range(8)), 101: (4, range(50, 58)), 102: (5, range(50, 57))}
    rows = [(place, sid, band, len(sids)) for place, (band, sids) in places.items() for sid in sids]
    crowds = spark.createDataFrame(rows, "place long, sid long, band int, company long").coalesce(1)
    hubs = {}
    for r in m._family_spokes(crowds).collect():
        hubs.setdefault(r.sid, set()).add(r.hub)
    # Crowds that overlap in band 3 have one hub: the set in most of them, with most company.
    assert all(len(hubs[sid]) == 1 for sid in range(8, 19) if sid in hubs) and all(len(own) <= 2 for own in hubs.values())
    for _, sids in places.values():
        assert set.intersection(*(hubs.get(sid, set()) | {sid} for sid in sids))
    assert len(set().union(*hubs.values())) <= 4


def test_sets_without_a_partner_in_their_family_meet_no_hub(spark, monkeypatch):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(140)]

    def edited(number, edits):
        words = list(base)
        for at in rng.sample(range(140), edits):
            words[at] = f"x{number}y{at}"
        return " ".join(words)

    # All share signatures with many others; those of 12 edits are linked with nothing, those of one with each other.
    docs = {n: edited(n, 12 if n < 300 else 1) for n in range(320)}
    stored, keep = {}, m.keep

    def counted(df, purpose):
        kept = keep(df, purpose)
        stored[purpose] = stored.get(purpose, 0) + kept.count()
        return kept

    monkeypatch.setattr(m, "keep", counted)
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in m.ngram_join(frame, 5, 80, 100).collect()}
    assert got == brute(docs, 5, 80, 100)
    assert 0 < stored["spokes"] <= 20


@pytest.mark.parametrize(("over", "under"), [(90, 100), (80, 100), (2, 3)])
def test_linked_sets_of_a_family_share_a_rare_crowd(spark, over, under):
    rng = random.Random(over)
    base = list(range(90))
    sets = {n: {*base} - set(rng.sample(base, k := rng.randint(0, 14))) | {rng.randrange(100, 140) for _ in range(k)} for n in range(60)}
    crowds = spark.createDataFrame([(1, n, 7, 60) for n in sets], "place long, sid long, band int, company long")
    frame = spark.createDataFrame([(n, sorted(own)) for n, own in sets.items()], "sid long, items array<long>")
    places = {}
    for r in m._rare_crowds(crowds, frame, over, under).collect():
        places.setdefault(r.sid, set()).add(r.place)
    linked = [(a, b) for a in sets for b in sets if a < b and under * len(sets[a] & sets[b]) >= over * len(sets[a] | sets[b])]
    assert linked and all(places[a] & places[b] for a, b in linked)


@pytest.mark.parametrize(("over", "under"), [(90, 100), (80, 100), (3, 4)])
def test_linked_sets_share_a_signature(over, under):
    rng = np.random.default_rng(1)
    for _ in range(300):
        size = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
        drop = int(rng.integers(0, max(1, (under - over) * len(a) // under) + 1))
        add = int(rng.integers(0, max(1, drop + 1)))
        b = np.unique(np.concatenate([a[drop:], rng.integers(0, 2**63, add).astype(np.uint64)]))
        common = len(np.intersect1d(a, b))
        if not len(b) or under * common < over * (len(a) + len(b) - common):
            continue
        limits = m.bands(2 * max(len(a), len(b)), over, under)
        assert set(m.signatures(a, over, under, limits).tolist()) & set(m.signatures(b, over, under, limits).tolist())


def test_bands_hold_partners_in_neighbours():
    limits = m.bands(5000, 90, 100)
    where = {n: i for i, (low, high) in enumerate(limits) for n in range(low, high + 1)}
    for n in range(1, 4000):
        assert where[n * 100 // 90] - where[n] in (0, 1)


def test_odd_rows(odd_docs, no_docs):
    rows = m.ngram_join(odd_docs, 5, 80, 100).collect()
    assert len(rows) == odd_docs.count()
    found = {(r.doc_id, r.n_shingles): r.component_id for r in rows}
    assert found[(0, 0)] == 0 and found[(2, 0)] == 2
    assert found[(6, 2)] == 5 and found[(5, 2)] == 5
    assert found[(3, 1)] == 3
    assert sum(r.doc_id is None for r in rows) == 2
    assert m.ngram_join(no_docs).count() == 0


def test_one_of_each_keeps_the_smallest(odd_docs):
    kept = m.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 6 not in ids and 5 in ids and 8 not in ids and 7 in ids and 0 in ids


def test_components_of_long_paths(spark):
    links = [(i, i + 1) for i in range(200)] + [(500, 400), (400, 300), (7, 7), (None, 3)]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert found == {**{i: 0 for i in range(201)}, 300: 300, 400: 300, 500: 300}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_one_of_each_tells_rows_of_one_id_apart(spark):
    a, b = (" ".join(f"{p}{i}" for i in range(40)) for p in "ab")
    rows = [(1, a), (5, a), (5, b), (5, b), (None, a), (7, None), (7, a + " more")]
    kept = m.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(str, kept.collect())) == sorted(map(str, spark.createDataFrame([(1, a), (5, b), (5, b), (None, a), (7, None)], kept.schema).collect()))
