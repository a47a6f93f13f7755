from __future__ import annotations

import random

import numpy as np

from tablecraft.llm import license_scan as m


def test_planted_notices_are_found(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(500)]
    docs, want = [], {}
    for i in range(200):
        text = [rng.choice(words) for _ in range(rng.randint(0, 200))]
        if i % 2:
            name = rng.choice(sorted(m.TEMPLATES))
            passage = m.TEMPLATES[name].split()
            if len(passage) > 12:
                del passage[rng.randrange(len(passage))]
                passage.insert(rng.randrange(len(passage)), "extra")
            at = rng.randint(0, len(text))
            before = " ".join(text[:at])
            text[at:at] = passage
            want[i] = (name, len(before) + (at > 0), len(before) + (at > 0) + len(" ".join(passage)))
        docs.append((i, " ".join(text)))
    rows = m.license_matches(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    found = {(r.doc_id, r.template): r for r in rows}
    for i, (name, start, end) in want.items():
        row = found[i, name]
        assert row.coverage >= 0.8 and start <= row.start_char + 8 and row.end_char <= end and row.start_char < row.end_char
    assert {r.doc_id for r in rows} == set(want)


def test_winnowing_keeps_one_of_each_window():
    rng = np.random.default_rng(1)
    for _ in range(200):
        hashes = rng.integers(0, 30, rng.integers(0, 40)).astype(np.uint64)
        kept = set(m.winnow(hashes, 4).tolist())
        for at in range(len(hashes) - 3):
            own = hashes[at : at + 4]
            assert any(at + k in kept and own[k] == own.min() for k in range(4))
        assert bool(len(hashes)) == bool(kept)


def test_alignment_equals_full_table():
    rng = random.Random(2)
    for _ in range(300):
        template = [rng.randint(0, 5) for _ in range(rng.randint(1, 15))]
        tokens = [rng.randint(0, 5) for _ in range(rng.randint(1, 20))]
        best = 0
        table = [[0] * (len(tokens) + 1) for _ in range(len(template) + 1)]
        for i, a in enumerate(template, 1):
            for j, b in enumerate(tokens, 1):
                table[i][j] = max(0, table[i - 1][j - 1] + (1 if a == b else -1), table[i - 1][j] - 1, table[i][j - 1] - 1)
                best = max(best, table[i][j])
        equal, first, last = m.align(template, tokens, 0, 40)
        assert (equal >= best) and (best == 0 or 0 <= first < last <= len(tokens))


def test_several_places_blocks_and_odd_rows(spark, odd_docs, no_docs, monkeypatch):
    notice = m.TEMPLATES["mit-notice"]
    docs = spark.createDataFrame([(1, f"{notice}\nİ and more\n{notice}", 0)], "doc_id long, text string, hash int")
    rows = sorted((r.start_char, r.end_char) for r in m.license_matches(docs).collect())
    assert rows == [(0, len(notice) - 1), (len(notice) + 12, 2 * len(notice) + 11)]
    monkeypatch.setattr(m, "INDEX_ROWS", 2)
    assert m.license_matches(docs).count() == 2
    templates = spark.createDataFrame([("t", "one"), ("none", None), ("empty", "")], "template string, text string")
    assert sorted(str(r.doc_id) for r in m.license_matches(odd_docs, templates).collect()) == ["3", "3", "None"]
    assert m.license_matches(no_docs).count() == 0


def test_one_edit_at_every_place_is_found(spark):
    docs = []
    for name, text in sorted(m.TEMPLATES.items()):
        words = m.TOKEN.findall(text)
        for at in range(len(words) + 1):
            docs.append((name, "added", [*words[:at], "qq", *words[at:]]))
            if at < len(words) and m.allowed_edits(len(words), m.COVERAGE):
                docs.append((name, "replaced", [*words[:at], "qq", *words[at + 1 :]]))
                docs.append((name, "dropped", [*words[:at], *words[at + 1 :]]))
    rows = [(i, f"zz yy {' '.join(words)} xx ww") for i, (_, _, words) in enumerate(docs)]
    found = {(r.doc_id, r.template) for r in m.license_matches(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(name, kind, words) for i, (name, kind, words) in enumerate(docs) if (i, name) not in found] == []
