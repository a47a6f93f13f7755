from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from tablecraft.llm import quality_rules as m
from tablecraft.llm.common import WordHashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + k for i, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if windows[w] > 1 for k in range(3)}
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_statistics_equal_plain_count():
    rng = random.Random(1)
    pieces = ["a", "b", "é", "中", " ", " ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", "#", "|", "a b a b\n", "|x"]
    for _ in range(2000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 40)))
        assert m.text_statistics(text.encode(), WordHashes()) == plain(text)


@pytest.fixture(scope="module")
def judged(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(3000)]

    def clean():
        return "\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(5, 30))) for _ in range(rng.randint(4, 12)))

    rows = [(i, clean(), "en", f"src{i % 3 if i % 2 else 0}") for i in range(1500)]
    rows += [(10_000 + i, " ".join(w + "###" for w in clean().split()), "en", "src0") for i in range(60)]
    rows += [(20_000 + i, " | ".join(clean().split()[:80]), "en", "src1") for i in range(20)]
    rows += [(30_000 + i, clean() + "\n" + "\n".join(["buy now"] * 40), "en", "src2") for i in range(20)]
    rows += [(40_000 + i, clean(), "xx", f"rare{i}") for i in range(30)]
    return m.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()


def test_clean_documents_stay(judged):
    clean = [r for r in judged if (r.doc_id < 10_000 or r.doc_id >= 40_000) and not r.base_failed]
    assert sum(not r.kept for r in clean) <= 0.002 * len(clean)


def test_outliers_go(judged):
    assert not any(r.kept for r in judged if 10_000 <= r.doc_id < 40_000)


def test_few_rows_meet_the_base_rule_only(odd_docs, no_docs):
    rows = m.judge(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[0].n_words == 0 and by_id[0].base_failed and not by_id[0].kept
    assert by_id[9].n_dup_lines == 2
    assert by_id[77].base_failed and by_id[77].n_repeat_words == 60
    assert m.judge(no_docs).count() == 0
    kept = m.good_documents(odd_docs)
    assert kept.columns == odd_docs.columns


def test_rows_of_one_id_are_judged_one_by_one(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    good = [" ".join(rng.choice(words) for _ in range(120)) for _ in range(300)]
    rows = [(i, t, "en", "src") for i, t in enumerate(good)]
    rows += [(3, "too short", "en", "src"), (None, "short as well", "en", None), (None, good[0], "en", "src"), (4, None, None, None)]
    kept = m.good_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert {(3, good[3]), (None, good[0])} <= {(r.doc_id, r.text) for r in kept}
    assert not any(r.text in ("too short", "short as well", None) for r in kept)
    assert kept[0].__fields__ == ["doc_id", "text", "lang", "source"]
