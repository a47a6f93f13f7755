from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, sid long, hub string, label string, score string, size string, shard string, seed string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and very long texts, repeated rows, and columns that clash with inner names."""
    long_text = " ".join(f"word{i % 997} and{i % 13}" for i in range(30_000))
    texts = [None, "", " \n\t ", "one", "two words", "same text of five words here", "same text of five words here", long_text, long_text, "a\nb\na\nb\n\nc"]
    rows = [(i, t, "en", "src0", 0) for i, t in enumerate(texts)]
    rows += [(3, "one", "en", "src0", 0), (None, "one", None, None, None), (None, None, None, None, None), (77, "x " * 60, None, "src1", 1)]
    return spark.createDataFrame([(*r, 1, "h", "l", "s", "z", "q", "d") for r in rows], DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
