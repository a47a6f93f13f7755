from __future__ import annotations

import random
import zlib
from collections import Counter

import pytest

from tablecraft.llm import sharding as m


@pytest.mark.parametrize("hot", [False, True])
def test_sizes_are_near_equal_and_slots_gapless(spark, hot):
    rng = random.Random(1)
    rows = []
    for i in range(6000):
        text = "same text " * 30 if hot and i % 3 == 0 else "x" * int(rng.lognormvariate(5, 1))
        rows.append((i, text, rng.choice(["en", "de"]), f"src{i % 3 and i % 7}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    placed = m.slots(m.partition(docs)).collect()
    assert len(placed) == len(rows)
    size = Counter()
    for r in placed:
        size[r.shard] += r.size
    assert sorted(size) == list(range(24))
    assert max(size.values()) <= 1.05 * sum(size.values()) / 24
    for shard, n in Counter(r.shard for r in placed).items():
        assert sorted(r.slot for r in placed if r.shard == shard) == list(range(n))
    texts = {r[0]: r[1] for r in rows}
    assert all(r.size == len(texts[r.doc_id]) + 8 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in placed)


def test_splits_follow_the_widest_dimension(spark):
    rows = [(i, "y" * 100, "en", "s") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    wide = m.partition(docs, shards=4, dimensions={"id": m.F.col("doc_id") * 100, "flat": m.F.lit(5)})
    shards = {r.doc_id: r.shard for r in wide.collect()}
    assert [shards[i] for i in range(400)] == [i // 100 for i in range(400)]


def test_splits_of_unequal_texts_follow_the_widest_dimension(spark):
    rows = [(i, f"{i:0100d}", "en", "s") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    wide = m.partition(docs, shards=4, dimensions={"id": m.F.col("doc_id") * 100, "flat": m.F.lit(5)})
    shards = {r.doc_id: r.shard for r in wide.collect()}
    assert [shards[i] for i in range(400)] == [i // 100 for i in range(400)]


def test_equal_texts_share_a_shard(spark):
    rng = random.Random(4)
    texts = ["t%d " % i * int(rng.lognormvariate(3, 0.6)) for i in range(1500)]
    texts += [t for t in texts[:100] for _ in range(rng.randint(1, 60))]
    rng.shuffle(texts)
    rows = [(i, t, rng.choice(["en", "de", None]), f"src{rng.randint(0, 9)}") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    size, places = Counter(), {}
    for r in m.partition(docs).collect():
        size[r.shard] += r.size
        places.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert [t for t, found in places.items() if len(found) > 1] == []
    mean = sum(size.values()) / 24
    assert 0.95 * mean <= min(size.values()) and max(size.values()) <= 1.05 * mean


def test_heavy_groups_are_cut_only_where_they_fit_in_no_shard():
    def groups(*counts):
        return [{"__group": i, "__bytes": n * 10, "__rows": n} for i, n in enumerate(counts)]

    assert m._heavy_pieces(groups(60, 50, 40), 500.0, 3) == ([(0, 0, 50, 0), (0, 50, 60, 1), (1, 0, 50, 2), (2, 0, 40, 1)], [500.0, 500.0, 500.0])
    pieces, load = m._heavy_pieces(groups(80, 80, 80, 60), 1000.0, 3)
    assert [p[0] for p in pieces].count(3) > 1 and {p[0] for p in pieces[:3]} == {0, 1, 2} and load == [1000.0] * 3
    assert m._heavy_pieces([], 0.0, 2) == ([], [0.0, 0.0])


def test_odd_rows(odd_docs, no_docs):
    placed = m.slots(m.partition(odd_docs, shards=3)).collect()
    assert len(placed) == odd_docs.count()
    assert {r.size for r in placed if r.doc_id in (0, 1)} == {8}
    assert {r.text_crc32 for r in placed if r.doc_id in (0, 1)} == {0}
    assert m.slots(m.partition(no_docs)).count() == 0
    assert {r.shard for r in m.partition(odd_docs, shards=1).collect()} == {0}


def test_written_shards_hold_all_rows(spark, tmp_path):
    docs = spark.createDataFrame([(i, "z" * (i % 50), "en", "s") for i in range(300)], "doc_id long, text string, lang string, source string")
    m.write_shards(docs, str(tmp_path / "out"), shards=4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 300 and back.select("shard").distinct().count() == 4


def test_written_shards_with_repeated_ids_and_a_shard_column(spark, tmp_path):
    docs = spark.createDataFrame(
        [(i % 7 or None, f"t{i % 20}" if i % 3 else None, "en", "s", "x", i) for i in range(400)],
        "doc_id long, text string, lang string, source string, shard string, row int",
    )
    m.write_shards(docs, str(tmp_path / "out"), shards=4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.row for r in back.collect()) == list(range(400)) and set(back.columns) == {*docs.columns}
