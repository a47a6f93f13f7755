"""Type-2 history: golden cases, invariants and random lifecycles."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from helpers import rows
from pyspark.sql import functions as F

from tablecraft.operators import cdc
from tablecraft.operators.versions import max_commit_version, scalar

FEED = "user_id string, tier string, _change_type string, _commit_timestamp timestamp, _commit_version bigint"
HISTORY = (
    "user_id string, tier string, effective_start_date timestamp, effective_end_date timestamp, "
    "is_active_record boolean, bronze_commit_version bigint"
)
COLUMNS = [c.strip().split(" ")[0] for c in HISTORY.split(",")]


def at(text):
    """``07-29 17:00`` of 2025."""
    return None if text is None else datetime.strptime(f"2025-{text}", "%Y-%m-%d %H:%M")


def feed_of(spark, events, keys="user_id string"):
    schema = FEED.replace("user_id string", keys)
    return spark.createDataFrame([(*e[:-2], at(e[-2]), e[-1]) for e in events], schema)


def history_of(spark, data, keys="user_id string"):
    schema = HISTORY.replace("user_id string", keys)
    return spark.createDataFrame([(*r[:-4], at(r[-4]), at(r[-3]), r[-2], r[-1]) for r in data], schema)


def same(df, expected):
    assert rows(df.select(*expected.columns)) == rows(expected)


# Golden values of the history contract.
START = [
    ("U001", "Gold", "07-29 17:00", None, True, 1),
    ("U002", "Platinum", "07-30 09:00", None, True, 2),
    ("U003", "Basic", "07-31 10:00", None, True, 3),
]
TWO_UPDATES = [
    ("U002", "Elite", "update_preimage", "07-30 09:00", 2),
    ("U002", "Gold", "update_postimage", "07-30 09:00", 2),
    ("U002", "Gold", "update_preimage", "07-31 10:00", 3),
    ("U002", "Platinum", "update_postimage", "07-31 10:00", 3),
]
CASES = {
    "two updates of one key": (
        [("U002", "Basic", "07-29 17:00", None, True, 1)],
        TWO_UPDATES,
        [
            ("U002", "Basic", "07-29 17:00", "07-30 09:00", False, 1),
            ("U002", "Gold", "07-30 09:00", "07-31 10:00", False, 2),
            ("U002", "Platinum", "07-31 10:00", None, True, 3),
        ],
    ),
    "deletes only": (
        START,
        [("U001", "Gold", "delete", "08-01 12:00", 4), ("U002", "Platinum", "delete", "08-02 14:30", 5)],
        [
            ("U001", "Gold", "07-29 17:00", "08-01 12:00", False, 1),
            ("U002", "Platinum", "07-30 09:00", "08-02 14:30", False, 2),
            ("U003", "Basic", "07-31 10:00", None, True, 3),
        ],
    ),
    "insert, update and delete": (
        START,
        [
            ("U004", "Elite", "insert", "08-03 10:00", 6),
            ("U003", "Basic", "update_preimage", "08-04 11:00", 7),
            ("U003", "Premium", "update_postimage", "08-04 11:00", 7),
            ("U004", "Elite", "delete", "08-05 16:00", 8),
        ],
        [
            ("U001", "Gold", "07-29 17:00", None, True, 1),
            ("U002", "Platinum", "07-30 09:00", None, True, 2),
            ("U003", "Basic", "07-31 10:00", "08-04 11:00", False, 3),
            ("U003", "Premium", "08-04 11:00", None, True, 7),
            ("U004", "Elite", "08-03 10:00", "08-05 16:00", False, 6),
        ],
    ),
    "empty target": (
        [],
        [
            ("U001", "Gold", "insert", "07-29 17:00", 1),
            ("U002", "Basic", "insert", "07-29 17:00", 1),
            ("U003", "Basic", "update_preimage", "07-29 17:00", 1),
            ("U003", "Premium", "update_postimage", "07-29 17:00", 1),
        ],
        [
            ("U001", "Gold", "07-29 17:00", None, True, 1),
            ("U002", "Basic", "07-29 17:00", None, True, 1),
            ("U003", "Premium", "07-29 17:00", None, True, 1),
        ],
    ),
}


@pytest.mark.parametrize("case", CASES)
def test_merge_history_golden(spark, group_size, source_size, case):
    start, events, expected = CASES[case]
    merged = cdc.merge_history(feed_of(spark, events), history_of(spark, start), ["user_id"])
    same(merged, history_of(spark, expected))


@pytest.mark.parametrize("case", CASES)
def test_merge_history_is_idempotent(spark, case):
    start, events, _ = CASES[case]
    feed = feed_of(spark, events)
    once = cdc.merge_history(feed, history_of(spark, start), ["user_id"])
    same(cdc.merge_history(feed, once, ["user_id"]), once)


def test_merge_history_composite_keys(spark, group_size):
    keys = "user_id string, club_id string"
    start = [
        ("U001", "C1", "Gold", "07-29 17:00", None, True, 1),
        ("U001", "C2", "Platinum", "07-30 09:00", None, True, 2),
        ("U002", "C1", "Basic", "07-31 10:00", None, True, 3),
    ]
    events = [
        ("U001", "C1", "Gold", "update_preimage", "08-01 12:00", 4),
        ("U001", "C1", "Elite", "update_postimage", "08-01 12:00", 4),
        ("U001", "C2", "Platinum", "update_preimage", "08-02 14:30", 5),
        ("U001", "C2", "Diamond", "update_postimage", "08-02 14:30", 5),
        ("U002", "C2", "Premium", "insert", "08-03 16:00", 6),
        ("U002", "C1", "Basic", "delete", "08-04 16:00", 7),
    ]
    expected = [
        ("U001", "C1", "Gold", "07-29 17:00", "08-01 12:00", False, 1),
        ("U001", "C1", "Elite", "08-01 12:00", None, True, 4),
        ("U001", "C2", "Platinum", "07-30 09:00", "08-02 14:30", False, 2),
        ("U001", "C2", "Diamond", "08-02 14:30", None, True, 5),
        ("U002", "C1", "Basic", "07-31 10:00", "08-04 16:00", False, 3),
        ("U002", "C2", "Premium", "08-03 16:00", None, True, 6),
    ]
    merged = cdc.merge_history(feed_of(spark, events, keys), history_of(spark, start, keys), ["user_id", "club_id"])
    same(merged, history_of(spark, expected, keys))


def test_preimage_of_unknown_key_is_ignored(spark):
    events = [("U009", "Gold", "update_preimage", "08-01 12:00", 4)]
    same(cdc.merge_history(feed_of(spark, events), history_of(spark, START), ["user_id"]), history_of(spark, START))


def test_empty_feed_keeps_the_target(spark):
    same(cdc.merge_history(feed_of(spark, []), history_of(spark, START), ["user_id"]), history_of(spark, START))


def test_new_feed_columns_are_added(spark):
    feed = feed_of(spark, [("U001", "Gold", "delete", "08-01 12:00", 4)]).withColumn("email", F.lit("a@b.c"))
    merged = cdc.merge_history(feed, history_of(spark, START), ["user_id"])
    assert "email" in merged.columns and merged.count() == 3


def test_rows_of_other_keys_are_not_shuffled(spark):
    merged = cdc.merge_history(feed_of(spark, TWO_UPDATES), history_of(spark, START), ["user_id"])
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan and "LeftSemi" in plan and "SortMergeJoin" not in plan


def test_history_rows_golden(spark, group_size):
    found = cdc.history_rows(feed_of(spark, TWO_UPDATES), ["user_id"])
    assert found.columns == [
        "user_id", "tier", "bronze_commit_version", "effective_start_date", "effective_end_date", "is_active_record"
    ]
    same(
        found,
        history_of(
            spark,
            [("U002", "Gold", "07-30 09:00", "07-31 10:00", False, 2), ("U002", "Platinum", "07-31 10:00", None, True, 3)],
        ),
    )


def test_delete_only_feed_has_no_history_rows(spark):
    assert cdc.history_rows(feed_of(spark, [("U001", "Gold", "delete", "08-01 12:00", 4)]), ["user_id"]).count() == 0


def test_two_inserts_in_one_commit_need_a_tie_break(spark):
    feed = feed_of(spark, [("U1", "a", "insert", "08-01 12:00", 1), ("U1", "b", "insert", "08-01 12:00", 1)])
    with pytest.raises(Exception, match="tie_break"):
        cdc.history_rows(feed, ["user_id"]).collect()
    found = cdc.history_rows(feed, ["user_id"], tie_break=["tier"])
    assert [r["tier"] for r in found.where("is_active_record").collect()] == ["b"]


def test_oldest_closing_event(spark):
    found = cdc.oldest_closing_event(feed_of(spark, TWO_UPDATES), ["user_id"])
    assert found.columns == ["user_id", "_commit_timestamp", "bronze_commit_version"]
    assert rows(found) == [("U002", at("07-30 09:00"), 2)]


def test_oldest_closing_event_of_a_delete_and_a_preimage(spark):
    events = [("U001", "Gold", "update_preimage", "08-01 10:00", 1), ("U001", "Gold", "delete", "08-01 10:00", 1)]
    assert rows(cdc.oldest_closing_event(feed_of(spark, events), ["user_id"])) == [("U001", at("08-01 10:00"), 1)]


def test_filter_change_types(spark):
    assert cdc.filter_change_types(feed_of(spark, TWO_UPDATES), ["update_preimage"]).count() == 2


def test_standardize_history(spark):
    df = spark.createDataFrame([("U1", "Gold")], "user_id string, tier string")
    found = cdc.standardize_history(df, 5, "2025-08-01 00:00:00")
    assert rows(found) == [("U1", "Gold", at("08-01 00:00"), None, True, 5)]
    assert found.schema["effective_end_date"].dataType.simpleString() == "timestamp"
    assert cdc.standardize_history(found, 9) is found
    partial = df.withColumn("is_active_record", F.lit(True))
    assert not cdc.has_history_columns(partial)
    assert cdc.has_history_columns(cdc.standardize_history(partial, 5))


def _random_feed(seed, n_keys, n_events):
    """Valid lifecycles; each event is one commit."""
    rng = random.Random(seed)
    state, events, when = {}, [], datetime(2025, 1, 1)
    for version in range(1, n_events + 1):
        when += timedelta(minutes=rng.randint(1, 90))
        # Key 0 owns a third of all events.
        key = "k0" if rng.random() < 0.33 else f"k{rng.randrange(n_keys)}"
        value = rng.choice("abcdef")
        if key not in state:
            events.append((key, value, "insert", when, version))
            state[key] = value
        elif rng.random() < 0.3:
            events.append((key, state.pop(key), "delete", when, version))
        else:
            events.append((key, state[key], "update_preimage", when, version))
            events.append((key, value, "update_postimage", when, version))
            state[key] = value
    return events


def _brute_force_history(events):
    history, open_rows = [], {}
    for key, value, kind, when, version in events:
        if kind in ("update_preimage", "delete") and key in open_rows:
            row = open_rows.pop(key)
            history.append((*row[:3], when, False, row[5]))
        if kind in ("insert", "update_postimage"):
            open_rows[key] = (key, value, when, None, True, version)
    return history + list(open_rows.values())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_lifecycles_in_overlapping_loads(spark, group_size, seed):
    events = _random_feed(seed, 8, 90)
    feed = spark.createDataFrame(events, FEED)
    expected = rows(spark.createDataFrame(_brute_force_history(events), HISTORY))
    assert rows(cdc.history_rows(feed, ["user_id"]).select(*COLUMNS)) == expected

    state = history_of(spark, [])
    for last in (30, 60, 90):
        start = scalar(max_commit_version(state))
        load = feed.where((F.col("_commit_version") >= start) & (F.col("_commit_version") <= last))
        state = spark.createDataFrame(cdc.merge_history(load, state, ["user_id"]).collect(), HISTORY)
    assert rows(state) == expected
    assert rows(cdc.merge_history(feed, state, ["user_id"]).select(*COLUMNS)) == expected


def test_replaying_the_middle_of_a_feed_changes_nothing(spark):
    feed = spark.createDataFrame(_random_feed(5, 6, 80), FEED)
    history = cdc.history_rows(feed, ["user_id"])
    middle = feed.where("_commit_version BETWEEN 20 AND 40")
    assert cdc.version_range(middle) == (20, 40)
    same(cdc.merge_history(middle, history, ["user_id"]), history)


def test_history_intervals_never_overlap(spark):
    feed = spark.createDataFrame(_random_feed(7, 5, 80), FEED)
    spans = {}
    for r in cdc.history_rows(feed, ["user_id"]).collect():
        spans.setdefault(r["user_id"], []).append((r["effective_start_date"], r["effective_end_date"] or datetime.max))
    for found in spans.values():
        found.sort()
        assert all(a[1] <= b[0] for a, b in zip(found, found[1:]))


def test_state_as_of_and_snapshot_changes_agree(spark):
    feed = spark.createDataFrame(_random_feed(11, 10, 80), FEED)
    before = cdc.state_as_of(feed, ["user_id"], version=40)
    after = cdc.state_as_of(feed, ["user_id"], version=80)
    changes = cdc.snapshot_changes(before, after, ["user_id"], 81, "2025-09-01 00:00:00")
    # Replaying the changes on top of the first state gives the second one.
    opening = cdc.snapshot_changes(before.limit(0), before, ["user_id"], 1, "2025-01-01 00:00:00")
    assert rows(cdc.state_as_of(opening.unionByName(changes), ["user_id"], version=81)) == rows(after)


def test_snapshot_changes_with_nulls_and_a_new_column(spark):
    before = spark.createDataFrame([(1, None), (2, "b"), (3, "c")], "id int, v string")
    after = spark.createDataFrame([(1, None, None), (2, "x", None), (4, "d", "n")], "id int, v string, w string")
    found = cdc.snapshot_changes(before, after, ["id"], 1, "2025-01-01 00:00:00")
    assert rows(found, "id", "v", "w", "_change_type") == [
        (2, "b", None, "update_preimage"),
        (2, "x", None, "update_postimage"),
        (3, "c", None, "delete"),
        (4, "d", "n", "insert"),
    ]


def test_state_as_of_needs_exactly_one_bound(spark):
    feed = feed_of(spark, TWO_UPDATES)
    with pytest.raises(ValueError):
        cdc.state_as_of(feed, ["user_id"])
    with pytest.raises(ValueError):
        cdc.state_as_of(feed, ["user_id"], version=1, timestamp="2025-01-01")
    assert rows(cdc.state_as_of(feed, ["user_id"], timestamp="2025-07-30 12:00:00")) == [("U002", "Gold")]


def test_valid_at_and_current_rows(spark):
    history = history_of(spark, CASES["two updates of one key"][2])
    assert [r["tier"] for r in cdc.valid_at(history, "2025-07-30 09:00:00").collect()] == ["Gold"]
    assert [r["tier"] for r in cdc.current_rows(history).collect()] == ["Platinum"]


def test_snapshots_with_repeated_keys_are_refused(spark):
    schema = "k int, v string"
    once = spark.createDataFrame([(None, "a"), (1, "b")], schema)
    changed = spark.createDataFrame([(None, "c"), (2, "d")], schema)
    found = cdc.snapshot_changes(once, changed, ["k"], 1, "2024-01-01").select("k", "v", "_change_type")
    assert rows(found) == rows(
        spark.createDataFrame(
            [(None, "a", "update_preimage"), (None, "c", "update_postimage"), (1, "b", "delete"), (2, "d", "insert")],
            "k int, v string, t string",
        )
    )
    twice = once.union(once)
    for before, after in ((twice, changed), (changed, twice)):
        with pytest.raises(Exception, match="several rows of one key"):
            cdc.snapshot_changes(before, after, ["k"], 1, "2024-01-01").collect()
