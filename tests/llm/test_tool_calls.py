from __future__ import annotations

import json
import random

from tablecraft.llm import tool_calls as m

CALLS = "conv_id long, call_id string, turn long, name string, arguments string, depends_on array<string>, content string"
RESULTS = "conv_id long, call_id string, turn long, content string, name string"
SCHEMA = {"f": {"type": "object", "properties": {"n": {"type": "integer", "minimum": 0}}, "required": ["n"], "additionalProperties": False}}


def frames(spark, calls, results):
    return spark.createDataFrame([(*c, "x") for c in calls], CALLS), spark.createDataFrame([(*r, "y") for r in results], RESULTS)


def test_levels_equal_longest_paths(spark):
    rng = random.Random(3)
    calls, want = [], {}
    for conv in range(20):
        for i in range(rng.randint(1, 15)):
            deps = [f"c{j}" for j in range(i) if rng.random() < 0.25]
            want[conv, f"c{i}"] = max((want[conv, d] + 1 for d in deps), default=0)
            calls.append((conv, f"c{i}", rng.randint(0, 5), "f", '{"n": 1}', [*deps, "gone"]))
    rows = m.link(*frames(spark, calls, []), SCHEMA).collect()
    assert {(r.conv_id, r.call_id): r.level for r in rows} == want
    for conv in range(20):
        own = sorted((r.position, r.level) for r in rows if r.conv_id == conv)
        assert [p for p, _ in own] == list(range(len(own)))
        assert [lv for _, lv in own] == sorted(lv for _, lv in own)
    assert all(r.missing_dependencies == 1 and r.status == "no_result" for r in rows)


def brute_levels(deps):
    """Longest paths by relaxation; calls on or behind a cycle have none."""
    level = {}
    while True:
        new = {c: max((level[d] + 1 for d in own), default=0) for c, own in deps.items() if c not in level and all(d in level for d in own)}
        if not new:
            return level
        level |= new


def test_levels_with_cycles_and_long_chains(spark):
    rng = random.Random(9)
    graphs = {}
    for conv in range(40):
        size = rng.randint(1, 24)
        own = {f"c{i}": {f"c{rng.randrange(max(i, 1))}" for _ in range(rng.choice([0, 1, 1, 2, 3])) if i} for i in range(size)}
        if conv % 3 == 0:
            own[f"c{rng.randrange(size)}"].add(f"c{rng.randrange(size)}")
        graphs[conv] = own
    # A row of diamonds, a star behind a chain, and two chains that meet.
    graphs[100] = {"s0": set()} | {f"{k}{i}": {f"s{i - 1}"} for i in range(1, 12) for k in "lr"} | {f"s{i}": {f"l{i}", f"r{i}"} for i in range(1, 12)}
    graphs[101] = {f"p{i}": {f"p{i - 1}"} if i else set() for i in range(9)} | {f"q{i}": {"p8"} for i in range(60)}
    graphs[102] = {f"p{i}": {f"p{i - 1}"} if i else set() for i in range(30)} | {f"q{i}": {f"q{i - 1}"} if i else set() for i in range(7)} | {"m": {"p29", "q6"}, "n": {"m", "q3"}}
    calls = [(conv, c, 0, "f", '{"n": 1}', sorted(d)) for conv, own in graphs.items() for c, d in own.items()]
    rows = m.link(*frames(spark, calls, []), SCHEMA).collect()
    want = {(conv, c): level for conv, own in graphs.items() for c, level in brute_levels(own).items()}
    assert {(r.conv_id, r.call_id): r.level for r in rows if r.status != "cycle"} == want
    assert len(rows) == len(calls)


def test_a_conversation_of_2000_turns(spark):
    turns = spark.range(2000).selectExpr("7L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('text ', id) as text")
    rows = m.link(*m.from_turns(turns), m.TURN_SCHEMAS).collect()
    assert sorted((r.turn, r.level, r.position) for r in rows) == [(2 * n + 1, n, n) for n in range(1000)]
    assert {r.status for r in rows} == {"linked", "no_result"}


def test_statuses_and_checks(spark):
    calls = [
        (1, "a", 1, "f", '{"n": 2.0}', None),
        (1, "a", 1, "f", '{"n": 2.0}', None),
        (1, "b", 2, "f", '{"n": -1, "m": 1}', ["a", "a"]),
        (1, "c", 3, "g", "{}", ["d"]),
        (1, "d", 4, "f", "[1]", ["c"]),
        (1, None, 5, "f", None, ["a"]),
        (None, "a", 6, "f", '{"n": true}', None),
    ]
    results = [(1, "a", 2, "ok é"), (1, "a", 3, "later"), (1, "z", 9, "lost"), (1, None, 9, "lost")]
    rows = m.link(*frames(spark, calls, results), SCHEMA).collect()
    by_id = {(r.conv_id, r.call_id, r.status): r for r in rows}
    a = by_id[1, "a", "linked"]
    assert (a.n_calls, a.n_results, a.valid, a.level, a.position) == (2, 2, True, 0, 0)
    assert a.message == '{"arguments":{"n":2},"id":"a","name":"f","result":"ok é"}'
    assert by_id[1, "b", "no_result"].errors == ["$.m: unknown", "$.n: below 0"]
    assert by_id[1, "c", "cycle"].errors == ["unknown tool"] and by_id[1, "d", "cycle"].level is None
    assert by_id[1, "z", "no_call"].errors == ["no call"]
    assert by_id[None, "a", "no_result"].errors == ["$.n: not of type integer"]
    assert len(rows) == 8
    assert sorted(r.position for r in rows if r.conv_id == 1) == list(range(7))
    assert all(json.loads(r.message) for r in rows)


def test_empty_and_turns(spark):
    calls, results = frames(spark, [], [])
    assert m.link(calls, results, SCHEMA).count() == 0
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "one two three"), (1, 2, "user", "more"), (1, 3, "assistant", None), (None, None, None, None), (1, 1, "assistant", "one two three")]
    rows = m.link(*m.from_turns(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")), m.TURN_SCHEMAS).collect()
    assert {(r.call_id, r.level, r.status, r.n_calls) for r in rows} == {("call-1", 0, "linked", 2), ("call-3", 1, "no_result", 1)}


def test_every_turn_is_in_some_message(spark):
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    extra = [(-1, 0, "system", "rules é"), (-1, 1, "user", "first \"words\""), (-1, 2, "assistant", "a whole\nanswer"), (-1, 3, "system", "late"), (-2, 0, "user", "alone")]
    turns = turns.select("conv_id", "turn", "role", "text").unionByName(spark.createDataFrame(extra, "conv_id long, turn int, role string, text string"))
    said = {}
    for r in m.link(*m.from_turns(turns), m.TURN_SCHEMAS).collect():
        message = json.loads(r.message)
        arguments = message["arguments"] or {}
        said.setdefault(r.conv_id, set()).update([message["result"], arguments.get("text"), *(c.get("text") for c in arguments.get("context", []))])
    assert [r for r in turns.collect() if r.text is not None and r.text not in said.get(r.conv_id, ())] == []


def test_canonical_is_stable():
    value = {"b": [1.0, 2.5, {"z": None, "a": "é"}], "a": True}
    assert m.canonical(value) == '{"a":true,"b":[1,2.5,{"a":"é","z":null}]}'
    assert m.canonical(json.loads(m.canonical(value))) == m.canonical(value)
    assert m.parsed('{"a": NaN}') is None and m.parsed("[1]") is None and m.parsed("{} x") is None
