"""Tool-call linking: calls meet their results by identifier, in topological order, as canonical JSON.

Calls and results are joined on conversation and identifier; both sides have one row per identifier before the join, so
no identifier multiplies rows. A call may depend on other calls of its conversation; levels are found by doubling the
pointers of calls that wait for one other, and rounds over the calls that wait for several (``_levels``). A conversation
of any length is numbered from counts per partition, not in one task. Arguments are checked against a JSON schema per tool.

Canonical JSON: keys sorted, no blanks, characters as they are, whole floats as integers.

Status of a row: ``linked``, ``no_result`` (call without result), ``no_call`` (result without call) or ``cycle`` (a call
that depends on itself over others; it has no level and comes last).

Defined results: of calls that repeat an identifier in a conversation, the one of the smallest turn, then name and
arguments, counts; so for results; both counts are given. Null identifiers are never linked and give rows of their own
kind, one per conversation. Dependencies on calls that don't exist are ignored and counted. Unknown tools, arguments that
are no JSON object, and null arguments are invalid. Empty tables give no rows.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecraft.llm.common import discard, keep, numbered, small

# JSON types and the Python types they are read as.
TYPES = {
    "object": dict,
    "array": list,
    "string": str,
    "boolean": bool,
    "null": type(None),
    "integer": int,
    "number": (int, float),
}
KEY = ["conv_id", "call_id"]


def problems(value: object, schema: dict, at: str = "$") -> list[str]:
    """What is wrong with a value: type, enum, bounds, lengths, required and unknown properties, items."""
    kind = schema.get("type")
    if kind is not None:
        kinds = kind if isinstance(kind, list) else [kind]
        whole = isinstance(value, float) and value.is_integer() and "integer" in kinds
        truth = isinstance(value, bool)
        if not whole and not any(isinstance(value, TYPES[k]) and (not truth or k == "boolean") for k in kinds):
            return [f"{at}: not of type {'/'.join(kinds)}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not one of the allowed values")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if "minimum" in schema and value < schema["minimum"]:
            out.append(f"{at}: below {schema['minimum']}")
        if "maximum" in schema and value > schema["maximum"]:
            out.append(f"{at}: above {schema['maximum']}")
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            out.append(f"{at}: too short")
        if "maxLength" in schema and len(value) > schema["maxLength"]:
            out.append(f"{at}: too long")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{name}: missing" for name in schema.get("required", []) if name not in value]
        for name in sorted(value):
            if name in known:
                out += problems(value[name], known[name], f"{at}.{name}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{at}.{name}: unknown")
    if isinstance(value, list) and "items" in schema:
        for number, item in enumerate(value):
            out += problems(item, schema["items"], f"{at}[{number}]")
    return out


def _plain(value: object) -> object:
    if isinstance(value, float) and value.is_integer() and abs(value) < 2**53:
        return int(value)
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    return [_plain(v) for v in value] if isinstance(value, list) else value


def canonical(value: object) -> str:
    return json.dumps(_plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _no_constant(name: str) -> None:
    raise ValueError(name)


def parsed(text: str | None) -> dict | None:
    """A JSON object, or None."""
    try:
        value = json.loads(text, parse_constant=_no_constant) if text else None
        return value if isinstance(value, dict) and canonical(value) is not None else None
    except (ValueError, RecursionError):
        return None


def _messages(schemas: dict[str, dict]) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            valid, errors, messages = [], [], []
            for row in batch.select(["call_id", "name", "arguments", "result", "status"]).to_pylist():
                arguments = parsed(row["arguments"])
                if row["status"] == "no_call":
                    found = ["no call"]
                elif row["name"] not in schemas:
                    found = ["unknown tool"]
                elif arguments is None:
                    found = ["arguments are no JSON object"]
                else:
                    found = problems(arguments, schemas[row["name"]])
                valid.append(not found)
                errors.append(found)
                messages.append(
                    canonical(
                        {
                            "arguments": row["arguments"] if arguments is None else arguments,
                            "id": row["call_id"],
                            "name": row["name"],
                            "result": row["result"],
                        }
                    )
                )
            out = [batch.column(c) for c in batch.schema.names if c not in ("arguments", "result")]
            names = [c for c in batch.schema.names if c not in ("arguments", "result")]
            yield pa.record_batch(
                [*out, pa.array(valid, pa.bool_()), pa.array(errors, pa.list_(pa.string())), pa.array(messages, pa.string())],
                [*names, "valid", "errors", "message"],
            )

    return run


def _chains(single: DataFrame) -> DataFrame:
    """Calls that wait for one other call each, as (conv_id, call_id, waits, weight, least) with ``waits`` at a chain's end.

    A call's level is the larger of ``least`` and the level of ``waits`` plus ``weight``. Such steps follow each other as
    one step of the same form, so pointers are doubled: the number of rounds is the logarithm of the longest chain. Calls
    on a cycle, or behind one, never come to an end and are left out.
    """
    longest = single.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    for _ in range(longest.bit_length()):
        ahead = single.select("conv_id", F.col("call_id").alias("waits"), F.col("waits").alias("next"), F.col("weight").alias("more"), F.col("least").alias("floor"))
        moved = single.join(ahead, ["conv_id", "waits"], "left").select(
            *KEY,
            F.coalesce("next", "waits").alias("waits"),
            (F.col("weight") + F.coalesce("more", F.lit(0))).alias("weight"),
            F.greatest("least", F.col("floor") + F.col("weight")).alias("least"),
            F.col("next").isNotNull().alias("moved"),
        )
        moved = keep(moved, "chains")
        discard(single)
        single = moved.drop("moved")
        single._stored_at = moved._stored_at
        if not moved.filter("moved").limit(1).count():
            return single
    ends = single.select("conv_id", F.col("call_id").alias("waits"))
    ended = keep(single.join(ends, ["conv_id", "waits"], "left_anti").select(single.columns), "chains")
    discard(single)
    return ended


def _levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv_id, call_id, level): 0 without dependencies, else one more than the deepest; no row for cycles.

    ``waiting`` has the steps of the calls without a level: call, the call it waits for (null: none, ``weight`` is a level
    it has at least) and the weight between. Each round gives levels to calls that wait for none, collapses chains of calls
    that wait for one, and puts the end of a chain in place of the calls in it. What waits for one thing over several ways
    then waits for it once. Rounds follow the nesting of branches that stay apart, not the length of a conversation.
    """
    found = keep(nodes.join(edges.select(*KEY).distinct(), KEY, "left_anti").withColumn("level", F.lit(0)), "levels")
    resolved, followers = [found], []
    waiting = keep(edges.select(*KEY, F.col("depends_on").alias("waits"), F.lit(1).alias("weight")), "waiting")
    while waiting.limit(1).count():
        known = found.select("conv_id", F.col("call_id").alias("waits"), "level")
        steps = waiting.join(known, ["conv_id", "waits"], "left").select(
            *KEY, F.when(F.col("level").isNull(), F.col("waits")).alias("waits"), (F.col("weight") + F.coalesce("level", F.lit(0))).alias("weight")
        )
        steps = keep(steps.groupBy(*KEY, "waits").agg(F.max("weight").alias("weight")), "steps")
        open_step = F.col("waits").isNotNull()
        calls = steps.groupBy(*KEY).agg(
            F.count("waits").alias("n"),
            F.max(F.when(open_step, F.col("waits"))).alias("waits"),
            F.max(F.when(open_step, F.col("weight"))).alias("weight"),
            F.max(F.when(~open_step, F.col("weight"))).alias("least"),
        )
        calls = keep(calls, "waiting-calls")
        found = keep(calls.filter("n = 0").select(*KEY, F.col("least").alias("level")), "levels")
        resolved.append(found)
        chains = _chains(keep(calls.filter("n = 1").drop("n"), "chains"))
        followers.append(chains)
        branching = calls.filter("n > 1").select(*KEY)
        ahead = chains.select("conv_id", F.col("call_id").alias("waits"), F.col("waits").alias("next"), F.col("weight").alias("more"), "least")
        rest = steps.join(branching, KEY, "left_semi").join(ahead, ["conv_id", "waits"], "left")
        over = rest.select(*KEY, F.coalesce("next", "waits").alias("waits"), (F.col("weight") + F.coalesce("more", F.lit(0))).alias("weight"))
        floor = rest.filter("least is not null").select(*KEY, F.lit(None).cast(nodes.schema["call_id"].dataType).alias("waits"), (F.col("weight") + F.col("least")).alias("weight"))
        before, waiting = waiting, keep(over.union(floor).groupBy(*KEY, "waits").agg(F.max("weight").alias("weight")), "waiting")
        settled = found.limit(1).count() or chains.limit(1).count()
        for stored in (before, steps, calls):
            discard(stored)
        if not settled:
            # All that is left waits for a cycle.
            break
    levels = keep(functools.reduce(DataFrame.union, resolved), "levels")
    # A chain ends at a call of a level, or at one of a chain that was collapsed later.
    for chains in reversed(followers):
        known = levels.select("conv_id", F.col("call_id").alias("waits"), "level")
        own = chains.join(known, ["conv_id", "waits"]).select(*KEY, F.greatest("least", F.col("level") + F.col("weight")).alias("level"))
        if chains.limit(1).count():
            levels = keep(levels.union(own), "levels")
    return levels


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """Link calls (conv_id, call_id, turn, name, arguments, depends_on) and results (conv_id, call_id, turn, content).

    Returns conv_id, call_id, turn, name, n_calls, n_results, missing_dependencies, level, status, position (topological,
    gapless from 0 per conversation), valid, errors and message (canonical JSON).
    """
    one_call = (
        calls.select(*KEY, "turn", "name", "arguments", "depends_on")
        .groupBy(*KEY)
        .agg(F.min(F.struct("turn", "name", "arguments", "depends_on")).alias("first"), F.count("*").alias("n_calls"))
        .select(*KEY, "first.*", "n_calls")
    )
    one_call = keep(one_call, "one-call")
    one_result = (
        results.select(*KEY, "turn", "content")
        .groupBy(*KEY)
        .agg(F.min(F.struct("turn", "content")).alias("first"), F.count("*").alias("n_results"))
        .select(*KEY, F.col("first.turn").alias("result_turn"), F.col("first.content").alias("result"), "n_results")
    )
    named = one_call.filter("conv_id is not null and call_id is not null")
    asked = named.select(*KEY, F.explode(F.array_distinct("depends_on")).alias("depends_on")).filter("depends_on is not null")
    there = named.select("conv_id", F.col("call_id").alias("depends_on"))
    edges = keep(asked.join(there, ["conv_id", "depends_on"], "left_semi"), "edges")
    counts = edges.groupBy(*KEY).agg(F.count("*").alias("found"))
    levels = _levels(named.select(*KEY), edges)
    linked = (
        one_call.join(one_result, KEY, "full_outer")
        .join(levels, KEY, "left")
        .join(counts, KEY, "left")
        .select(
            *KEY,
            F.coalesce("turn", "result_turn").alias("turn"),
            "name",
            "arguments",
            "result",
            F.coalesce("n_calls", F.lit(0)).alias("n_calls"),
            F.coalesce("n_results", F.lit(0)).alias("n_results"),
            (F.coalesce(F.size(F.array_distinct("depends_on")), F.lit(0)) - F.coalesce("found", F.lit(0)).cast("int")).alias(
                "missing_dependencies"
            ),
            "level",
            F.when(F.col("n_calls").isNull(), "no_call")
            .when(F.col("level").isNull() & F.col("call_id").isNotNull() & F.col("conv_id").isNotNull(), "cycle")
            .when(F.col("n_results").isNull(), "no_result")
            .otherwise("linked")
            .alias("status"),
        )
        .withColumn("__order", F.coalesce("level", F.lit(2**31 - 1)))
    )
    placed = numbered(linked, ["conv_id"], ["__order", "turn", "call_id", "status"], "position").drop("__order")
    kept = [f for f in placed.schema.fields if f.name not in ("arguments", "result")]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)
    return placed.mapInArrow(_messages(schemas), schema + ", valid boolean, errors array<string>, message string")


# The tools of calls that ``from_turns`` makes.
TURN_SCHEMAS = {
    "answer": {
        "type": "object",
        "properties": {"words": {"type": "integer", "minimum": 1, "maximum": 400}, "opening": {"type": "string", "maxLength": 60}, "text": {"type": "string"}, "context": {"type": "array"}},
        "required": ["words", "opening"],
        "additionalProperties": False,
    },
    "explain": {
        "type": "object",
        "properties": {"words": {"type": "integer", "minimum": 5}, "opening": {"type": "string"}, "text": {"type": "string"}, "context": {"type": "array"}, "lines": {"type": "integer", "maximum": 12}},
        "required": ["words", "lines"],
    },
}


def from_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results from plain chat turns (conv_id, turn, role, text).

    Each assistant turn is a call, with its text, that depends on the assistant turn before it; the user turn that follows
    is its result. What other roles say before the first assistant turn is that call's context. All other turns are
    results without a call, named by role and turn; a turn without role and text is none.
    """
    words = F.split(F.trim(F.coalesce("text", F.lit(""))), r"[ \n\t]+")
    plain = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"),
        F.col("text").cast("string").alias("text"),
    )
    own = F.concat_ws("-", F.lit("call"), "turn")
    first = plain.filter("role = 'assistant' and conv_id is not null").groupBy("conv_id").agg(F.min("turn").alias("first_turn"))
    first = small(keep(first, "first-turns"))
    others = plain.filter("coalesce(role, '') != 'assistant' and (role is not null or text is not null)").join(first, "conv_id", "left")
    opens = F.coalesce(F.col("turn") < F.col("first_turn"), F.lit(False))
    context = others.filter(opens).groupBy("conv_id", F.col("first_turn").alias("turn"))
    context = context.agg(F.sort_array(F.collect_set(F.struct("turn", "role", "text"))).alias("context"))
    size, opening = F.size(words).alias("words"), words[0].alias("opening")
    calls = plain.filter("role = 'assistant'").join(context, ["conv_id", "turn"], "left").select(
        "conv_id",
        own.alias("call_id"),
        "turn",
        F.when(F.size(words) % 3 == 0, "explain").otherwise("answer").alias("name"),
        F.when(
            F.size(words) % 3 == 0,
            F.to_json(F.struct(size, opening, F.size(F.split("text", "\n")).alias("lines"), "text", "context")),
        )
        .otherwise(F.to_json(F.struct(size, opening, "text", "context")))
        .alias("arguments"),
        F.when(F.col("turn") > 2, F.array(F.concat_ws("-", F.lit("call"), F.col("turn") - 2))).otherwise(F.array().cast("array<string>")).alias("depends_on"),
    )
    answers = F.coalesce((F.col("role") == "user") & (F.col("turn") > 0), F.lit(False))
    results = others.filter(~opens).select(
        "conv_id",
        F.when(answers, F.concat_ws("-", F.lit("call"), F.col("turn") - 1))
        .otherwise(F.concat_ws("-", F.coalesce("role", F.lit("turn")), "turn"))
        .alias("call_id"),
        "turn",
        F.col("text").alias("content"),
    )
    return calls, results
