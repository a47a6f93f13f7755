"""JSON, arrays, prompts, rendering and scoring."""

from __future__ import annotations

import json
import sys
from datetime import datetime

import numpy as np
import pytest
from pyspark import cloudpickle
from helpers import rows
from pyspark.sql import functions as F

from tablecraft.functions import text as X
from tablecraft.functions.time import iso8601_utc
from tablecraft.operators.scoring import batch_inference, predict, scorer
from tablecraft.sources.sql import render_rows, run_sql

# The models below travel with their tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@pytest.mark.parametrize(
    "raw, expected",
    [
        ('{"content": "hi", "text": "no"}', "hi"),
        ('{"text": "t", "response": "r"}', "r"),
        ('{"z": 1, "a": [1, {"b": "é"}]}', json.dumps({"z": 1, "a": [1, {"b": "é"}]}, indent=2)),
        ('{"output": {"a": true}}', "{'a': True}"),
        ('{"content": null, "text": "t"}', "None"),
        ("[1, 2]", "[1, 2]"),
        ('"quoted"', "quoted"),
        ("not json", "not json"),
        ("12 apples", "12 apples"),
        ('{"a":1} and more', '{"a":1} and more'),
        ('{"content":"x"} and more', '{"content":"x"} and more'),
        ('{"content":"x"}, {"b":1', '{"content":"x"}, {"b":1'),
        ("1], [2", "1], [2"),
        ("1, 2", "1, 2"),
        ('{"content": "a", "content": "b"}', "b"),
        ('{"content": 5, "text": "t"}', "5"),
        ('{"message": [true, null, "it\'s", {"k": "a\\nb"}, {}, [ ]]}', str([True, None, "it's", {"k": "a\nb"}, {}, []])),
        ('{"x": {"content": "inner"}, "y": [{}, [], "a, b: {c}"]}', json.dumps({"x": {"content": "inner"}, "y": [{}, [], "a, b: {c}"]}, indent=2)),
        ('{"e": "😀 é"}', json.dumps({"e": "😀 é"}, indent=2)),
        ('  {"text": "blanks"}\n', "blanks"),
        ("12", "12"),
        ("true", "True"),
        ("null", "None"),
        ('{"broken": ', '{"broken": '),
        ("{}", "{}"),
        ("{'content': 'x'}", "{'content': 'x'}"),
        ("{'content': \"x\"}", "{'content': \"x\"}"),
        ("['a']", "['a']"),
        ('{"content": NaN}', "nan"),
        ('{"content": -Infinity, "text": "t"}', "-inf"),
        ('{"content": 1.0, "content": 2.50}', "2.5"),
        ('{"text": "it\'s", "content": "5"}', "5"),
        ("", ""),
        (None, None),
    ],
)
def test_json_first_field(spark, raw, expected):
    df = spark.createDataFrame([(raw,)], "c string")
    assert df.select(X.json_first_field(F.col("c"))).first()[0] == expected


def test_json_struct_tolerates_broken_text(spark):
    df = spark.createDataFrame([('{"notebook_id": "n", "job_info": {"job_id": "j"}}',), ("{",), (None,)], "c string")
    parsed = X.json_struct(F.col("c"), "notebook_id string, job_info struct<job_id string>")
    found = df.select(parsed["notebook_id"], parsed["job_info"]["job_id"])
    assert [tuple(r) for r in found.collect()] == [("n", "j"), (None, None), (None, None)]


def test_last_message(spark):
    schema = "m array<struct<role:string,content:string>>"
    df = spark.createDataFrame([([("u", "a"), ("b", "z")],), ([],), (None,)], schema)
    assert [r[0] for r in df.select(X.last_message(F.col("m"), F.lit("none"))).collect()] == ["z", "none", "none"]


def test_split_list(spark):
    df = spark.createDataFrame([(" a, b ,,c ",), ("",), (None,)], "c string")
    assert [r[0] for r in df.select(X.split_list(F.col("c"))).collect()] == [["a", "b", "c"], [], None]


def test_evaluation_prompt(spark):
    df = spark.createDataFrame([("short", "txt", "g", "b"), ("short", "txt", "g", ""), ("short", "txt", None, "b")], "c string, t string, g string, b string")
    found = df.select(X.evaluation_prompt(F.col("c"), F.col("t"), F.col("g"), F.col("b")).alias("p")).select("p.*").collect()
    assert found[0]["user"] == (
        'Evaluate the text below according to this criteria: short Only return "yes" or "no", nothing else.\n\n```\ntxt\n```'
    )
    assert found[0]["system"] == (
        "\n\nYou are an expert evaluator. Please consider the following GOOD example:\ng\n\nand BAD example:\nb"
    )
    assert found[1]["system"] == found[2]["system"] == "\n\nYou are an expert evaluator."


def test_context_text(spark):
    df = spark.sql("select map('style', 'poem', 'n', null) as v, map('k', '1') as m union all select map(), null")
    found = [r[0] for r in df.select(X.context_text(F.col("v"), F.col("m"))).collect()]
    assert found == [
        "Variables available in the prompt:\n- style: poem\n- n: None\n\nMetadata available:\n- k: 1",
        "",
    ]


@pytest.mark.parametrize(
    "text, value, rationale",
    [
        ("plain 12 # * text", "yes", "No emojis detected in the response."),
        (None, "yes", "No emojis detected in the response."),
        ("★ ✓ → • “x” ™x".replace("™", ""), "yes", "No emojis detected in the response."),
        ("© ↩️ ℹ️ ▶️", "no", "Emojis detected: ['©', 'ℹ️', '↩️', '▶️']"),
        ("\U0001F3F4\U000E0067\U000E0062\U000E0065\U000E006E\U000E0067\U000E007F #️⃣", "no", "Emojis detected: ['#️⃣', '\U0001F3F4\U000E0067\U000E0062\U000E0065\U000E006E\U000E0067\U000E007F']"),
        ("a 😀 b 😀 👍🏽", "no", "Emojis detected: ['👍🏽', '😀']"),
        ("🇩🇪 1️⃣ 👨‍👩‍👧 ❤️", "no", "Emojis detected: ['1️⃣', '❤️', '🇩🇪', '👨‍👩‍👧']"),
    ],
)
def test_emoji_score(spark, text, value, rationale):
    df = spark.createDataFrame([(text,)], "t string")
    assert tuple(df.select(X.emoji_score(F.col("t")).alias("s")).select("s.*").first()) == (value, rationale)


def test_emoji_score_lists_ten_at_most(spark):
    df = spark.createDataFrame([("".join(chr(0x1F600 + i) for i in range(15)),)], "t string")
    assert df.select(X.emoji_score(F.col("t"))["rationale"]).first()[0].count("'") == 20


def test_evaluation_input(spark):
    df = spark.createDataFrame([("p",)], "t string")
    assert df.select(F.to_json(X.evaluation_input(F.col("t")))).first()[0] == '{"inputs":{"prompt":"p"}}'


def test_preview_and_rendering(spark):
    df = spark.createDataFrame([(1, None, "x" * 50, ["y" * 60])], "a int, b string, c string, d array<string>")
    assert X.render_header(df) == ["a | b | c | d", "-" * 15]
    assert rows(render_rows(df)) == [("1 | NULL | " + "x" * 50 + ' | ["' + "y" * 48 + "...",)]
    assert df.select(X.preview(F.concat("c", F.lit("z")))).first()[0] == "x" * 50 + "..."
    assert df.select(X.preview(F.col("c"))).first()[0] == "x" * 50


def test_run_sql_binds_values(spark):
    found = run_sql(spark, "SELECT :a AS a, :b AS b", {"a": "it's; --", "b": 2})
    assert rows(found) == [("it's; --", 2)]


def test_iso8601(spark):
    df = spark.createDataFrame([(datetime(2025, 7, 29, 17, 0, 0, 123456),)], "t timestamp")
    assert df.select(iso8601_utc(F.col("t"))).first()[0] == "2025-07-29T17:00:00.123+00:00"


@pytest.mark.parametrize(
    "function, kind, expected",
    [
        (lambda r: len(r.text), "bigint", [2, 3]),
        (lambda r: r.var["name"] == "x", "boolean", [True, False]),
        (lambda r: f"{r.llm}:{r.prompt}", "string", ["None:p", "None:p"]),
    ],
)
def test_scorer(spark, function, kind, expected):
    df = spark.createDataFrame([("ab", {"name": "x"}), ("abc", {"name": "y"})], "t string, v map<string,string>")
    score = scorer(function, kind)
    assert [r[0] for r in df.select(score(F.col("t"), prompt=F.lit("p"), var=F.col("v"))).collect()] == expected


def test_scorer_refuses_other_types():
    with pytest.raises(ValueError):
        scorer(len, "array<int>")


class Doubler:
    def predict(self, x):
        return x.iloc[:, 0].to_numpy() * 2.0

    def predict_proba(self, x):
        return np.column_stack([x.iloc[:, 0], 1 - x.iloc[:, 0]])


def test_predict(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "b")], "x double, name string")
    assert rows(predict(df, Doubler, ["x"]), "name", "prediction") == [("a", 2.0), ("b", 4.0)]
    shaped = predict(df, Doubler, ["x"], predict_method="predict_proba", preprocess=lambda b: b / 4, postprocess=lambda y: y[:, 1])
    assert rows(shaped, "name", "prediction") == [("a", 0.75), ("b", 0.5)]
    lists = predict(df, Doubler, ["x"], predict_method="predict_proba", output_type="array<double>")
    assert rows(lists, "prediction")[0] == ([1.0, 0.0],)
    with pytest.raises(ValueError, match="predict method"):
        predict(df, Doubler, ["x"], predict_method="guess")
    with pytest.raises(ValueError, match="missing"):
        predict(df, Doubler, ["y"])


def test_batch_inference(spark):
    df = spark.createDataFrame([(1.0,)], "x double")
    found = batch_inference(df, Doubler, ["x"], "model@3", "2025-01-01 00:00:00")
    assert rows(found) == [(1.0, 2.0, "model@3", datetime(2025, 1, 1))]


def test_predict_leaves_other_columns_alone(spark):
    """A long id beyond 2**53 beside a null, and a time that pandas can't hold."""
    df = spark.sql("SELECT * FROM VALUES (9007199254740993L, timestamp'9999-12-31 00:00:00', 1.0D), (NULL, NULL, 2.0D) AS t(id, at, x)")

    class Double:
        def predict(self, x):
            return x["x"] * 2

    found = predict(df, Double, ["x"])
    assert found.where("id = 9007199254740993 AND at = timestamp'9999-12-31 00:00:00' AND prediction = 2.0").count() == 1
    assert found.where("id IS NULL AND at IS NULL AND prediction = 4.0").count() == 1
