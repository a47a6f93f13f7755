"""JSON, arrays, prompts and scores over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablecraft.functions import text as X
from tablecraft.operators.scoring import Response, batch_inference as infer, predict, scorer
from workload.inputs import AS_OF, table
from workload.models import PriceModel
from workload.registry import query

# A conversation's answers come as JSON under different fields, as other JSON, or as plain text.


@query(
    """SELECT conv_id, turn, text AS answer FROM conversations WHERE role <> 'system'
    UNION ALL SELECT conv_id, turn, '{' || chr(10) || '  "turn": ' || turn || ',' || chr(10) || '  "conv": [' || chr(10) ||
      '    ' || conv_id || chr(10) || '  ]' || chr(10) || '}' FROM conversations WHERE role = 'system'"""
)
def json_first_field(spark, d):
    as_content = F.to_json(F.struct(F.col("turn"), F.col("text").alias("content")))
    as_output = F.to_json(F.struct(F.col("text").alias("output"), F.lit("x").alias("note")))
    other = F.concat(F.lit('{"turn":'), F.col("turn"), F.lit(',"conv":['), F.col("conv_id"), F.lit("]}"))
    raw = (
        F.when(F.col("role") == "system", other)
        .when(F.col("turn") == 0, F.col("text"))
        .when(F.col("role") == "user", as_content)
        .otherwise(as_output)
    )
    return table(spark, d, "conversations").select("conv_id", "turn", X.json_first_field(raw).alias("answer"))


@query(
    """SELECT event_id, CASE WHEN event_type <> 'error' THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events"""
)
def json_struct(spark, d):
    """Errors carry broken JSON."""
    broken = F.when(F.col("event_type") == "error", F.concat(F.lit("{"), F.col("props"))).otherwise(F.col("props"))
    return table(spark, d, "events").select("event_id", X.json_struct(broken, "k bigint")["k"].alias("k"))


@query(
    """SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'No response' ELSE text END AS answer FROM conversations"""
)
def last_message(spark, d):
    """A turn's messages are the role and the text; a system turn has none."""

    def message(name: str):
        return F.struct(F.lit("m").alias("role"), F.col(name).alias("content"))

    messages = F.when(F.col("role") == "system", F.array().cast("array<struct<role:string,content:string>>")).otherwise(
        F.array(message("role"), message("text"))
    )
    return table(spark, d, "conversations").select(
        "conv_id", "turn", X.last_message(messages, F.lit("No response")).alias("answer")
    )


@query(
    """SELECT doc_id, array_to_string(items, '|') AS items, len(items) AS n
    FROM (SELECT doc_id, [trim(x) FOR x IN string_split(text, ',') IF trim(x) <> ''] AS items FROM documents)"""
)
def split_list(spark, d):
    items = X.split_list(F.col("text"))
    return table(spark, d, "documents").select(
        "doc_id", F.array_join(items, "|").alias("items"), F.size(items).cast("long").alias("n")
    )


@query(
    """SELECT doc_id,
      CASE WHEN quality = 1 AND toxic = 0
        THEN chr(10) || chr(10) || 'You are an expert evaluator. Please consider the following GOOD example:' || chr(10) || lang
          || chr(10) || chr(10) || 'and BAD example:' || chr(10) || source
        ELSE chr(10) || chr(10) || 'You are an expert evaluator.' END AS system_message,
      'Evaluate the text below according to this criteria: ' || source || ' Only return "yes" or "no", nothing else.'
        || chr(10) || chr(10) || '```' || chr(10) || text || chr(10) || '```' AS user_message
    FROM documents LEFT JOIN labels USING (doc_id)"""
)
def render_prompt(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    good = F.when(F.col("quality") == 1, F.col("lang"))
    bad = F.when(F.col("toxic") == 0, F.col("source")).otherwise("")
    prompt = X.evaluation_prompt(F.col("source"), F.col("text"), good, bad)
    return rows.select("doc_id", prompt.alias("p")).select(
        "doc_id", F.col("p.system").alias("system_message"), F.col("p.user").alias("user_message")
    )


@query(
    """SELECT doc_id, CASE WHEN lang = 'en' THEN '' ELSE 'Variables available in the prompt:' || chr(10) || '- lang: ' || lang
      || chr(10) || '- source: ' || source || chr(10) END || chr(10) || 'Metadata available:' || chr(10) || '- n_chars: ' || n_chars AS context
    FROM documents"""
)
def map_context(spark, d):
    variables = F.when(F.col("lang") != "en", F.create_map(F.lit("lang"), "lang", F.lit("source"), "source"))
    metadata = F.create_map(F.lit("n_chars"), F.col("n_chars").cast("string"))
    return table(spark, d, "documents").select("doc_id", X.context_text(variables, metadata).alias("context"))


@query(
    """SELECT doc_id, CASE WHEN lang = 'en' THEN 'yes' ELSE 'no' END AS value,
      CASE lang WHEN 'en' THEN 'No emojis detected in the response.' WHEN 'fr' THEN 'Emojis detected: [''🇫🇷'', ''😀'']'
        ELSE 'Emojis detected: [''👍🏽'']' END AS rationale
    FROM documents"""
)
def emoji_score(spark, d):
    """The texts have no emojis of their own; French and other texts get some at both ends."""
    decorated = (
        F.when(F.col("lang") == "en", F.col("text"))
        .when(F.col("lang") == "fr", F.concat(F.lit("😀 "), F.col("text"), F.lit(" 🇫🇷😀")))
        .otherwise(F.concat(F.col("text"), F.lit("👍🏽")))
    )
    return table(spark, d, "documents").select("doc_id", X.emoji_score(decorated).alias("s")).select("doc_id", "s.*")


@query("SELECT item_id, text AS prompt FROM benchmark")
def eval_dataset(spark, d):
    data = table(spark, d, "benchmark").select("item_id", X.evaluation_input(F.col("text")).alias("e"))
    return data.select("item_id", F.col("e.inputs.prompt").alias("prompt"))


@query("SELECT page_id, CASE WHEN length(html) > 50 THEN substr(html, 1, 50) || '...' ELSE html END AS html, CASE WHEN length(url) > 50 THEN substr(url, 1, 50) || '...' ELSE url END AS url FROM pages")
def preview(spark, d):
    return table(spark, d, "pages").select("page_id", X.preview(F.col("html")).alias("html"), X.preview(F.col("url")).alias("url"))


# -- user functions and models ------------------------------------------------


def _words_or_role(r: Response) -> int:
    return len(r.text.split(" ")) if r.meta.get("role") == "user" else -len(r.llm)


@query(
    """SELECT conv_id, turn, CASE WHEN role = 'user' THEN len(string_split(text, ' ')) ELSE -length(role) END AS score
    FROM conversations"""
)
def scorer_udf(spark, d):
    score = scorer(_words_or_role, "bigint")
    meta = F.create_map(F.lit("role"), "role")
    return table(spark, d, "conversations").select(
        "conv_id", "turn", score(F.col("text"), llm=F.col("role"), meta=meta).alias("score")
    )


_FEATURES = ["l_quantity", "l_extendedprice"]
_LINES = ("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")


@query(
    """SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, 2.0::DOUBLE * l_quantity + 0.5::DOUBLE * l_extendedprice AS prediction
    FROM lineitem"""
)
def model_predict(spark, d):
    return predict(table(spark, d, "lineitem").select(*_LINES), PriceModel, _FEATURES)


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, CASE WHEN l_quantity > 25 THEN 1.0 ELSE 0.0 END::DOUBLE AS prediction FROM lineitem")
def model_predict_proba(spark, d):
    return predict(
        table(spark, d, "lineitem").select(*_LINES),
        PriceModel,
        _FEATURES,
        predict_method="predict_proba",
        preprocess=lambda x: x.assign(l_quantity=x["l_quantity"] - 25),
        postprocess=lambda y: y[:, 1],
    )


@query(
    f"""SELECT p_partkey, p_size, p_retailprice, 2.0::DOUBLE * p_size + 0.5::DOUBLE * p_retailprice AS prediction,
      'price@1' AS model_id, TIMESTAMP '{AS_OF}' AS inference_timestamp FROM part"""
)
def batch_inference(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    return infer(part, PriceModel, ["p_size", "p_retailprice"], "price@1", AS_OF)
