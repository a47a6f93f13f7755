"""Text, JSON and array projections, all evaluated inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Response fields in order of preference, preview length, separators.
RESPONSE_FIELDS = ("content", "response", "message", "text", "output")
PREVIEW_LENGTH = 50
PREVIEW_MARK = "..."
COLUMN_SEPARATOR = " | "
NULL_TEXT = "NULL"
MAX_LISTED_EMOJIS = 10

# The evaluation prompt.
CRITERIA_PREFIX = "Evaluate the text below according to this criteria: "
CRITERIA_SUFFIX = ' Only return "yes" or "no", nothing else.\n\n```\n'
INPUT_SUFFIX = "\n```"
EVALUATOR = "\n\nYou are an expert evaluator."
GOOD_EXAMPLE = " Please consider the following GOOD example:\n"
BAD_EXAMPLE = "\n\nand BAD example:\n"

# Headings of the context text.
VARIABLES_HEADING = "Variables available in the prompt:"
METADATA_HEADING = "\nMetadata available:"

# Code points with the Emoji property of Unicode 16, except digits and the signs # and *.
EMOJI_POINTS = (
    "A9 AE 203C 2049 2122 2139 2194-2199 21A9-21AA 231A-231B 2328 23CF 23E9-23F3 23F8-23FA 24C2 25AA-25AB 25B6 25C0"
    " 25FB-25FE 2600-2604 260E 2611 2614-2615 2618 261D 2620 2622-2623 2626 262A 262E-262F 2638-263A 2640 2642 2648-2653"
    " 265F-2660 2663 2665-2666 2668 267B 267E-267F 2692-2697 2699 269B-269C 26A0-26A1 26A7 26AA-26AB 26B0-26B1 26BD-26BE"
    " 26C4-26C5 26C8 26CE-26CF 26D1 26D3-26D4 26E9-26EA 26F0-26F5 26F7-26FA 26FD 2702 2705 2708-270D 270F 2712 2714 2716"
    " 271D 2721 2728 2733-2734 2744 2747 274C 274E 2753-2755 2757 2763-2764 2795-2797 27A1 27B0 27BF 2934-2935 2B05-2B07"
    " 2B1B-2B1C 2B50 2B55 3030 303D 3297 3299 1F004 1F0CF 1F170-1F171 1F17E-1F17F 1F18E 1F191-1F19A 1F201-1F202 1F21A 1F22F"
    " 1F232-1F23A 1F250-1F251 1F300-1F321 1F324-1F393 1F396-1F397 1F399-1F39B 1F39E-1F3F0 1F3F3-1F3F5 1F3F7-1F4FD 1F4FF-1F53D"
    " 1F549-1F54E 1F550-1F567 1F56F-1F570 1F573-1F57A 1F587 1F58A-1F58D 1F590 1F595-1F596 1F5A4-1F5A5 1F5A8 1F5B1-1F5B2 1F5BC"
    " 1F5C2-1F5C4 1F5D1-1F5D3 1F5DC-1F5DE 1F5E1 1F5E3 1F5E8 1F5EF 1F5F3 1F5FA-1F64F 1F680-1F6C5 1F6CB-1F6D2 1F6D5-1F6D7"
    " 1F6DC-1F6E5 1F6E9 1F6EB-1F6EC 1F6F0 1F6F3-1F6FC 1F7E0-1F7EB 1F7F0 1F90C-1F93A 1F93C-1F945 1F947-1F9FF 1FA70-1FA7C"
    " 1FA80-1FA89 1FA8F-1FAC6 1FACE-1FADC 1FADF-1FAE9 1FAF0-1FAF8"
)
EMOJI_BASE = "[" + "".join("-".join(rf"\x{{{p}}}" for p in r.split("-")) for r in EMOJI_POINTS.split()) + "]"
# Every emoji but keycaps begins in these wide ranges, which are quick to search for.
_WIDE = r"\x{A9}\x{AE}\x{203C}-\x{3299}\x{1F000}-\x{1FAFF}"
EMOJI_HINT = rf"[\x{{20E3}}{_WIDE}]"
# Presentation and skin tone, then the tags of a subdivision flag.
EMOJI_MODIFIER = r"[\x{FE0F}\x{1F3FB}-\x{1F3FF}]*(?:[\x{E0020}-\x{E007E}]+\x{E007F})?"
# One emoji is a keycap, a pair of regional indicators, or a pictograph with its modifiers and joined pictographs.
EMOJI = (
    rf"(?=[#*0-9{_WIDE}])(?:[0-9#*]\x{{FE0F}}?\x{{20E3}}|[\x{{1F1E6}}-\x{{1F1FF}}]{{2}}|"
    + EMOJI_BASE
    + EMOJI_MODIFIER
    + r"(?:\x{200D}"
    + EMOJI_BASE
    + EMOJI_MODIFIER
    + r")*)"
)


def preview(c: Column, length: int = PREVIEW_LENGTH) -> Column:
    """At most ``length`` characters, marked when something was cut."""
    return F.when(F.length(c) > length, F.concat(F.substring(c, 1, length), F.lit(PREVIEW_MARK))).otherwise(c)


# Tokens of a JSON text: strings, empty objects and arrays, marks, and other values.
JSON_TOKEN = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|\{\s*\}|\[\s*\]|[\[\]{}:,]|[^\[\]{}:,"\s]++'


def _tokens(json_text: Column) -> Column:
    return F.regexp_extract_all(json_text, F.lit(JSON_TOKEN), F.lit(0))


def _quoted(token: Column) -> Column:
    """A JSON string token in Python's notation of a string."""
    plain = F.get_json_object(F.concat(F.lit("["), token, F.lit("]")), "$[0]")
    for raw, shown in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        plain = F.replace(plain, F.lit(raw), F.lit(shown))
    double = F.contains(plain, F.lit("'")) & ~F.contains(plain, F.lit('"'))
    return F.when(double, F.concat(F.lit('"'), plain, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.replace(plain, F.lit("'"), F.lit("\\'")), F.lit("'"))
    )


def _python_notation(json_text: Column) -> Column:
    """A JSON value in Python's notation; numbers stay as they are written."""

    def shown(t: Column) -> Column:
        named = {"true": "True", "false": "False", "null": "None", ",": ", ", ":": ": "}
        out = F.when(t.startswith('"'), _quoted(t))
        for raw, text in named.items():
            out = out.when(t == raw, F.lit(text))
        return out.when(F.length(t) > 1, F.regexp_replace(t, r"\s+", "")).otherwise(t)

    return F.array_join(F.transform(_tokens(json_text), shown), "")


def _ascii(json_token: Column) -> Column:
    """A JSON token with ``\\u`` escapes for everything beyond ASCII."""

    def unit(code: Column) -> Column:
        return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(code)), 4, "0"))

    def shown(c: Column) -> Column:
        code = F.ascii(c)
        high = F.shiftright(code - 0x10000, 10) + 0xD800
        low = (code - 0x10000) % 0x400 + 0xDC00
        return F.when(code < 128, c).when(code < 0x10000, unit(code)).otherwise(F.concat(unit(high), unit(low)))

    return F.when(json_token.rlike(r"[^\x00-\x7F]"), F.array_join(F.transform(F.split(json_token, ""), shown), "")).otherwise(json_token)


def _indented(json_text: Column) -> Column:
    """A JSON text laid out with two blanks per level, its keys and numbers as they are written."""

    def line(depth: Column) -> Column:
        return F.concat(F.lit("\n"), F.repeat(F.lit("  "), depth))

    def add(state: Column, t: Column) -> Column:
        depth, out = state["depth"], state["out"]
        opens, closes = t.isin("{", "["), t.isin("}", "]")
        inner = F.when(opens, depth + 1).when(closes, depth - 1).otherwise(depth)
        text = (
            F.when(opens, F.concat(t, line(inner)))
            .when(closes, F.concat(line(inner), t))
            .when(t == ",", F.concat(t, line(depth)))
            .when(t == ":", F.lit(": "))
            .when(t.startswith('"'), _ascii(t))
            .when(F.length(t) > 1, F.regexp_replace(t, r"\s+", ""))
            .otherwise(t)
        )
        return F.struct(inner.alias("depth"), F.concat(out, text).alias("out"))

    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("out"))
    return F.aggregate(_tokens(json_text), start, add)["out"]


# Numbers beyond JSON that parsers accept, and Python's notation of them.
NOT_FINITE = {"NaN": "nan", "Infinity": "inf", "-Infinity": "-inf"}


def json_first_field(c: Column) -> Column:
    """First known response field of a JSON object; else the JSON, indented; else the raw text.

    A text counts as JSON only as a whole: it has to parse both as the one item of an array and as the value of a field,
    which no text with more before or after its value does; names and texts are in double quotes. Of repeated fields the
    last counts. Other values than text come in Python's notation, numbers as they are written. All of it runs inside the
    JVM, and each text is parsed once per form.
    """
    strict = {"allowSingleQuotes": "false"}
    item, value = F.concat(F.lit("["), c, F.lit("]")), F.concat(F.lit('{"v":'), c, F.lit("}"))
    parsed = F.struct(
        (F.size(F.from_json(item, "array<string>", strict)) == 1).alias("one"),
        F.map_entries(F.from_json(value, "v map<string,string>", strict)["v"]).alias("fields"),
        F.map_entries(F.from_json(value, "v map<string,variant>", strict)["v"]).alias("kinds"),
        F.from_json(value, "v string", strict)["v"].alias("scalar"),
    )

    def bound(value: Column, use: Callable[[Column], Column]) -> Column:
        """``use`` of a value that is computed once, however often ``use`` names it."""
        return F.transform(F.array(value), use)[0]

    def last(entries: Column, name: Column) -> Column:
        return F.try_element_at(F.filter(entries, lambda e: e["key"] == name), F.lit(-1))["value"]

    def notation(text: Column) -> Column:
        out = F.when(text.isNull(), F.lit("None"))
        for raw, shown in NOT_FINITE.items():
            out = out.when(F.btrim(text, F.lit('"')) == raw, F.lit(shown))
        return out.otherwise(_python_notation(text))

    def from_field(p: Column) -> Column:
        names = F.transform(p["fields"], lambda e: e["key"])
        known = F.filter(F.array(*map(F.lit, RESPONSE_FIELDS)), lambda n: F.array_contains(names, n))
        entry = F.struct(
            F.size(known).alias("known"),
            last(p["fields"], F.get(known, F.lit(0))).alias("text"),
            F.schema_of_variant(last(p["kinds"], F.get(known, F.lit(0)))).alias("kind"),
        )
        return bound(entry, lambda e: F.when(e["known"] == 0, _indented(c)).when(e["kind"] == "STRING", e["text"]).otherwise(notation(e["text"])))

    def shown(p: Column) -> Column:
        return (
            F.when(~F.coalesce(p["one"], F.lit(False)), c)
            .when(p["fields"].isNotNull(), from_field(p))
            .when(F.trim(c) == "null", F.lit("None"))
            .when(p["scalar"].isNull(), c)
            .when(F.ltrim(c).startswith('"'), p["scalar"])
            .otherwise(notation(c))
        )

    return bound(parsed, shown)


def json_struct(c: Column, schema: str) -> Column:
    """Typed struct of a JSON text; broken text gives null fields."""
    return F.from_json(c, schema)


def last_message(messages: Column, default: Column) -> Column:
    """Content of the last message, or the default for none."""
    return F.coalesce(F.try_element_at(messages, F.lit(-1)).getField("content"), default)


def split_list(c: Column) -> Column:
    """Comma-separated text as an array of trimmed, non-empty items."""
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")


def evaluation_prompt(criteria: Column, text: Column, good: Column | None = None, bad: Column | None = None) -> Column:
    """System and user message that ask for a yes/no judgement of a text.

    The examples are shown when both are present and non-empty.
    """
    user = F.concat(F.lit(CRITERIA_PREFIX), criteria, F.lit(CRITERIA_SUFFIX), text, F.lit(INPUT_SUFFIX))
    system = F.lit(EVALUATOR)
    if good is not None and bad is not None:
        shown = F.concat(F.lit(EVALUATOR + GOOD_EXAMPLE), good, F.lit(BAD_EXAMPLE), bad)
        system = F.when((good != "") & (bad != ""), shown).otherwise(system)
    return F.struct(system.alias("system"), user.alias("user"))


def _bullets(heading: str, values: Column) -> Column:
    lines = F.transform(
        F.map_entries(values),
        lambda e: F.concat(F.lit("- "), e.key, F.lit(": "), F.coalesce(e.value.cast("string"), F.lit("None"))),
    )
    return F.when(F.size(values) > 0, F.concat(F.array(F.lit(heading)), lines)).otherwise(
        F.array().cast("array<string>")
    )


def context_text(variables: Column, metadata: Column) -> Column:
    """Variables and metadata as headed ``- name: value`` lines."""
    return F.array_join(
        F.concat(_bullets(VARIABLES_HEADING, variables), _bullets(METADATA_HEADING, metadata)), "\n"
    )


def emoji_score(c: Column) -> Column:
    """``value`` yes without emojis, else no; ``rationale`` lists up to ten distinct ones in code-point order.

    One scan for a single character class decides for most texts; only the
    others are searched for whole emojis, once.
    """

    def judged(found: Column) -> Column:
        listed = F.slice(F.array_sort(F.array_distinct(found)), 1, MAX_LISTED_EMOJIS)
        return F.when(
            F.size(found) > 0,
            F.struct(
                F.lit("no").alias("value"),
                F.concat(F.lit("Emojis detected: ['"), F.array_join(listed, "', '"), F.lit("']")).alias("rationale"),
            ),
        )

    found = F.when(c.rlike(EMOJI_HINT), F.regexp_extract_all(c, F.lit(EMOJI), F.lit(0)))
    none = F.struct(F.lit("yes").alias("value"), F.lit("No emojis detected in the response.").alias("rationale"))
    return F.coalesce(F.element_at(F.transform(F.array(found), judged), 1), none)


def evaluation_input(prompt: Column) -> Column:
    """``{"inputs": {"prompt": ...}}`` as a struct."""
    return F.struct(F.struct(prompt.alias("prompt")).alias("inputs"))


# -- result rendering ---------------------------------------------------------


def render_header(df: DataFrame) -> list[str]:
    """Column names and the rule below them."""
    return [COLUMN_SEPARATOR.join(df.columns), "-" * (sum(len(c) + 3 for c in df.columns) - 1)]


def render_row(df: DataFrame) -> Column:
    """One line of text per row: nulls as ``NULL``, nested values as bounded JSON."""

    def shown(field: T.StructField) -> Column:
        c = F.col(field.name)
        if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            c = preview(F.to_json(c))
        return F.coalesce(c.cast("string"), F.lit(NULL_TEXT))

    return F.concat_ws(COLUMN_SEPARATOR, *[shown(f) for f in df.schema.fields])
