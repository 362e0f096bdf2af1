"""String expressions with Python's meaning, kept on the JVM side."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefmill import shipping  # noqa: F401
from prefmill.functions.derive import settle

# Characters that end a line for str.splitlines, and the extra
# control characters that str.strip counts as blank.
LINE_BREAKS = "\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029]"
BLANK = r"[\s\x1c-\x1f]"
# Only the first blank of a run may start the second match: without that, a long run of
# blanks inside a text costs its length squared.
STRIP_PATTERN = f"(?U)^{BLANK}+|(?<!{BLANK}){BLANK}+$"
# The two turn markers of a delimited dialogue.
HUMAN_TURN = "\n\nHuman: "
ASSISTANT_TURN = "\n\nAssistant: "

TEST_CASE = T.StructType(
    [T.StructField("response", T.StringType()), T.StructField("result", T.BooleanType())]
)


def first_turn(dialogue: Column) -> Column:
    """Text between the first and second turn marker; NULL where there is no marker."""
    return F.get(F.split(dialogue, f"{HUMAN_TURN}|{ASSISTANT_TURN}", 3), 1)


def first_message(messages: Column) -> Column:
    """Text of the first message, whoever sent it; ``''`` where there is none."""
    return F.coalesce(F.get(messages, 0)["value"], F.lit(""))


def length_in_range(text: Column, low: int = 5, high: int = 200) -> Column:
    """Length in code points, both ends included."""
    return F.length(text).between(low, high)


def strip(text: Column) -> Column:
    """``str.strip`` over all Unicode blanks."""
    return F.regexp_replace(text, STRIP_PATTERN, "")


def not_empty(text: Column) -> Column:
    return text.isNotNull() & (text != "")


def cut_at_stops(text: Column, stops: list[str]) -> Column:
    """Cut at the first occurrence of each stop string, one stop after the other."""
    for stop in stops:
        text = F.substring_index(text, stop, 1)
    return text


def split_test_lines(blocks: Column) -> Column:
    """Lines of all blocks, in block then line order; a NULL block is empty."""
    return F.flatten(F.transform(blocks, lambda b: F.split(F.coalesce(b, F.lit("")), LINE_BREAKS)))


def _parse_line(line: str | None) -> dict | None:
    try:
        case = json.loads(line)
        response, result = case["response"], case["result"]
        if type(response) is not str or type(result) is not bool:
            return None
        response.encode("utf-8")  # a lone surrogate has no place in a Spark string
    except Exception:
        return None
    return {"response": response, "result": result}


@F.arrow_udf(T.ArrayType(TEST_CASE))
def _parse_lines(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kind = pa.list_(pa.struct([("response", pa.string()), ("result", pa.bool_())]))
    for batch in batches:
        rows = (
            None if lines is None else [c for c in map(_parse_line, lines) if c is not None]
            for lines in batch.to_pylist()
        )
        yield pa.array(rows, type=kind)


def parse_test_cases(blocks: Column) -> Column:
    """Strict test cases from blocks of JSON lines.

    JSON parsing runs in Python because Spark's parsers are laxer (numbers become
    strings, trailing text and single quotes pass) and differ on repeated keys.
    """
    return _parse_lines(split_test_lines(blocks))


# JSON blanks, and the escapes of half a surrogate pair.
JSON_OBJECT = r"(?s)\A[ \t\r\n]*\{.*\}[ \t\r\n]*\z"
HALF_PAIR = r"\\u[dD][89a-fA-F]"


def _parsed(line: Column) -> Column:
    """The line as a VARIANT followed by its md5, NULL where it is no JSON in Spark's eyes.

    Spark ignores what follows a value. Inside a list, and in front of a text that the line cannot
    hold, nothing but a single value leaves the list whole.
    """
    return F.try_parse_json(F.concat(F.lit("["), line, F.lit(',"'), F.md5(line), F.lit('"]')))


def _strict(parsed: Column) -> Column:
    """``case`` where Spark can tell, ``again`` (the line) where only Python can.

    Repeated names, NaN, and names, numbers or nesting beyond Spark's limits are NULL as a VARIANT; half a
    surrogate pair would come out as a question mark. All these are objects in form; other lines are no test cases.
    """
    line, value = parsed["line"], parsed["value"]

    def kind(name: str) -> Column:
        return F.schema_of_variant(F.try_variant_get(value, f"$[0].{name}", "variant"))

    whole = F.coalesce(F.try_variant_get(value, "$[1]", "string") == F.md5(line), F.lit(False))
    doubtful = line.rlike(JSON_OBJECT) & (~whole | line.rlike(HALF_PAIR))
    right = whole & ~doubtful & (kind("response") == "STRING") & (kind("result") == "BOOLEAN")
    case = F.struct(
        F.try_variant_get(value, "$[0].response", "string").alias("response"),
        F.try_variant_get(value, "$[0].result", "boolean").alias("result"),
    )
    return F.struct(F.when(right, case).alias("case"), F.when(doubtful, line).alias("again"))


@F.arrow_udf(T.ArrayType(TEST_CASE))
def _parse_again(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kind = pa.list_(pa.struct([("response", pa.string()), ("result", pa.bool_())]))
    for batch in batches:
        yield pa.array([[line and _parse_line(line) for line in lines or []] for lines in batch.to_pylist()], type=kind)


def with_test_cases(df: DataFrame, blocks: Column, out: str = "cases") -> DataFrame:
    """Add the strict test cases of ``parse_test_cases``, parsed by Spark but for the lines that only Python can tell."""
    parsed = F.transform(split_test_lines(blocks), lambda x: F.struct(x.alias("line"), _parsed(x).alias("value")))
    told = settle(df, {"_told": F.transform(parsed, _strict)})
    some = F.exists("_told", lambda t: t["again"].isNotNull())
    asked = F.when(some, F.transform("_told", lambda t: t["again"])).otherwise(F.array().cast("array<string>"))
    known = told.withColumn("_again", _parse_again(asked))
    merged = F.transform("_told", lambda t, i: F.coalesce(t["case"], F.get("_again", i)))
    return settle(known, {out: F.filter(merged, lambda c: c.isNotNull())}).drop("_told", "_again")
