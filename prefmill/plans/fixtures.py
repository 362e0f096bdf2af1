"""Stage inputs derived from the given tables.

Each conversation becomes an instance: its opening message is the query, and one of
the templates below gives instruction, verifiers and sample responses. Each verifier
stands here twice, as Python source that the engine executes and as a SQL expression
of its verdict code, so that SQL can check the executed verdicts.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prefmill.functions.derive import settle
from prefmill.functions.keys import dense_index, row_count
from prefmill.operators.sampling import collect_samples
from prefmill.sources.dialogues import opening_turns

NUM_COMPLETIONS = 8
# Columns of the given tables. Reading with a schema saves a job per scan.
SCHEMAS = {
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "benchmark": "item_id BIGINT, text STRING",
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
    "pages": "page_id BIGINT, url STRING, html STRING",
}


def boolean(test: str) -> str:
    """Verdict code of a function that returns the test's truth value."""
    return f"CASE WHEN {test} THEN 5 ELSE 2 END"


@dataclass(frozen=True)
class FixtureVerifier:
    source: str
    code: str | None  # SQL over the text x; None: does not compile


@dataclass(frozen=True)
class FixtureTemplate:
    instruction: str
    verifiers: tuple[FixtureVerifier, ...]
    good: str
    bad: str


def _verifier(body: str, code: str | None, head: str = "") -> FixtureVerifier:
    lines = "\n".join("    " + line for line in body.split("\n"))
    return FixtureVerifier(f"{head}def evaluate(response: str) -> bool:\n{lines}\n", code)


WORDS = "len(string_split(x, ' '))"
LINE_ENDS = "(length(x) - length(replace(x, chr(10), '')))"
THE = "((length(x) - length(replace(x, 'the', ''))) // 3)"
LONG = "all the words of the line and the rest " * 60
LINES = "one line\n" * 9

TEMPLATES = (
    FixtureTemplate(
        "Use no more than 1500 characters.",
        (
            _verifier("return len(response) <= 1500", boolean("length(x) <= 1500")),
            _verifier(
                "count = 0\nfor _ in response:\n    count += 1\nreturn count <= 1500",
                boolean("length(x) <= 1500"),
            ),
            _verifier("return len(response) <= 1500)", None),
            _verifier("return 1 if len(response) < 1000 else 0", boolean("length(x) < 1000")),
        ),
        "A short reply.", LONG,
    ),
    FixtureTemplate(
        "Use the word the.",
        (
            _verifier("return ' the ' in response", boolean("contains(x, ' the ')")),
            _verifier(
                "return 'found' if ' the ' in response else ''",
                "CASE WHEN contains(x, ' the ') THEN 4 ELSE 0 END",
            ),
            _verifier(
                "return True if response.count('the') >= 8 else None",
                f"CASE WHEN {THE} >= 8 THEN 5 ELSE 0 END",
            ),
            _verifier("return re.search(' the ', response) is not None", "8"),
        ),
        LONG, "No such word here.",
    ),
    FixtureTemplate(
        "Use at least 200 words.",
        (
            _verifier("return len(response.split(' ')) >= 200", boolean(f"{WORDS} >= 200")),
            _verifier(
                "if len(response) < 600:\n    raise ValueError('too short')\n"
                "return len(response.split(' ')) >= 200",
                f"CASE WHEN length(x) < 600 THEN 8 WHEN {WORDS} >= 200 THEN 5 ELSE 2 END",
            ),
            _verifier(
                "count = json.loads(json.dumps(len(response.split(' '))))\nreturn count >= 180",
                boolean(f"{WORDS} >= 180"),
            ),
            _verifier("return response.startswith('#')", boolean("starts_with(x, '#')")),
        ),
        LONG, "Far too few words.",
    ),
    FixtureTemplate(
        "Write at least six lines.",
        (
            _verifier("return response.count('\\n') >= 5", boolean(f"{LINE_ENDS} >= 5")),
            _verifier("return len(response.split('\\n')) >= 6", boolean(f"{LINE_ENDS} >= 5")),
            _verifier("return True", None, head="import no_such_module_anywhere\n"),
            _verifier("raise SystemExit(1)", "8"),
        ),
        LINES, "One line only.",
    ),
    FixtureTemplate(  # no verifier compiles
        "Begin with a capital letter.",
        (
            _verifier("return (", None),
            _verifier("return 1 +", None),
            FixtureVerifier("def check(response):\n    return True\n", None),
            FixtureVerifier("raise RuntimeError('at definition')\n", None),
        ),
        "Yes.", "no.",
    ),
    FixtureTemplate(  # every call fails
        "Give a JSON list.",
        (
            _verifier("return re.match('x', response)", "8"),
            _verifier("return undefined_name", "8"),
            _verifier("return response / 2", "8"),
            _verifier("raise KeyError(response)", "8"),
        ),
        "[1]", "1",
    ),
    FixtureTemplate(  # the verifiers contradict each other
        "Use an even number of characters.",
        (
            _verifier("return len(response) % 2 == 0", boolean("length(x) % 2 = 0")),
            _verifier("return len(response) % 2 == 1", boolean("length(x) % 2 = 1")),
            _verifier("return len(response) % 3 == 0", boolean("length(x) % 3 = 0")),
            _verifier("return len(response) >= 150", boolean("length(x) >= 150")),
        ),
        "even", "odd",
    ),
)
SEEDS = "\n\n".join(
    f"Query: Sample question {i}?\nInstruction: {t.instruction}" for i, t in enumerate(TEMPLATES)
)
# Blocks without one valid test case, for the instances that must fail at parsing.
BAD_BLOCKS = ('{"response": 7, "result": true}', "no JSON", "{}", "")


def case_line(response: str, result: bool) -> str:
    return json.dumps({"response": response, "result": result}, ensure_ascii=False)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: Column | str) -> DataFrame:
    """Rows dealt over the cluster's shuffle partitions, for CPU-heavy work on them.

    Splits sized by bytes are too few for that. The number is given so that adaptive
    execution does not take the small partitions together again.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def templates(spark: SparkSession) -> DataFrame:
    """The templates as a table: a fixed handful of rows, to be broadcast."""
    rows = [
        (
            i, t.instruction, [v.source for v in t.verifiers],
            case_line(t.good, True), case_line(t.bad, False),
        )
        for i, t in enumerate(TEMPLATES)
    ]
    schema = "template INT, instruction STRING, verifiers ARRAY<STRING>, good STRING, bad STRING"
    return F.broadcast(spark.createDataFrame(rows, schema))


def instances(spark: SparkSession, sf_dir: str, spread_out: bool = False) -> DataFrame:
    """(instance_id, query, instruction, verifiers, testcases), one per conversation.

    ``spread_out`` is for CPU-bound work on the rows, such as running verifiers: partitions
    sized by bytes are too few for it. Only the openers move for that; the wide columns
    are added behind the exchange. It hashes the hashed id, because hashing the id again
    would be taken for the partitioning that is already there.
    """
    opened = opening_turns(table(spark, sf_dir, "conversations")).select(
        F.col("conv_id").alias("instance_id"), F.col("text").alias("query"),
        F.pmod("conv_id", F.lit(len(TEMPLATES))).cast("int").alias("template"),
    )
    if spread_out:
        opened = spread(opened, F.xxhash64("instance_id"))
    opened = opened.join(templates(spark), "template")

    def own_case(result: bool) -> Column:
        return F.to_json(
            F.struct(F.col("query").alias("response"), F.lit(result).alias("result"))
        )

    blocks = F.array(
        F.concat_ws("\n", "good", "bad"),
        F.concat(own_case(True), F.lit("\r\nthis line is no JSON")),
        F.concat(
            F.lit('{"response": 7, "result": true}\n{"response": "x", "result": 1}\n\n'),
            F.col("good"),
        ),
        F.concat(own_case(False), F.lit('\u2028["response", "result"]')),
    )
    malformed = F.pmod("instance_id", F.lit(10)) == 7
    testcases = F.when(malformed, F.array(*[F.lit(b) for b in BAD_BLOCKS])).otherwise(blocks)
    return opened.select(
        "instance_id", "query", "instruction", "verifiers", testcases.alias("testcases")
    )


def drawn_completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(instance_id, conv_id, completions): every document is a completion once.

    Documents in hash order, eight to an instance; instances take the conversations in
    turn, also in hash order. Every fifth instance repeats its first document at the end.
    Keys are matched first, so the document texts are shuffled once to their instance, by its conversation: a join with
    what the conversation asks then moves them no more.
    """
    documents = table(spark, sf_dir, "documents")
    conversations = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    index = dense_index(documents.select("doc_id"), "doc_id", "docs")
    placed = index.select(
        "doc_id", F.expr(f"idx div {NUM_COMPLETIONS}").alias("instance_id"),
        F.pmod("idx", F.lit(NUM_COMPLETIONS)).cast("int").alias("slot"),
    )
    turn = F.pmod("instance_id", row_count(conversations))
    turned = settle(placed, {"idx": turn}).join(dense_index(conversations, "conv_id", "convs"), "idx").drop("idx")
    texts = turned.join(documents.select("doc_id", "text"), "doc_id").repartition("conv_id")
    folded = collect_samples(texts, ["instance_id", "conv_id"], "text", "slot", "completions")
    repeated = F.when(
        F.col("instance_id") % 5 == 0, F.concat("completions", F.slice("completions", 1, 1))
    ).otherwise(F.col("completions"))
    return folded.select("instance_id", repeated.alias("completions"), "conv_id")


def completed_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(instance_id, conv_id, completions) with what the conversation's instance asks."""
    asked = instances(spark, sf_dir).withColumnRenamed("instance_id", "conv_id")
    return asked.drop("testcases").join(drawn_completions(spark, sf_dir), "conv_id")
