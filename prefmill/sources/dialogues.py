"""Query sources: seed blob, delimited dialogues, message lists, long tables of turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefmill.functions.text import (
    ASSISTANT_TURN, HUMAN_TURN, first_message, first_turn, length_in_range,
)

MESSAGES = T.StructType(
    [
        T.StructField(
            "conversations",
            T.ArrayType(
                T.StructType(
                    [T.StructField("from", T.StringType()), T.StructField("value", T.StringType())]
                )
            ),
        )
    ]
)
DIALOGUE = T.StructType([T.StructField("chosen", T.StringType())])


def read_seed_blob(spark: SparkSession, path: str) -> str:
    """One seed file as one string, to be spliced into a prompt as a literal."""
    blobs = spark.read.text(path, wholetext=True).take(2)
    if len(blobs) != 1:
        raise ValueError(f"{path} must be exactly one seed file")
    return blobs[0]["value"]


def delimited_queries(
    dialogues: DataFrame, column: str = "chosen", keep: tuple[str, ...] = (),
    low: int = 5, high: int = 200,
) -> DataFrame:
    """First turn of each delimited dialogue as ``query``; duplicates stay.

    Dialogues without a marker drop out. ``keep`` names key columns to carry along.
    """
    return dialogues.select(*keep, first_turn(F.col(column)).alias("query")).filter(
        length_in_range(F.col("query"), low, high)
    )


def message_queries(
    dialogues: DataFrame, column: str = "conversations", keep: tuple[str, ...] = (),
    low: int = 5, high: int = 200,
) -> DataFrame:
    """First message of each message list as ``query``, whoever sent it."""
    return dialogues.select(*keep, first_message(F.col(column)).alias("query")).filter(
        length_in_range(F.col("query"), low, high)
    )


def opening_turns(turns: DataFrame, roles: tuple[str, ...] | None = None) -> DataFrame:
    """(conv_id, role, text) of each conversation's first turn, from a table of turns.

    ``min_by`` combines on the map side: a conversation that holds a third of the
    table ships one row per input split, and no conversation is ever collected.
    """
    if roles:
        turns = turns.filter(F.col("role").isin(*roles))
    return (
        turns.groupBy("conv_id")
        .agg(F.min_by(F.struct("role", "text"), "turn").alias("first"))
        .select("conv_id", "first.role", F.coalesce("first.text", F.lit("")).alias("text"))
    )


def delimited_openings(turns: DataFrame) -> DataFrame:
    """Delimited form (conv_id, chosen) of each conversation's first two-party turn.

    The query of a dialogue ends at the second marker, and no marker can straddle
    two turns (a turn ends before the marker's blank line, and a marker ends in a
    blank), so the opening turn closed by the next marker yields the very query the
    whole dialogue would.
    """
    marker = F.when(F.col("role") == "user", HUMAN_TURN).otherwise(ASSISTANT_TURN)
    follow = F.when(F.col("role") == "user", ASSISTANT_TURN).otherwise(HUMAN_TURN)
    return opening_turns(turns, ("user", "assistant")).select(
        "conv_id", F.concat(marker, F.col("text"), follow).alias("chosen")
    )


def load_queries(
    spark: SparkSession, name: str, path: str, low: int = 5, high: int = 200, lines: bool = False
) -> DataFrame:
    """Query source by name: ``hh`` (delimited, JSON lines) or ``sharegpt`` (one JSON list).

    A malformed line or list stops the job. One task parses a whole list; ``lines`` reads
    ``sharegpt`` as JSON lines instead, which large files should be written as.
    """
    strict = spark.read.option("mode", "FAILFAST")
    if name == "hh":
        return delimited_queries(strict.schema(DIALOGUE).json(path), low=low, high=high)
    if name == "sharegpt":
        raw = strict.schema(MESSAGES).json(path, multiLine=not lines)
        return message_queries(raw, low=low, high=high)
    raise ValueError(f"no query source is called {name!r}")
