"""Evaluation scorecards over outcome tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The benchmarks a scorecard exists for.
BENCHMARKS = ("ifeval", "hellaswag")


def limit_items(outcomes: DataFrame, item: str, limit: int | None) -> DataFrame:
    """Rows of the first ``limit`` items by key; None and 0 keep all."""
    if not limit:
        return outcomes
    first = outcomes.select(item).distinct().orderBy(item).limit(limit)
    return outcomes.join(first, item, "left_semi")


def instruction_scorecard(outcomes: DataFrame) -> DataFrame:
    """Accuracy per prompt (all its flags hold) and per instruction, strict and loose.

    ``outcomes`` is (prompt_id, strict, loose), one row per instruction. Prompts are
    combined by counts, never collected.
    """
    prompts = outcomes.groupBy("prompt_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("strict").cast("int")).alias("strict"),
        F.sum(F.col("loose").cast("int")).alias("loose"),
    )

    def share(kind: str):
        return F.avg((F.col(kind) == F.col("n")).cast("double"))

    card = prompts.agg(
        share("strict").alias("prompt_strict_acc"),
        (F.sum("strict") / F.sum("n")).alias("inst_strict_acc"),
        share("loose").alias("prompt_loose_acc"),
        (F.sum("loose") / F.sum("n")).alias("inst_loose_acc"),
    )
    total = (
        F.col("prompt_strict_acc") + F.col("inst_strict_acc")
        + F.col("prompt_loose_acc") + F.col("inst_loose_acc")
    )
    return card.withColumn("average", total / 4)


def flags_to_rows(outcomes: DataFrame) -> DataFrame:
    """(prompt_id, strict[], loose[]) as one row per instruction."""
    flags = F.explode(F.arrays_zip("strict", "loose")).alias("f")
    return outcomes.select("prompt_id", flags).select("prompt_id", "f.strict", "f.loose")


def choice_scorecard(outcomes: DataFrame) -> DataFrame:
    """Accuracy by log-likelihood and by log-likelihood per option length.

    ``outcomes`` is (item_id, option, ll, option_text, gold). Ties go to the first option.
    """
    normal = F.try_divide(F.col("ll"), F.length("option_text"))
    items = outcomes.groupBy("item_id").agg(
        F.max_by("option", F.struct(F.col("ll"), -F.col("option"))).alias("best"),
        F.max_by("option", F.struct(normal, -F.col("option"))).alias("best_norm"),
        F.max("gold").alias("gold"),
    )
    return items.agg(
        F.avg((F.col("best") == F.col("gold")).cast("double")).alias("acc"),
        F.avg((F.col("best_norm") == F.col("gold")).cast("double")).alias("acc_norm"),
    )


def scorecard(benchmark: str, outcomes: DataFrame, limit: int | None = None) -> DataFrame:
    """Scorecard by benchmark name; other names raise ``ValueError``."""
    if benchmark not in BENCHMARKS:
        raise ValueError(f"no scorecard for {benchmark!r}; choose from {BENCHMARKS}")
    if benchmark == "ifeval":
        return instruction_scorecard(limit_items(outcomes, "prompt_id", limit))
    return choice_scorecard(limit_items(outcomes, "item_id", limit))
