"""The stages of the data set build, each from table to table.

Stages hand on Parquet or JSON lines (``prefmill.sources.jsonl``). Filtering and
scoring are row-local: they run without a shuffle on whatever partitions they get.
Generating stages are lazy; write their result before reading it twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefmill.functions import chat
from prefmill.functions.text import cut_at_stops, not_empty, strip
from prefmill.functions.tokens import Tokenizer
from prefmill.operators.batching import pad_batches, shuffled_batches, token_views
from prefmill.operators.filtering import filtered_instances, funnel_totals, judge_test_cases, weigh
from prefmill.operators.generation import BackendFactory, SamplingOptions, generate
from prefmill.operators.pairing import preference_pairs
from prefmill.operators.sampling import draw_with_replacement, pick_per_slot, slots
from prefmill.operators.scoring import judge_completions, score, yield_totals
from prefmill.operators.staging import StageRun, run_stage
from prefmill.operators.verification import Budget, Clock
from prefmill.session import materialise
from prefmill.sources.jsonl import COUNTERS

# End marks of a generated text.
TURN_ENDS = ("<|eot_id|>", "<|eom_id|>")


def build_instructions(
    queries: DataFrame, key: str, seeds: str, limit: int | DataFrame, backend: BackendFactory,
    seed: int = 42, batch_size: int = 8, partitions: int | None = None,
) -> DataFrame:
    """Draw queries and ask for one instruction each: (instance_id, query, instruction).

    ``limit`` is how many to draw, or a table whose ``instance_id`` names them.
    """
    stops = ("\n", *TURN_ENDS)
    drawn = draw_with_replacement(queries.select(key, "query"), key, limit, seed)
    prompted = drawn.select(
        "instance_id", "query",
        F.array(chat.instruction_prompt(F.col("query"), seeds)).alias("prompts"),
    )
    options = SamplingOptions(max_tokens=512, stop=stops, seed=seed)
    answered = generate(
        prompted, backend, options, batch_size=batch_size, partitions=partitions
    )
    text = cut_at_stops(F.get("texts", 0), list(stops))
    return answered.select("instance_id", "query", strip(text).alias("instruction"))


def build_artifacts(
    instructions: DataFrame, num_verifiers: int, backend: BackendFactory, seed: int = 42,
    batch_size: int = 8, partitions: int | None = None, path: str | None = None,
) -> DataFrame:
    """Ask for verifiers, then for one block of test cases per verifier.

    The second question quotes the first answer, so the first round is written before
    the second reads it: recomputing it could give other verifiers.
    """
    wanted = instructions.filter(not_empty(F.col("instruction")))
    query, instruction = F.col("query"), F.col("instruction")
    first = wanted.withColumn(
        "prompts",
        F.array_repeat(chat.verifier_prompt(query, instruction), num_verifiers),
    )
    stops = (chat.CODE_FENCE, *TURN_ENDS)
    answered = generate(
        first, backend, SamplingOptions(stop=stops, seed=seed), batch_size=batch_size,
        partitions=partitions,
    )
    verified = materialise(
        answered.withColumn(
            "verifiers",
            F.transform(
                "texts",
                lambda t: F.concat(F.lit(chat.VERIFIER_OPENING), cut_at_stops(t, list(stops))),
            ),
        ).drop("texts"),
        "verifiers", path,
    )
    second = verified.withColumn(
        "prompts",
        F.transform("verifiers", lambda v: chat.test_case_prompt(query, instruction, v)),
    )
    options = SamplingOptions(stop=TURN_ENDS, seed=seed + 1)
    return (
        generate(second, backend, options, batch_size=batch_size, partitions=partitions)
        .withColumn(
            "testcases",
            F.transform(
                "texts",
                lambda t: F.concat(F.lit(chat.TEST_CASE_OPENING), cut_at_stops(t, list(TURN_ENDS))),
            ),
        )
        .drop("texts")
    )


def run_filter(
    artifacts: DataFrame, budget: Budget = Budget(), allow_execution: bool = False,
    partitions: int | None = None,
) -> StageRun:
    """Judge the test cases and write what the verdicts say of each instance, with the funnel's totals.

    ``budget.stage_seconds`` bounds the whole stage; what is not finished by then is in no counter but ``unfinished``.
    """

    def judge(df: DataFrame, clock: Clock | None) -> DataFrame:
        return weigh(judge_test_cases(df, budget, allow_execution, partitions, True, clock))

    outputs = ["instance_id", "query", "instruction", "kept_verifiers", "kept_cases", "kept", *COUNTERS]
    return run_stage(artifacts, judge, outputs, funnel_totals(), budget, "weighed")


def one_row(spark: SparkSession, totals: dict[str, int]) -> DataFrame:
    return spark.createDataFrame([tuple(totals.values())], ", ".join(f"{k} BIGINT" for k in totals))


def filter_artifacts(
    artifacts: DataFrame, budget: Budget = Budget(), allow_execution: bool = False,
    partitions: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(self-consistent instances, funnel totals).

    One job runs the verifiers, writes what the instances need, and counts.
    """
    run = run_filter(artifacts, budget, allow_execution, partitions)
    return filtered_instances(run.rows), one_row(artifacts.sparkSession, {c: run.totals[c] for c in COUNTERS})


def build_completions(
    filtered: DataFrame, num_completions: int, backend: BackendFactory, seed: int = 42,
    batch_size: int = 8, partitions: int | None = None,
) -> DataFrame:
    """Ask for completions, each prompted with one of the instance's verifiers."""
    prompts = F.transform(
        slots(num_completions),
        lambda slot: chat.completion_prompt(
            F.col("query"), F.col("instruction"),
            pick_per_slot(
                F.col("verifiers"), F.size("verifiers"), seed, F.col("instance_id"), slot
            ),
        ),
    )
    answered = generate(
        filtered.withColumn("prompts", prompts), backend,
        SamplingOptions(stop=TURN_ENDS, seed=seed), batch_size=batch_size, partitions=partitions,
    )
    return answered.withColumn(
        "completions", F.transform("texts", lambda t: cut_at_stops(t, list(TURN_ENDS)))
    ).drop("texts")


def run_scoring(
    completed: DataFrame, budget: Budget = Budget(), allow_execution: bool = False,
    partitions: int | None = None,
) -> StageRun:
    """Judge the completions and write the scored instances, with the totals of the yield."""

    def judge(df: DataFrame, clock: Clock | None) -> DataFrame:
        judged = judge_completions(df, budget, allow_execution, partitions, True, clock)
        return score(judged, ("chosen", "rejected", "scores"))

    outputs = ["instance_id", "query", "instruction", "verifiers", "chosen", "rejected", "scores"]
    return run_stage(completed, judge, outputs, yield_totals(), budget, "scored")


def score_completions(
    completed: DataFrame, budget: Budget = Budget(), allow_execution: bool = False,
    partitions: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(scored instances, yield report); one job runs the verifiers, writes and counts.

    Instances over a time limit are counted as input and appear nowhere else.
    """
    run = run_scoring(completed, budget, allow_execution, partitions)
    inputs = sum(run.totals[k] for k in ("finished", "timed_out", "unfinished"))
    report = {"instances": inputs} | {k: run.totals[k] for k in yield_totals()}
    return run.rows, one_row(completed.sparkSession, report)


def training_batches(
    scored: DataFrame, batch_size: int, tokenizer: Tokenizer | None = None, pad_id: int = 0,
    chosen_threshold: float = 0.5, rejected_threshold: float = 0.0, max_loop: int | None = None,
    seed: int = 42, epoch: int = 0,
) -> DataFrame:
    """Pairs, shuffled into batches, tokenized, and padded."""
    pairs = materialise(
        preference_pairs(scored, chosen_threshold, rejected_threshold, max_loop), "pairs"
    )
    batched = shuffled_batches(pairs, batch_size, seed=seed, epoch=epoch)
    return pad_batches(token_views(batched, tokenizer), pad_id)
