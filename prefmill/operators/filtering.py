"""Self-consistency of verifiers and test cases, per instance and in total.

Everything about an instance is decided inside its row, from its verdict matrix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefmill.functions.derive import settle
from prefmill.functions.text import with_test_cases
from prefmill.operators.verification import EQ_FALSE, EQ_TRUE, Budget, Clock, run_verifiers
from prefmill.sources.jsonl import COUNTERS


def judge_test_cases(
    df: DataFrame, budget: Budget = Budget(), allow_execution: bool = False,
    partitions: int | None = None, keep_timed_out: bool = False, clock: Clock | None = None,
) -> DataFrame:
    """Parse the test case blocks and run all verifiers over them.

    Adds ``cases`` and ``verdicts``; instances over the time limit are gone, unless they are to be kept. ``partitions``
    spreads the blocks before they are parsed, so both are spread and only raw text moves.
    """
    if partitions:
        df = df.repartition(partitions)
    parsed = with_test_cases(df, F.col("testcases"))
    return run_verifiers(
        parsed, F.col("verifiers"), F.col("cases.response"), budget=budget,
        allow_execution=allow_execution, keep_timed_out=keep_timed_out, clock=clock,
    )


def agrees(code: Column, expected: Column) -> Column:
    """Strict verdict: the result equals the expected Boolean."""
    return code.bitwiseAND(F.when(expected, EQ_TRUE).otherwise(EQ_FALSE)) != 0


def weigh(judged: DataFrame) -> DataFrame:
    """Decide kept cases and kept verifiers, and count the steps.

    Adds ``kept_cases`` and ``kept_verifiers`` as arrays with original positions,
    ``kept`` (the instance passes every gate) and the counters. A counter behind a
    failed gate is 0 even where its step would have found something.
    """
    compiled = F.filter(
        F.transform(
            "verdicts.matrix",
            lambda m, i: F.struct(
                i.alias("pos"), F.get("verifiers", i).alias("source"),
                m["compiled"].alias("compiled"), m["codes"].alias("codes"),
            ),
        ),
        lambda v: v["compiled"],
    )
    votes = F.transform(
        "cases",
        lambda c, i: F.struct(
            i.alias("pos"), c["response"].alias("response"), c["result"].alias("result"),
            F.transform("_compiled", lambda v: agrees(F.get(v["codes"], i), c["result"])).alias(
                "votes"
            ),
        ),
    )
    kept_cases = F.filter("_votes", lambda c: F.exists(c["votes"], lambda b: b))
    rated = F.transform(
        "_compiled",
        lambda v, j: F.struct(
            v["pos"].alias("pos"), v["source"].alias("source"),
            F.size(F.filter("kept_cases", lambda c: F.get(c["votes"], j))).alias("passed"),
        ),
    )
    out = settle(judged, {"_compiled": compiled})
    out = settle(out, {"_votes": votes})
    out = settle(out, {"kept_cases": kept_cases})
    out = settle(out, {"rated_verifiers": rated, "_n": F.size("kept_cases")})
    # passed / n >= 0.8 in whole numbers
    good = F.filter("rated_verifiers", lambda v: v["passed"] * 5 >= F.col("_n") * 4)
    out = settle(out, {"kept_verifiers": good})
    zero = F.lit(0)
    some_compiled = F.size("_compiled") > 0
    some_parsed = some_compiled & (F.size("cases") > 0)
    some_kept = some_parsed & (F.col("_n") > 0)
    kept = some_kept & (F.size("kept_verifiers") > 0)
    passes = F.aggregate("rated_verifiers", zero, lambda acc, v: acc + v["passed"])
    steps = {
        "verifier_count": F.size("verifiers"),
        "testcase_str_count": F.size("testcases"),
        "compiled_verifiers": F.size("_compiled"),
        "test_cases_parse": F.when(some_compiled, F.size("cases")).otherwise(zero),
        "test_cases_pass_gte1": F.when(some_parsed, F.col("_n")).otherwise(zero),
        "verifiers_pass_80pct": F.when(some_kept, F.size("kept_verifiers")).otherwise(zero),
        "total_passes": F.when(some_kept, passes).otherwise(zero),
        "unique_instances": kept.cast("int"),
    }
    return settle(out, {**steps, "kept": kept}).drop("_compiled", "_votes", "_n")


def filtered_instances(weighed: DataFrame) -> DataFrame:
    """Instances that pass every gate, with kept verifiers and kept cases only."""
    return weighed.filter("kept").select(
        "instance_id", "query", "instruction",
        F.col("kept_verifiers.source").alias("verifiers"),
        F.transform(
            "kept_cases",
            lambda c: F.struct(c["response"].alias("response"), c["result"].alias("result")),
        ).alias("test_cases"),
        *COUNTERS,
    )


def funnel_totals() -> dict[str, Column]:
    """Totals of the counters, for all finished instances, kept or not."""
    return {c: F.coalesce(F.sum(c), F.lit(0)) for c in COUNTERS}


def funnel(weighed: DataFrame) -> DataFrame:
    """One row with the totals of the counters."""
    return weighed.agg(*[total.alias(c) for c, total in funnel_totals().items()])
