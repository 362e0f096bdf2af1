"""Pass rates of completions, their labels, and the yield."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefmill.functions.derive import settle
from prefmill.operators.verification import TRUTHY, Budget, Clock, run_verifiers


def judge_completions(
    df: DataFrame, budget: Budget = Budget(), allow_execution: bool = False,
    partitions: int | None = None, keep_timed_out: bool = False, clock: Clock | None = None,
) -> DataFrame:
    """Run all verifiers of an instance over its completions; adds ``verdicts``."""
    return run_verifiers(
        df, F.col("verifiers"), F.col("completions"), budget=budget,
        allow_execution=allow_execution, partitions=partitions, keep_timed_out=keep_timed_out,
        clock=clock,
    )


OUTPUTS = ("rates", "chosen", "rejected", "scores")


def score(judged: DataFrame, outputs: tuple[str, ...] = OUTPUTS) -> DataFrame:
    """Add ``outputs``: ``rates``, ``chosen``, ``rejected`` and ``scores``, or some of them.

    Ask for what is read only: settled columns are worked out whether read or not.
    ``rates`` is truthy verdicts / verifiers, per completion position. The two label
    lists go by position too, so a repeated completion appears in them repeatedly.
    ``scores`` goes by text: first-occurrence order, last rate.
    """
    rates = F.transform(
        "completions",
        lambda c, i: F.try_divide(
            F.size(
                F.filter(
                    "verdicts.matrix",
                    lambda v: F.coalesce(F.get(v["codes"], i), F.lit(0)).bitwiseAND(
                        F.lit(TRUTHY)
                    ) != 0,
                )
            ),
            F.size("verifiers"),
        ),
    )
    zipped = F.transform(
        "completions",
        lambda c, i: F.struct(c.alias("completion"), F.get("rates", i).alias("score")),
    )
    spare = [c for c in ("rates", "_zipped") if c not in outputs]
    out = settle(judged, {"rates": rates})
    if set(outputs) <= {"rates"}:
        return out
    out = settle(out, {"_zipped": zipped})
    labels = {
        "chosen": F.filter("_zipped", lambda z: z["score"] >= 0.5)["completion"],
        "rejected": F.filter("_zipped", lambda z: z["score"] == 0)["completion"],
    }
    labels = {name: value for name, value in labels.items() if name in outputs}
    if "scores" not in outputs:
        return settle(out, labels).drop(*spare)
    # Most instances hold no repeated text; only those that do pay for the sorts.
    repeats = F.size(F.array_distinct("completions")) < F.size("completions")

    def ordered(position):
        entries = F.transform(
            "_zipped",
            lambda z, i: F.struct(
                z["completion"].alias("completion"), position(i).alias("at"),
                z["score"].alias("score"),
            ),
        )
        return F.when(repeats, F.array_sort(entries))

    out = settle(out, {"_early": ordered(lambda i: i), "_late": ordered(lambda i: -i)})

    def heads(name):
        """First entry of each text in a list sorted by text."""
        return F.filter(
            name,
            lambda e, i: (i == 0) | (F.get(name, i - 1)["completion"] != e["completion"]),
        )

    by_text = F.zip_with(
        heads("_early"), heads("_late"),
        lambda first, last: F.struct(
            first["at"].alias("at"), first["completion"].alias("completion"),
            last["score"].alias("score"),
        ),
    )
    by_first = F.transform(
        F.array_sort(by_text),
        lambda e: F.struct(e["completion"].alias("completion"), e["score"].alias("score")),
    )
    labels["scores"] = F.when(repeats, by_first).otherwise(F.col("_zipped"))
    return settle(out, labels).drop(*spare, "_early", "_late")


def scored_rows(scored: DataFrame, *more: str) -> DataFrame:
    """The columns the scoring stage hands on, and ``more``."""
    return scored.select(
        "instance_id", "query", "instruction", "verifiers", "chosen", "rejected", "scores", *more
    )


def yield_totals() -> dict[str, Column]:
    """Totals over scored instances.

    Pairs, completions and prompts count instances with both labels only;
    ``unique_completions`` counts list entries, repeats included. An instance without label lists counts nothing.
    """
    chosen, rejected = F.size("chosen"), F.size("rejected")
    both = F.least(chosen, rejected) > 0

    def total(value, when):
        return F.coalesce(F.sum(F.when(when, value).otherwise(0)), F.lit(0))

    return {
        "pairs": total(F.greatest(chosen, rejected), both),
        "unique_completions": total(chosen + rejected, both),
        "unique_prompts": total(F.lit(1), both),
        "chosen_completions": total(chosen, chosen > 0),
        "rejected_completions": total(rejected, rejected > 0),
    }


def yield_report(scored: DataFrame, instances: int | None = None) -> DataFrame:
    """One row with the totals. ``instances`` may give the number of inputs where time-outs removed some."""
    counted = F.count(F.lit(1)) if instances is None else F.lit(instances).cast("bigint")
    return scored.agg(
        counted.alias("instances"), *[total.alias(name) for name, total in yield_totals().items()]
    )
