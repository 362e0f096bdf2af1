"""Chosen/rejected pairs from scored completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefmill.functions.chat import training_prompt
from prefmill.functions.derive import settle


def relabel(
    scored: DataFrame, chosen_threshold: float = 0.5, rejected_threshold: float = 0.0
) -> DataFrame:
    """Derive ``chosen`` and ``rejected`` from ``scores``; a completion may land in both."""

    def is_rejected(s: Column) -> Column:
        below = s["score"] < rejected_threshold
        return below | (s["score"] == 0) if rejected_threshold == 0 else below

    labels = {
        "chosen": F.filter("scores", lambda s: s["score"] >= chosen_threshold)["completion"],
        "rejected": F.filter("scores", is_rejected)["completion"],
    }
    return settle(scored.drop("chosen", "rejected"), labels)


def zip_cyclic(chosen: Column, rejected: Column, max_loop: int | None = None) -> Column:
    """Pair two lists, the longer in order, the shorter repeated.

    With ``max_loop`` the shorter list is used at most that many times; None and 0
    set no bound, a negative number leaves no pairs.
    """
    n_chosen, n_rejected = F.size(chosen), F.size(rejected)
    short, count = F.least(n_chosen, n_rejected), F.greatest(n_chosen, n_rejected)
    if max_loop:
        count = F.least(count, short * F.lit(max_loop))
    pairs = F.transform(
        F.sequence(F.lit(0), count - 1),
        lambda i: F.struct(
            F.get(chosen, F.pmod(i, n_chosen)).alias("chosen"),
            F.get(rejected, F.pmod(i, n_rejected)).alias("rejected"),
        ),
    )
    return F.when((short > 0) & (count > 0), pairs)


def preference_pairs(
    scored: DataFrame, chosen_threshold: float = 0.5, rejected_threshold: float = 0.0,
    max_loop: int | None = None,
) -> DataFrame:
    """(instance_id, pair_idx, prompt, chosen, rejected), one row per pair."""
    labelled = relabel(scored, chosen_threshold, rejected_threshold)
    pairs = zip_cyclic(F.col("chosen"), F.col("rejected"), max_loop)
    return labelled.select(
        "instance_id", training_prompt(F.col("query"), F.col("instruction")).alias("prompt"),
        F.posexplode(pairs).alias("pair_idx", "pair"),
    ).select("instance_id", "pair_idx", "prompt", "pair.chosen", "pair.rejected")
