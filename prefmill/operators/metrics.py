"""Preference metrics from log-probabilities a trainer wrote back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mask_sum(mask: Column) -> Column:
    return F.aggregate(mask, F.lit(0), lambda acc, m: acc + m)


def completion_length(sequence_mask: Column, context_mask: Column) -> Column:
    return mask_sum(sequence_mask) - mask_sum(context_mask)


def completion_logprob(logprobs: Column, length: Column) -> Column:
    """Sum of the last ``length`` per-token log-probabilities; 0 for length 0."""
    used = F.least(length, F.size(logprobs))
    tail = F.slice(logprobs, -used, used)
    return F.when(
        used > 0, F.aggregate(tail, F.lit(0.0), lambda acc, x: acc + x)
    ).otherwise(F.lit(0.0))


def log_sigmoid(x: Column) -> Column:
    """Stable for large arguments of either sign."""
    return F.least(x, F.lit(0.0)) - F.log1p(F.exp(-F.abs(x)))


def completion_sums(rows: DataFrame) -> DataFrame:
    """Replace the four log-prob arrays by their completion sums."""
    sides = {
        f"{model}_{side}": completion_logprob(F.col(f"{model}_{side}"), F.col(f"len_{side}"))
        for model in ("pi", "ref")
        for side in ("chosen", "rejected")
    }
    return rows.withColumns(sides)


def preference_metrics(
    sums: DataFrame, kl_beta: float = 0.1, include_chosen_nll_loss: bool = False
) -> DataFrame:
    """Loss, margins and accuracy per batch; the NLL term on request, added to ``loss``."""
    pi = F.col("pi_chosen") - F.col("pi_rejected")
    ref = F.col("ref_chosen") - F.col("ref_rejected")
    # Accuracy compares the two policy/reference ratios, the loss the two margins.
    ahead = (F.col("pi_chosen") - F.col("ref_chosen")) - (
        F.col("pi_rejected") - F.col("ref_rejected")
    )
    report = sums.groupBy("batch_id").agg(
        (-F.avg(log_sigmoid(F.lit(kl_beta) * (pi - ref)))).alias("dpo_loss"),
        F.avg(pi).alias("pi_margin"),
        F.avg(ref).alias("ref_margin"),
        F.avg((ahead > 0).cast("double")).alias("dpo_accuracy"),
        F.try_divide(-F.sum("pi_chosen"), F.sum("len_chosen")).alias("chosen_nll_loss"),
    ).withColumn("margin_delta", F.col("pi_margin") - F.col("ref_margin"))
    if include_chosen_nll_loss:
        return report.withColumn("loss", F.col("dpo_loss") + F.col("chosen_nll_loss"))
    return report.withColumn("loss", F.col("dpo_loss")).drop("chosen_nll_loss")
