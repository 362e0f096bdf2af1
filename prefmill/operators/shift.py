"""Where a trained model moved away from its reference, token by token."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefmill.functions.derive import settle

# The blank and line-break letters of byte-level vocabularies, and the
# marker that ends a chat header.
BLANK_LETTERS = "ĠĊ"
HEADER_END = "<|end_header_id|>"


def clean_tokens(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.translate(t, BLANK_LETTERS, ""))


def last_index(items: Column, target: str) -> Column:
    """0-based position of the last ``target``; an error where it is missing."""
    from_end = F.array_position(F.reverse(items), F.lit(target))
    return F.when(from_end > 0, (F.size(items) - from_end).cast("int")).otherwise(
        F.raise_error(F.lit(f"{target} is not in the list")).cast("int")
    )


def token_shift_scores(
    rows: DataFrame, tokens: str = "tokens", model: str = "model_lp", reference: str = "ref_lp"
) -> DataFrame:
    """Replace the log-prob arrays by ``scores``, one per token.

    A score is model - reference, clipped to [-1, 1]; the first token and everything
    before the response score 0. The response starts two tokens after the last header.
    """
    clipped = F.zip_with(
        model, reference, lambda m, r: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), m - r))
    )
    cleaned = rows.withColumn(tokens, clean_tokens(F.col(tokens)))
    # Settled: merged into the transform, the search would run once per token.
    started = settle(cleaned, {"_start": last_index(F.col(tokens), HEADER_END) + 2})
    scores = F.transform(
        F.concat(F.array(F.lit(0.0)), clipped),
        lambda s, i: F.when(i < F.col("_start"), F.lit(0.0)).otherwise(s),
    )
    return started.withColumn("scores", scores).drop("_start", model, reference)


def token_shift_table(scored: DataFrame, keys: list[str], tokens: str = "tokens") -> DataFrame:
    """One row per token: position, token, score and direction."""
    rows = scored.select(
        *keys, F.posexplode(F.arrays_zip(F.col(tokens).alias("token"), F.col("scores").alias("score")))
        .alias("pos", "t")
    ).select(*keys, "pos", F.col("t.token").alias("token"), F.col("t.score").alias("score"))
    direction = F.when(F.col("score") > 0, "up").when(F.col("score") < 0, "down").otherwise("none")
    return rows.withColumn("direction", direction)


def token_shift_rollup(table: DataFrame) -> DataFrame:
    """Mean score and count per token; partial sums keep frequent tokens cheap."""
    return table.groupBy("token").agg(
        F.avg("score").alias("avg_score"), F.count(F.lit(1)).alias("n")
    )
