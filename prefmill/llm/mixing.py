"""Mixing sources to target weights by nested hash thresholds, in DataFrame operations only.

Every document has a 60-bit hash of its key. A source takes whole passes over its documents
plus those whose hash lies below the source's threshold, so a larger budget takes a superset
of a smaller one. Thresholds come from histograms of words by source and hash bucket: twelve
bits at a time, only the bucket in which the budget runs out is split further, so nothing is
sorted and no histogram has more than 4,096 buckets a source.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefmill.functions.keys import HASH_BITS, md5_int
from prefmill.llm.common import text_of, word_count
from prefmill.operators.lookup import skew_safe_join
from prefmill.session import materialise

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
SEED = 42
STEP_BITS = 12

#: A table of at most this many sources is broadcast; a larger one is joined by shuffle.
BROADCAST_SOURCES = 10_000

SOURCE, HASH, SIZE = "_source", "_hash", "_size"


@dataclass(frozen=True)
class Mix:
    """Per source: its size, target, whole passes, and hash threshold of the last pass."""

    table: DataFrame
    small: bool


def mix_columns(key: str = "doc_id", source: str = "source", text: str = "text") -> list[Column]:
    """What mixing needs of a document: source key, hash and size in words.

    A null text has size 0. A null source is a source of its own. A document without key
    is hashed by its text; equal keys share a hash and so a fate.
    """
    tagged = F.when(F.col(source).isNull(), "n").otherwise(F.concat(F.lit("s"), F.col(source)))
    name = F.coalesce(
        F.concat(F.lit("k"), F.col(key).cast("string")), F.concat(F.lit("t"), text_of(text))
    )
    return [
        tagged.alias(SOURCE),
        md5_int(SEED, name).alias(HASH),
        word_count(text).alias(SIZE),
    ]


def source_targets(
    sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS,
    total: float | None = None,
) -> DataFrame:
    """Targets of a table of one row per source (``_source``, ``source_size``).

    Sources in code point order, null last, take the weights in turn and share ``total``
    (all sizes by default). A target stops at ``max_repeats`` times its source's size; the
    excess is shared again by weight until no target is above. That fixed point is
    ``min(cap, weight * level)`` for one level, found by one pass over the sources in order
    of cap per weight.
    """
    order = Window.orderBy(F.col(SOURCE).startswith("n").cast("int"), SOURCE)
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weighed = sizes.withColumn(
        "_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1)
    ).withColumn("_cap", F.col("source_size") * F.lit(float(max_repeats)))
    weighed = weighed.withColumn("_ratio", F.col("_cap") / F.col("_w"))
    ranked = Window.orderBy("_ratio", SOURCE)
    before = ranked.rowsBetween(Window.unboundedPreceding, -1)
    after = ranked.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    wanted = F.lit(float(total)) if total is not None else F.sum("source_size").over(everything)
    levels = weighed.select(
        "*",
        (
            (wanted - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
            / F.sum("_w").over(after)
        ).alias("_level"),
    )
    fits = F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", SOURCE, "_level"))
    return levels.select(
        SOURCE,
        "source_size",
        F.coalesce(
            F.least("_cap", F.col("_w") * F.min(fits).over(everything)["_level"]), "_cap"
        ).alias("target"),
    )


def _with_sources(rows: DataFrame, table: DataFrame, small: bool) -> DataFrame:
    if small:
        return rows.join(F.broadcast(table), SOURCE)
    return skew_safe_join(rows, table, [SOURCE], spread=HASH)


def plan_mix(
    rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS,
    total: float | None = None,
) -> Mix:
    """Thresholds for ``rows`` (``_source``, ``_hash``, ``_size``), which are read six times:
    pass a written table. Sums are taken per source and bucket before any shuffle, so a hot
    source costs a few thousand rows per task. An empty table gives an empty plan.
    """
    sizes = rows.groupBy(SOURCE).agg(F.sum(SIZE).alias("source_size"))
    targets = materialise(source_targets(sizes, weights, max_repeats, total), "mix-targets")
    small = targets.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    passes = F.coalesce(F.floor(F.col("target") / F.nullif("source_size", F.lit(0))), F.lit(0))
    targets = targets.withColumn("passes", passes.cast("bigint")).withColumn(
        "rest", F.col("target") - F.col("passes") * F.col("source_size")
    )
    state = targets.filter("rest > 0").select(
        SOURCE, "rest", F.lit(0).cast("bigint").alias("used"), F.lit(0).cast("bigint").alias("prefix")
    )
    for level in range(HASH_BITS // STEP_BITS):
        shift = HASH_BITS - STEP_BITS * (level + 1)
        buckets = (
            _with_sources(rows.select(SOURCE, HASH, SIZE), state, small)
            .filter(F.shiftright(F.shiftright(HASH, shift), STEP_BITS) == F.col("prefix"))
            .groupBy(SOURCE, F.shiftright(HASH, shift).alias("bucket"))
            .agg(F.sum(SIZE).alias("words"), F.max("rest").alias("rest"), F.max("used").alias("used"))
        )
        upto = F.sum("words").over(Window.partitionBy(SOURCE).orderBy("bucket"))
        over = F.col("used") + F.col("upto") > F.col("rest")
        state = (
            buckets.withColumn("upto", upto)
            .filter(over)
            .groupBy(SOURCE)
            .agg(F.min(F.struct("bucket", "words", "upto", "rest", "used")).alias("b"))
            .select(
                SOURCE,
                F.col("b.rest").alias("rest"),
                (F.col("b.used") + F.col("b.upto") - F.col("b.words")).alias("used"),
                F.col("b.bucket").alias("prefix"),
                F.col("b.words").alias("words"),
            )
        )
    nearer = F.col("used") + F.col("words") - F.col("rest") < F.col("rest") - F.col("used")
    edge = state.select(SOURCE, (F.col("prefix") + nearer.cast("bigint")).alias("threshold"))
    table = targets.join(edge, SOURCE, "left").withColumn(
        "threshold", F.coalesce("threshold", F.lit(0).cast("bigint"))
    )
    return Mix(materialise(table.drop("rest"), "mix-plan"), small)


def apply_mix(rows: DataFrame, mix: Mix) -> DataFrame:
    """Add ``source_size``, ``target`` and ``copies``, how often the mix holds the row.

    ``rows`` has ``_source`` and ``_hash``. The copies of a document are the source's whole
    passes, and one more below the threshold: never above the repeat limit, since a source
    at its limit has no partial pass. A source without words has no copies.
    """
    joined = _with_sources(rows, mix.table, mix.small)
    extra = (F.col(HASH) < F.col("threshold")).cast("bigint")
    return joined.withColumn("copies", F.col("passes") + extra).drop("passes", "threshold")
