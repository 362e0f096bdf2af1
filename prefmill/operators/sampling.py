"""Draws and expansions: queries with replacement, verifier per slot, samples per prompt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefmill.functions.derive import settle
from prefmill.functions.keys import dense_index, md5_int, row_count


def draw_with_replacement(
    items: DataFrame, key: str, draws: int | DataFrame, seed=42, out_key: str = "instance_id"
) -> DataFrame:
    """Uniform draws, with replacement, from rows with a unique ``key``.

    ``draws`` is how many, or a table whose column ``out_key`` names them. Draw i takes
    the row whose dense index is ``md5_int(seed, i) % n``: an equi-join on a unique
    index. A draw lands on any row alike, so the join has no hot key while n is large;
    a small ``items`` is broadcast by its runtime size. ``out_key`` is the stable id of
    the drawn row from here on.
    """
    if isinstance(draws, int):
        draws = items.sparkSession.range(draws).withColumnRenamed("id", out_key)
    at = F.pmod(md5_int(seed, F.col(out_key)), row_count(items))
    asked = settle(draws.select(out_key), {"_idx": at})
    return asked.join(dense_index(items, key, seed, out="_idx"), "_idx").drop("_idx")


def pick_per_slot(items: Column, size: Column, *hash_parts) -> Column:
    """Uniform element of an array, chosen by the hash of the parts; NULL if empty."""
    at = F.pmod(md5_int(*hash_parts), F.greatest(size, F.lit(1))).cast("int")
    return F.get(items, at)


def slots(count: int) -> Column:
    """Array 0..count-1."""
    return F.sequence(F.lit(0), F.lit(count - 1)) if count > 0 else F.array().cast("array<int>")


def expand_samples(df: DataFrame, count: int, out: str = "sample_idx") -> DataFrame:
    """``count`` rows per row, numbered by ``sample_idx``."""
    return df.withColumn(out, F.explode(slots(count)))


def collect_samples(
    df: DataFrame, key: str, text: str = "text", slot: str = "sample_idx", out: str = "texts",
    count: int | None = None,
) -> DataFrame:
    """Fold the samples of each key back into one array in slot order.

    The group is the fixed number of samples ``expand_samples`` made, never more. With
    ``count`` the array has that many entries and each text sits at its slot, NULL where
    a slot is missing; else a missing slot would shift those behind it.
    """
    pairs = F.array_sort(F.collect_list(F.struct(slot, text)))
    if count is None:
        return df.groupBy(key).agg(F.transform(pairs, lambda p: p[text]).alias(out))
    at = F.map_from_entries(pairs)
    return df.groupBy(key).agg(F.transform(slots(count), lambda i: F.try_element_at(at, i)).alias(out))
