"""Stable hashes and the dense index built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefmill.functions.derive import settle

HASH_BITS = 60  # 15 hex digits


def _col(part) -> Column:
    return part if isinstance(part, Column) else F.lit(part)


def md5_int(*parts) -> Column:
    """Non-negative 60-bit integer from the parts joined by ``:``.

    Plain Python values are literals. The same number comes out of any engine with
    md5, which makes draws reproducible and checkable outside Spark.
    """
    text = F.concat_ws(":", *[_col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def dense_index(df: DataFrame, key: str, seed, out: str = "idx", bits: int = 16) -> DataFrame:
    """Number the rows 0..n-1 in order of ``md5_int(seed, key)``; ``key`` must be unique.

    A global ``row_number`` would sort everything in one task. Here the top ``bits``
    of the hash name a range bucket, rows are ranked inside their bucket, and the
    bucket's offset is added. The hash of a unique key spreads evenly, so no bucket
    runs hot whatever the data. Only the offsets are broadcast: at most ``2**bits``
    rows, however large the input, summed up in one small task. ``bits`` also bounds the number of tasks that rank.
    ``df`` is read twice, so pass a table or something cheap to recompute.
    """
    if not 1 <= bits <= 20:
        raise ValueError("bits must lie in 1..20, which bounds the broadcast offsets")
    hashed = settle(df, {"_h": md5_int(seed, F.col(key))}).withColumn(
        "_bucket", F.shiftright("_h", HASH_BITS - bits)
    )
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        hashed.groupBy("_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy("_h", key))
    return (
        hashed.withColumn("_rank", rank)
        .join(F.broadcast(offsets), "_bucket")
        .withColumn(out, F.col("_offset") + F.col("_rank") - 1)
        .drop("_h", "_bucket", "_rank", "_offset")
    )


def row_count(df: DataFrame) -> Column:
    """The number of rows as a scalar subquery, evaluated inside the plan."""
    return df.agg(F.count(F.lit(1)).alias("n")).scalar()
