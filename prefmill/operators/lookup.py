"""Equi-join against a unique-key table, safe when one key holds most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefmill.functions.keys import row_count


MAX_HOT_KEYS = 10_000


def skew_safe_join(
    rows: DataFrame, table: DataFrame, keys: list[str], spread: str,
    hot_rows: int = 1_000_000, how: str = "inner",
) -> DataFrame:
    """Join ``rows`` to ``table`` (unique on ``keys``), salting only hot keys.

    A key is hot with more than ``hot_rows`` rows and more than 1/10,000 of all rows, so
    at most 10,000 keys are, whatever the data: only these are broadcast. Their rows are
    spread by a hash of the column ``spread`` over salts of about a quarter of that
    threshold each, and their table entry is repeated once per salt. All other keys take
    salt 0 on both sides and shuffle exactly as in a plain join.
    """
    threshold = F.greatest(F.lit(max(1, hot_rows)), (row_count(rows) / MAX_HOT_KEYS).cast("bigint"))
    hot = (
        rows.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > threshold)
        .select(*keys, F.ceil(F.col("_n") * 4 / threshold).cast("int").alias("_salts"))
    )
    salts = F.coalesce(F.col("_salts"), F.lit(1))
    salted = (
        rows.join(F.broadcast(hot), keys, "left")
        .withColumn("_salt", F.pmod(F.xxhash64(spread), salts).cast("int"))
        .drop("_salts")
    )
    repeated = (
        table.join(F.broadcast(hot), keys, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
        .drop("_salts")
    )
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")
