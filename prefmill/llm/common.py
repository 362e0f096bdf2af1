"""Helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a longest run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()

OTHERS = "_others"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str | Column) -> Column:
    """A text, null counting as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def word_count(column: str | Column) -> Column:
    return F.coalesce(F.regexp_count(column, F.lit(WORD)).cast("bigint"), F.lit(0).cast("bigint"))


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Fewer rows in an Arrow batch for what is run inside: rows hold whole texts."""
    before = spark.conf.get(BATCH_ROWS)
    spark.conf.set(BATCH_ROWS, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, before)


def crc_fold(key: str, folds: int) -> Column:
    """crc32 of the key's decimal text, modulo ``folds``; a null key counts as empty text."""
    return F.pmod(F.crc32(text_of(F.col(key).cast("string"))), F.lit(folds)).cast("int")


def first_by_hash(df: DataFrame, hash_of: Column, rows: int, total: int) -> DataFrame:
    """The ``rows`` rows of smallest hash, ties by all columns, out of about ``total``.

    A share of the hash range that should hold three times as many is cut out first, so that tasks
    hand on a few rows each, however many tasks there are. Fewer may come back where hashes clump.
    """
    bound = int((1 << 62) * min(1.0, 3 * rows / max(1, total)))
    hashed = df.withColumn("_h", F.shiftrightunsigned(hash_of, 2))
    return hashed.filter(F.col("_h") <= bound).orderBy("_h", *map(quoted, df.columns)).limit(rows).drop("_h")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def pack(df: DataFrame, used: list[str]) -> DataFrame:
    """The columns ``used`` and all others in one struct, so that no name can clash."""
    others = [c for c in df.columns if c not in used]
    fields = [F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(others)]
    return df.select(*used, F.struct(*fields or [F.lit(0).alias("c")]).alias(OTHERS))


def unpack(df: DataFrame, columns: list[str], used: list[str]) -> DataFrame:
    """Undo ``pack`` for a frame that had ``columns``; any further column goes."""
    others = [c for c in columns if c not in used]
    return df.select(
        *[
            F.col(c) if c in used else F.col(f"{OTHERS}.c{others.index(c)}").alias(c)
            for c in columns
        ]
    )
