"""A training-data pipeline of five stages over ``documents``.

Quality, exact copies, near copies, source mix, tokens. Each stage works on all rows that its
predecessor kept and returns the columns of documents; the last returns token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefmill.llm import dedup, mixing, pieces, quality, simhash
from prefmill.llm.common import pack, table, unpack
from prefmill.llm.queries import tokenizer
from prefmill.session import materialise


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the classifier scores below its threshold."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return docs.filter(quality.score(model) >= quality.THRESHOLD)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest id of each group of equal texts."""
    return dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest id of each group linked by SimHash fingerprints."""
    return simhash.keep_representatives(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that sources come to their target weights.

    A document appears as often as the mix takes it: up to three times, or not at all. One
    without words adds nothing to any target and keeps what its source's passes give it.
    """
    columns, used = docs.columns, ["doc_id", "source", "text"]
    rows = materialise(docs.select(*mixing.mix_columns()), "mix-rows")
    packed = pack(docs, used).select("*", *mixing.mix_columns()[:2])
    mixed = mixing.apply_mix(packed, mixing.plan_mix(rows)).filter("copies > 0")
    repeated = mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")))
    return unpack(repeated, columns, used)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and a checksum of what they decode to."""
    encoded = pieces.encode_texts(
        docs, tokenizer("piece_bpe_32k.model"), keep=["doc_id", "lang", "source"], spans=False
    )
    return encoded.select(
        "doc_id",
        "lang",
        "source",
        F.size("ids").cast("bigint").alias("n_tokens"),
        "ids",
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality", keep_good),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mix", mix_sources),
    ("encode", encode),
]

#: SQL cannot express the classifier, the SimHash or the tokenizer; the tests hold the stages
#: against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
