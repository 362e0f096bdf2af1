"""Registered queries of the operators: each applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prefmill.functions.derive import settle
from prefmill.llm import (
    alignment, dedup, disclosure, licences, lm, mixing, neighbours, pieces, quality, runs, sharding, simhash,
    token_counts,
)
from prefmill.llm.common import WORD, crc_fold, table, text_of
from prefmill.session import materialise


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = materialise(docs.select("doc_id", *mixing.mix_columns()), "mix-rows")
    mixed = mixing.apply_mix(rows, mixing.plan_mix(rows))
    return mixed.select(
        "doc_id",
        F.col(mixing.SIZE).alias("size"),
        "source_size",
        "target",
        (F.col(mixing.SIZE) * F.col("copies")).alias("taken"),
    )


def tokenizer(name: str) -> str:
    """Path of a public tokenizer's file on the driver."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = pieces.encode_texts(
        table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"), keep=["doc_id"], spans=False
    )
    return encoded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.col("covered").alias("covered_bytes"),
    )


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = docs.select(
        "doc_id",
        (crc_fold("doc_id", quality.FOLDS) == 0).alias("held_out"),
        quality.score(model).alias("score"),
    )
    return scored.withColumn("predicted", (F.col("score") >= quality.THRESHOLD).cast("int"))


def op4_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialise(sharding.shard_rows(table(spark, sf_dir, "documents")), "ring-rows")
    return sharding.ring_shards(rows).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op5_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_of("fp").alias("fingerprint"), "component_id")


def op6_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    index = neighbours.build_index(vectors)
    if index is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    asked = vectors.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"))
    return neighbours.nearest_members(index, asked)


def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan_licences(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_paragraphs",
        F.size("hits").alias("n_hits"),
        F.concat_ws(",", F.array_sort(F.array_distinct("hits.family"))).alias("families"),
        F.array_min("hits.probability").alias("lowest_probability"),
    )


def op8_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_groups(table(spark, sf_dir, "documents"))


def op9_elias_fano(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents")).rows


def op10_line_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count_lines(
        table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    files = alignment.Tokenizers.read(
        tokenizer("byte_bpe_50k.json"), public_tokenizers.PATTERN, tokenizer("piece_bpe_32k.model")
    )
    found = alignment.align_documents(docs, alignment.count_pairs(docs, files), keep=["doc_id"], written=True)
    return found.select(
        "doc_id",
        F.col("n_left").alias("n_a"),
        F.col("n_right").alias("n_b"),
        "n_groups",
        "n_links",
        "n_best",
        "count_sum",
        F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256"),
    )


def op12_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = disclosure.sanitise(docs, disclosure.fit(docs), keep=["doc_id"], rewritten=False)

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *map(number, disclosure.KINDS),
        F.sha2(joined(F.filter("spans", lambda s: s["kind"] != disclosure.TERM)), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def with_periods(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``; in a tenth of the texts the words from some place on repeat a few of them."""
    hashed = docs.select(
        "doc_id", "text", F.crc32(text_of(F.col("doc_id").cast("string"))).alias("h"), F.floor(F.col("h") / 10).alias("g")
    )
    words = F.when(F.col("h") % 10 == 0, F.regexp_extract_all(text_of("text"), F.lit(WORD), F.lit(0)))
    chosen = settle(hashed, {"words": words})
    placed = settle(chosen, {"a": F.expr("CASE WHEN size(words) > 0 THEN g % size(words) END")})
    sized = settle(placed, {"p": F.expr("1 + (size(words) - a) div (3 + g % 8)")})
    changed = F.array_join(
        F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(
            F.get("words", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))
        )),
        " ",
    )
    return sized.select("doc_id", F.when(F.col("p").isNull(), F.col("text")).otherwise(changed).alias("text"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find_runs(with_periods(table(spark, sf_dir, "documents")), keep=["doc_id"])
    longest = F.get(F.array_sort(F.transform(
        "runs", lambda r: F.struct(-r["length"], r["start"].alias("start"), r["period"].alias("period"))
    )), 0)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = settle(found.select("*", longest.alias("best")), {"length": -F.col("best.col1")})
    return best.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        "best.start",
        "length",
        "best.period",
        F.expr("1000 * length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_pieces": op2_pieces,
    "op3_quality": op3_quality,
    "op4_ring_shards": op4_ring_shards,
    "op5_pigeonhole": op5_pigeonhole,
    "op6_nn_descent": op6_nn_descent,
    "op7_licence_scan": op7_licence_scan,
    "op8_content_sort": op8_content_sort,
    "op9_elias_fano": op9_elias_fano,
    "op10_line_tokens": op10_line_tokens,
    "op11_alignment": op11_alignment,
    "op12_disclosure": op12_disclosure,
    "op13_runs": op13_runs,
}
