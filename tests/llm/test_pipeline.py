"""The pipeline's stages, one by one on odd rows and in a row against plain Python."""

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from prefmill.llm import quality
from prefmill.llm.queries import tokenizer
from prefmill.llm.simhash import components_brute, fingerprint

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ODD = [
    (3, "a  b\n", None, "x", 1), (1, "a b ", None, "x", 1), (None, "a b ", "en", None, 1),
    (2, None, "en", "y", None), (2, None, "en", "y", None), (4, "", None, None, 0),
    (6, "word " * 30_000, "en", "x", 1), (9, "a b c d", "en", "x", 7), (9, "a b c d", "en", "x", 7),
]


def test_stage_list():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "mix", "encode"]


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_odd_rows(spark, name, stage):
    frame = spark.createDataFrame(ODD, DOCS).withColumns(
        {"copies": F.lit("mine"), "fp": F.lit(0.5), "_size": F.lit(1), "ids": F.lit("i"), "row_id": F.lit(2)}
    )
    found = stage(spark, frame, SF)
    rows = found.collect()
    assert 0 < len(rows) <= 3 * len(ODD)
    if name != "encode":
        assert found.columns == frame.columns
        assert {r["copies"] for r in rows} == {"mine"} and {r["row_id"] for r in rows} == {2}
    empty = spark.createDataFrame([], DOCS)
    assert stage(spark, empty, SF).collect() == []


def test_run_matches_plain_python(spark):
    import sentencepiece

    sf = "/root/testdata/sf0.01"  # the smallest tables have too few labels for a classifier
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = docs.select("doc_id", "text", "source", quality.score(model).alias("s")).orderBy("doc_id").collect()
    good = [r for r in rows if r["s"] >= quality.THRESHOLD]
    assert 0 < len(good) < len(rows)
    first = {}
    for r in good:
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r["text"]), r)
    unique = list(first.values())
    roots = components_brute([fingerprint(r["text"]) for r in unique])
    alone = [r for i, r in enumerate(unique) if roots[i] == i]
    copies = plain_mix(alone)
    coder = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    wanted = Counter()
    for r in alone:
        ids = coder.encode(r["text"])
        sha = hashlib.sha256(coder.decode(ids).encode()).hexdigest()
        wanted[(r["doc_id"], tuple(ids), sha)] += copies[r["doc_id"]]
    found = Counter(
        (r["doc_id"], tuple(r["ids"]), r["decoded_sha256"]) for r in corpus_pipeline.run(spark, sf).collect()
    )
    assert found == +wanted


def plain_mix(rows):
    """How often the mix takes each document: targets by repeated sharing, hashes sorted."""
    words = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in rows}
    sources = sorted({r["source"] for r in rows})
    size = {s: sum(words[r["doc_id"]] for r in rows if r["source"] == s) for s in sources}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    capped, total = set(), sum(size.values())
    while True:
        free = [s for s in sources if s not in capped]
        rest = total - sum(3 * size[s] for s in capped)
        share = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        above = {s for s in free if share[s] > 3 * size[s]}
        if not above:
            break
        capped |= above
    copies = {}
    for s in sources:
        target = share.get(s, 3 * size[s])
        passes = int(target // size[s])
        rest, used = target - passes * size[s], 0
        own = [r["doc_id"] for r in rows if r["source"] == s]
        for d in sorted(own, key=lambda d: hashlib.md5(f"42:k{d}".encode()).hexdigest()[:15]):
            fits = used + words[d] <= rest or used <= rest and used + words[d] - rest < rest - used
            copies[d] = passes + (rest > 0 and fits)
            used += words[d] if fits else float("inf")
    return copies


