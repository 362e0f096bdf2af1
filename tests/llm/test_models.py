"""Language model, neighbour search, licence scan and token counts against brute force."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from prefmill.llm import licences, lm, neighbours, token_counts
from prefmill.llm.queries import QUERIES, tokenizer

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string"
ODD = [(1, None), (2, ""), (None, "a b c"), (3, "a b c"), (3, "a b c"), (4, "  \n "), (5, "word " * 20_000), (6, "A B É é")]


# -- language model ----------------------------------------------------------------------


def tokens(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lowered), ""]


class PlainModel:
    """The same trigram model with dictionaries."""

    def __init__(self, texts, least=2):
        self.least = least
        self.one, pairs, triples = Counter(), Counter(), Counter()
        for text in texts:
            u = v = ""
            for w in tokens(text):
                self.one[w] += 1
                pairs[v, w] += 1
                triples[u, v, w] += 1
                u, v = v, w
        self.n, self.types = sum(self.one.values()), len(self.one)
        self.pairs, self.left2 = self.kept(pairs)
        self.triples, self.left3 = self.kept(triples)

    def kept(self, counts):
        weight, left = Counter(), defaultdict(lambda: 1.0)
        for gram, c in counts.items():
            weight[gram[:-1]] += c + 1
        kept = {g: c / weight[g[:-1]] for g, c in counts.items() if c >= self.least}
        for gram, p in kept.items():
            left[gram[:-1]] -= p
        return kept, left

    def p(self, u, v, w):
        single = (self.one[w] or self.types / (self.types + 1)) / (self.n + self.types)
        two = self.pairs.get((v, w), 0) + self.left2[(v,)] * single
        return self.triples.get((u, v, w), 0) + self.left3[u, v] * two

    def score(self, text):
        u = v = ""
        total = 0.0
        for w in tokens(text):
            total += math.log10(self.p(u, v, w))
            u, v = v, w
        return total


def check_scores(rows, texts, held):
    model = PlainModel([t for i, t in texts if not held(i)])
    total = Counter((i, t) for i, t in texts)
    assert len(rows) == sum(total.values())
    by_key = defaultdict(set)
    for i, t in texts:
        by_key[i].add(t or "")
    for r in rows:
        options = []
        for text in by_key[r["doc_id"]]:
            words = tokens(text)
            known = sum(model.one[w] > 0 for w in words)
            base = sum(math.log10((model.one[w] + 1) / (model.n + model.types + 1)) for w in words)
            options.append(
                (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words), known, model.n)
                and r["base_score"] == pytest.approx(base)
                and abs(r["score"] - model.score(text)) <= 2e-3 * len(words)
            )
        assert any(options), r
        assert r["held_out"] == held(r["doc_id"])


def fold(i):
    return zlib.crc32(str(i).encode() if i is not None else b"") % 7 == 2


def test_lm_scores_match_a_plain_model(spark):
    texts = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows = QUERIES["op9_elias_fano"](spark, SF).collect()
    check_scores(rows, texts, fold)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_lm_odd_rows_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK_TOKENS", 40)
    rng = random.Random(2)
    texts = ODD + [(10 + i, " ".join(rng.choices("abcdefgh", k=rng.randint(0, 30)))) for i in range(80)]
    frame = spark.createDataFrame(texts, DOCS)
    check_scores(lm.score_documents(frame).rows.collect(), texts, fold)
    assert lm.score_documents(frame.limit(0)).rows.collect() == []
    clash = frame.withColumns({"key": F.lit(1), "held": F.lit(2), "score": F.lit(3)})
    assert lm.score_documents(clash).rows.count() == len(texts)
    unlearned = lm.score_documents(frame, held=F.lit(True)).rows.collect()
    assert {(r["score"], r["base_score"], r["n_known"]) for r in unlearned} == {(0.0, 0.0, 0)}


def test_lm_splits_hot_words_alike_for_any_partitioning(spark, monkeypatch):
    monkeypatch.setattr(lm, "HOT_TOKENS", 50)
    rng = random.Random(3)
    texts = [(i, " ".join(rng.choices(["the", "the", "the", *"abcdefgh"], k=30))) for i in range(60)]
    frame = spark.createDataFrame(texts, DOCS)
    first = {r["doc_id"]: r["score"] for r in lm.score_documents(frame).rows.collect()}
    monkeypatch.setattr(lm, "CHUNK_TOKENS", 30)
    monkeypatch.setattr(lm, "SHARD_BYTES", 500)
    again = {r["doc_id"]: r["score"] for r in lm.score_documents(frame.repartition(5)).rows.collect()}
    assert again == pytest.approx(first)
    for least in (2, 1, 3):
        rows = lm.score_documents(frame, min_count=least).rows.collect()
        plain = PlainModel([t for i, t in texts if not fold(i)], least)
        for (i, t) in texts:  # split words change nothing
            score = next(r["score"] for r in rows if r["doc_id"] == i)
            assert abs(score - plain.score(t)) <= 2e-3 * len(tokens(t))


def test_lm_texts_over_a_closed_alphabet_add_up_to_one(spark, monkeypatch):
    """All texts of two words, known and as many unknown ones as are allowed for, and longer ones together."""
    monkeypatch.setattr(lm, "HOT_TOKENS", 5)
    learnt = ["a b", "a a b", "b", "a b b a", "", "a b"]
    known, types = ["a", "b"], 3  # and the end
    alphabet = [*known, *[f"x{i}" for i in range(types + 1)]]
    asked = ["", *alphabet, *[f"{u} {v}" for u in alphabet for v in alphabet]]
    rows = [(i, t) for i, t in enumerate(learnt)] + [(100 + i, t) for i, t in enumerate(asked)]
    frame = spark.createDataFrame(rows, DOCS)
    found = {r["doc_id"]: r["score"] for r in lm.score_documents(frame, held=F.col("doc_id") >= 100, min_count=1).rows.collect()}
    plain = PlainModel(learnt, 1)
    longer = sum(
        plain.p("", "", u) * plain.p("", u, v) * (1 - plain.p(u, v, "")) for u in alphabet for v in alphabet
    )
    assert sum(10 ** found[100 + i] for i in range(len(asked))) + longer == pytest.approx(1, abs=0.02)
    assert found[100 + asked.index("x0")] == pytest.approx(plain.score("x0"), abs=0.01)


def test_lm_probabilities_add_up_to_one():
    rng = random.Random(4)
    words = np.unique(np.array([rng.getrandbits(64) for _ in range(40)], dtype=np.uint64))
    n = 3000
    key_of, before, word = (np.array(rng.choices(range(len(words)), k=n)) for _ in range(3))
    short = words >> np.uint64(32)
    trie, _, _ = lm.build_trie(words, key_of, short[before], short[word], np.ones(n))
    for _ in range(20):
        k, b = rng.randrange(len(words)), rng.randrange(len(words))
        everything = np.full(len(words), k)
        a, rest = trie.ask(words, everything, short[np.full(len(words), b)], short)
        assert (a + rest / len(words)).sum() == pytest.approx(1, abs=1e-2)
        assert len(set(np.round(rest, 9))) == 1


@pytest.mark.parametrize("n, universe", [(0, 10), (1, 1 << 64), (1000, 1 << 64), (5000, 4000), (300, 1 << 20)])
def test_elias_fano_round_trip(n, universe, tmp_path):
    rng = random.Random(n)
    values = np.sort(np.array([rng.randrange(universe) for _ in range(n)], dtype=np.uint64))
    coded = lm.EliasFano.encode(values, universe)
    assert (coded.values() == values).all()
    if n:
        found = coded.find(values)
        assert (values[found] == values).all()
        assert coded.low.nbytes + coded.high.nbytes <= n * (math.log2(universe / n + 1) + 3) / 8 + 80
    missing = np.array([v for v in range(50) if v not in set(values.tolist())], dtype=np.uint64)
    assert (coded.find(missing) == -1).all()
    arrays = [values, np.zeros(0, np.uint16), np.array([1.5])]
    assert all((a == b).all() for a, b in zip(arrays, lm.unpack_arrays(lm.pack_arrays(*arrays))))


# -- neighbours --------------------------------------------------------------------------


def brute_neighbours(rows, queries, count=20):
    found = {}
    for q in queries:
        others = [(-sum(float(a) * float(b) for a, b in zip(rows[q], v)), i) for i, v in rows.items() if i != q]
        found[q] = [(i, -s) for s, i in sorted(others)[:count]]
    return found


def test_neighbours_recall_and_scores(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()}
    found = defaultdict(dict)
    for r in QUERIES["op6_nn_descent"](spark, sf).collect():
        found[r["query_id"]][r["rank"]] = (r["vec_id"], r["score"])
    wanted = brute_neighbours(rows, [i for i in rows if i % 20 == 0])
    hits = 0
    for q, best in wanted.items():
        assert sorted(found[q]) == list(range(1, 21))
        scores = [found[q][k][1] for k in range(1, 21)]
        assert scores == sorted(scores, reverse=True)
        hits += len({i for i, _ in best} & {i for i, _ in found[q].values()})
    assert hits >= 0.9 * 20 * len(wanted)


def test_descent_and_search_on_a_poor_start(spark):
    """Few small blocks: the rounds of descent and the search have to find the rest."""
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 16))
    points = (centres[rng.integers(0, 12, 900)] + 0.4 * rng.normal(size=(900, 16))).astype(np.float32)
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    frame = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id bigint, embedding array<float>")
    poor = neighbours.Settings(trees=2, block=64, per_block=8, neighbours=20, fan=12, rounds=3, beam=20)
    index = neighbours.build_index(frame, settings=poor)
    assert index.graph.count() == 900
    asked = spark.createDataFrame([(i,) for i in range(0, 900, 20)], "query_id bigint")
    found = defaultdict(set)
    for r in neighbours.nearest_members(index, asked, 10, poor).collect():
        found[r["query_id"]].add(r["vec_id"])
    sims = points @ points.T
    np.fill_diagonal(sims, -9)
    best = np.argsort(-sims, axis=1)[:, :10]
    recall = np.mean([len(found[i] & set(best[i].tolist())) / 10 for i in range(0, 900, 20)])
    first = neighbours.first_graph(index.packed, 900, poor)
    start = {r["id"]: set(r["nodes"][:10]) for r in first.collect()}
    blocks_only = np.mean([len(start[i] & set(best[i].tolist())) / 10 for i in range(0, 900, 20)])
    assert recall >= 0.9 > blocks_only
    entries = neighbours.entry_points(index)  # the clusters hang together little: some entry lies in each
    starts = index.packed.filter("id % 90 = 0").select(
        F.col("id").alias("q"), "half", F.array(*[F.lit(e).cast("bigint") for e in entries]).alias("start")
    )
    reached = neighbours.search_graph(index, starts, neighbours.Settings(beam=40, search_rounds=12)).collect()
    assert np.mean([len(set(r["nodes"][:11]) & set(best[r["q"]].tolist())) / 10 for r in reached]) >= 0.7


def test_neighbours_copies_and_unusable_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 0.0]) for i in range(60)] + [(100 + i, [0.5 + i / 100, 0.1]) for i in range(10)]
    rows += [(200, None), (201, []), (202, [0.0, 0.0]), (203, [1.0, None]), (204, [nan, 1.0]), (205, [inf, 1.0]), (206, [1.0]), (None, [1.0, 1.0])]
    rows += [(40, [1.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("id", F.lit("clash"))
    index = neighbours.build_index(frame)
    valid = {i: v for i, v in rows if i is not None and i < 200}
    asked = frame.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"))
    found = defaultdict(list)
    for r in neighbours.nearest_members(index, asked).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["vec_id"], round(r["score"], 6)))
    floats = {i: [float(np.float32(x)) for x in v] for i, v in valid.items()}
    wanted = brute_neighbours(floats, [i for i in valid if i % 20 == 0])
    assert dict(found) == {q: [(i, round(s, 6)) for i, s in best] for q, best in wanted.items()}
    assert neighbours.build_index(frame.limit(0)) is None


def test_few_vectors(spark):
    frame = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [-1.0, 0.0])], "vec_id bigint, embedding array<float>")
    index = neighbours.build_index(frame)
    asked = spark.createDataFrame([(0,)], "query_id bigint")
    rows = neighbours.nearest_members(index, asked).orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in rows] == [(1, 1, 4.0), (2, 2, -1.0)]
    alone = neighbours.build_index(frame.limit(1))
    assert neighbours.nearest_members(alone, asked).collect() == []


def recall_of(points, index, asked, settings=neighbours.Settings(), count=10):
    """Share of the nearest by all pairs that are found."""
    spark = index.packed.sparkSession
    queries = spark.createDataFrame([(int(i),) for i in asked], "query_id bigint")
    found = defaultdict(set)
    for r in neighbours.nearest_members(index, queries, count, settings).collect():
        found[r["query_id"]].add(r["vec_id"])
    sims = points[asked].astype(np.float64) @ points.T.astype(np.float64)
    sims[np.arange(len(asked)), asked] = -np.inf
    best = np.argsort(-sims, axis=1)[:, :count]
    return np.mean([len(found[i] & set(b.tolist())) / count for i, b in zip(asked.tolist(), best)])


def vector_frame(spark, points):
    return spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id bigint, embedding array<float>")


def test_one_very_large_vector_spoils_no_other(spark):
    rng = np.random.default_rng(1)
    points = rng.normal(size=(6000, 8)).astype(np.float32)
    points[77, 3] = 1e30
    index = neighbours.build_index(vector_frame(spark, points))
    assert recall_of(points, index, np.arange(0, 6000, 40)) >= 0.9


def test_descent_goes_on_until_links_settle(spark):
    """Blocks cover half a percent of the pairs, as in a table of millions of vectors."""
    rng = np.random.default_rng(2)
    points = rng.normal(size=(8000, 12)).astype(np.float32)
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    sparse = replace(neighbours.Settings(), trees=2, block=16, per_block=4, fan=8, neighbours=20)
    index = neighbours.build_index(vector_frame(spark, points), settings=sparse)
    changed = index.graph.select(F.explode("fresh").alias("x")).agg(F.avg(F.col("x").cast("int"))).first()[0]
    assert changed <= 0.001
    assert recall_of(points, index, np.arange(0, 8000, 40), sparse) >= 0.9


def test_crowded_blocks_are_cut_by_planes_of_their_own(spark):
    """A third of all vectors lie in one tight cluster."""
    rng = np.random.default_rng(3)
    points = rng.normal(size=(9000, 12))
    points[:3000] = rng.normal(size=12) + 0.01 * points[:3000]
    points = (points / np.linalg.norm(points, axis=1, keepdims=True)).astype(np.float32)
    frame = vector_frame(spark, points)
    blocks = replace(neighbours.Settings(), trees=6, block=64, rounds=0)
    index = neighbours.build_index(frame, settings=blocks)
    graph = {r["id"]: set(r["nodes"]) for r in index.graph.collect()}
    assert len(graph) == 9000
    sims = points[:3000:30].astype(np.float64) @ points[:3000].T.astype(np.float64)
    sims[np.arange(100), np.arange(0, 3000, 30)] = -9
    best = np.argsort(-sims, axis=1)[:, :10]
    assert np.mean([len(graph[30 * i] & set(b.tolist())) / 10 for i, b in enumerate(best)]) >= 0.5


def test_crowded_block_of_vectors_alike_in_single_precision(spark):
    points = np.ones((1000, 2)) + np.arange(1000)[:, None] * [1e-9, 0]
    frame = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id bigint, embedding array<double>")
    index = neighbours.build_index(frame, settings=replace(neighbours.Settings(), trees=2, block=64, rounds=1))
    assert index.graph.filter(F.size("nodes") > 0).count() == 1000


# -- licences ----------------------------------------------------------------------------

LINES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "Proprietary": "All rights reserved.",
}


def test_licence_families_on_the_documents(spark):
    rows = {r["doc_id"]: r for r in QUERIES["op7_licence_scan"](spark, "/root/testdata/sf0.01").collect()}
    texts = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(texts)
    for doc_id, text in texts:
        paragraphs = [p for p in text.split("\n") if p.strip()]
        families = {f for f, line in LINES.items() if line in text}
        r = rows[doc_id]
        assert r["n_paragraphs"] == len(paragraphs)
        assert r["families"] == ",".join(sorted(families))
        assert r["n_hits"] == sum(any(x in p for x in LINES.values()) for p in paragraphs)


@pytest.fixture(scope="module")
def scanner():
    rng = random.Random(0)
    common = "the of and to in is work under version free you may this any use license public general".split()
    plain = [" ".join(rng.choices(common + ["".join(rng.choices("abcdef", k=5)) for _ in range(40)], k=40)) for _ in range(400)]
    return licences.Scanner(licences.train(plain))


@pytest.mark.parametrize("family", list(licences.TEMPLATES))
def test_licence_templates_and_variants(scanner, family):
    for notice in licences.TEMPLATES[family]:
        for text in (notice, notice.upper(), "Note well: " + notice + " See also the file."):
            hit = scanner.paragraph(text)
            assert hit and licences.FAMILIES[hit[0]] == family and hit[1] > 0.4 and hit[2] >= 0.8


def test_ordinary_text_is_unknown(scanner):
    for text in (
        "", "You may use this work.", "The public may redistribute any version of the source.", "All rights.",
        "license license license", "The general version of the MIT course is free.", "version 2.0 of the program",
    ):
        assert scanner.paragraph(text) is None


def test_licence_odd_rows(spark):
    rows = [*ODD, (7, "\n\nx\n" + LINES["MIT"] + "\n" + LINES["MIT"]), (8, "word " * 9000 + LINES["MIT"] + " word" * 9000)]
    frame = spark.createDataFrame(rows, DOCS).withColumns({"hits": F.lit("mine"), "_key": F.lit(1)})
    found = licences.scan_licences(frame).collect()
    assert len(found) == len(rows)
    by_key = {r["doc_id"]: r for r in found}
    assert [(h["paragraph"], h["family"]) for h in by_key[7]["hits"]] == [(1, "MIT"), (2, "MIT")]
    assert [h["family"] for h in by_key[8]["hits"]] == ["MIT"] and by_key[1]["n_paragraphs"] == 0
    assert licences.scan_licences(frame.limit(0)).collect() == []


@pytest.mark.parametrize("family, notice", [
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the"),
    ("BSD", "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\n"
     "the Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."),
])
def test_wrapped_notices(scanner, family, notice):
    count, hits = scanner.scan("A file.\n\n" + notice + "\n\nMore.")
    lines = notice.count("\n") + 1
    assert count == lines + 2
    assert [(h[0], licences.FAMILIES[h[1]]) for h in hits] == [(1, family)] and 1 < hits[0][4] <= lines


def test_several_notices_in_a_line(scanner):
    both = "Released under the MIT License. Licensed under the Apache License, Version 2.0."
    assert [licences.FAMILIES[h[1]] for h in scanner.scan(both)[1]] == ["MIT", "Apache-2.0"]
    rng = random.Random(5)
    prose = " ".join(rng.choices("the of this work is under version free you may use license public general".split(), k=4000))
    found = scanner.scan(f"{prose} {LINES['GPL-3.0']} {prose} {both} {prose}")[1]
    assert [licences.FAMILIES[h[1]] for h in found] == ["GPL-3.0", "MIT", "Apache-2.0"]


# -- token counts ------------------------------------------------------------------------


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    coder.encode_special_tokens = True
    return coder


@pytest.fixture(scope="module")
def coder():
    import public_tokenizers

    with open(tokenizer("byte_bpe_50k.tiktoken"), "rb") as file:
        return token_counts.SpanCoder(file.read(), public_tokenizers.PATTERN)


TEXTS = [
    "", "\n", "\n\n\n", "one line", "a\n\nb\n", "tab\tand  spaces \n  indented", "日本\U0001f600é\n", "<|endoftext|>\nx",
    "x" * 3000 + "\n" + " " * 50 + "\n\n\n y", "ﬁ①\r\nｱ z",
]


def test_spans_match_another_tokenizer(coder, reference):
    for text in TEXTS:
        coded = reference.encode(text, add_special_tokens=False)
        begins, ends = coder.spans(text)
        assert len(begins) == len(coded.ids)
        assert list(zip(begins.tolist(), ends.tolist())) == [
            (a, b) for a, b in coded.offsets
        ]


def brute_allocate(spans, starts, length):
    bounds = [*starts, length]
    counts, crossing = [0] * len(starts), [0] * len(starts)
    for a, b in spans:
        shares = [max(0, min(b, e) - max(a, s)) for s, e in zip(bounds, bounds[1:])]
        best = shares.index(max(shares))
        counts[best] += 1
        crossing[best] += sum(x > 0 for x in shares) > 1
    return counts, crossing


def test_line_counts_match_brute_force(spark, reference):
    import public_tokenizers

    rows = list(enumerate(TEXTS)) + [(None, "a\n\n\nb"), (99, None), (98, "word\n" * 5000)]
    frame = spark.createDataFrame(rows, DOCS).withColumns({"line": F.lit("mine"), "_text": F.lit(1)})
    found = defaultdict(list)
    paths = (tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    for r in token_counts.count_lines(frame, *paths).orderBy("line").collect():
        found[r["doc_id"]].append((r["n_chars"], r["n_tokens"], r["n_crossing"]))
    assert set(found) == {i for i, _ in rows}
    for i, text in rows:
        lines = (text or "").splitlines(keepends=True) if "\n" not in (text or "") else re.findall(r"[^\n]*\n|[^\n]+", text)
        lines = [text or ""] if "\n" not in (text or "") else lines
        starts = np.cumsum([0, *map(len, lines)])[:-1].tolist()
        spans = reference.encode(text or "", add_special_tokens=False).offsets
        counts, crossing = brute_allocate(spans, starts, len(text or ""))
        assert found[i] == list(zip(map(len, lines), counts, crossing))
    assert token_counts.count_lines(frame.limit(0), *paths).collect() == []


def test_field_counts(spark, reference):
    import public_tokenizers

    frame = spark.createDataFrame([(1, "a title", "body\n\ntext"), (2, None, "x"), (3, "", None)], "id int, title string, body string")
    paths = (tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rows = token_counts.count_fields(frame, ["title", "body", "id"], *paths, key="id", joint="\n").collect()
    assert [(r["id"], r["field"]) for r in rows] == [(i, f) for i in (1, 2, 3) for f in ("title", "body", "id")]
    for i, title, body in ((1, "a title", "body\n\ntext"), (2, "", "x"), (3, "", "")):
        whole = f"{title}\n{body}\n{i}"
        own = [r for r in rows if r["id"] == i]
        spans = reference.encode(whole, add_special_tokens=False).offsets
        counts, crossing = brute_allocate(spans, [0, len(title) + 1, len(title) + len(body) + 2], len(whole))
        assert [r["n_tokens"] for r in own] == counts and [r["n_crossing"] for r in own] == crossing


def test_token_totals_of_the_documents(spark, reference):
    texts = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    total, chars = Counter(), Counter()
    for r in QUERIES["op10_line_tokens"](spark, SF).collect():
        total[r["doc_id"]] += r["n_tokens"]
        chars[r["doc_id"]] += r["n_chars"]
    for doc_id, text in texts.items():
        assert total[doc_id] == len(reference.encode(text, add_special_tokens=False).ids)
        assert chars[doc_id] == len(text)


def test_very_long_runs_of_blanks_are_counted(spark):
    import public_tokenizers

    texts = [(1, "x" + " " * 1_000_000 + "y"), (2, "a\n" + "\t" * 200_000 + "\nb")]
    frame = spark.createDataFrame(texts, DOCS)
    rows = token_counts.count_lines(frame, tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    for i, text in texts:
        assert sum(r["n_chars"] for r in rows if r["doc_id"] == i) == len(text)
        assert all(r["n_tokens"] > 0 for r in rows if r["doc_id"] == i)
