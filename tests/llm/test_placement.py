"""Ring placement against a plain walk, and the compression classifier against plain code."""

import bisect
import math
import random
import time

import duckdb
import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from prefmill.llm import quality, sharding

SF = "/root/testdata/sf0.001"


def plain_walk(loads, shards, slack, virtual_nodes, bits):
    nodes = sharding.ring(shards, virtual_nodes)
    capacity = sum(load for _, _, load in loads) * (1 + slack) / shards
    filled, placed = [0] * shards, {}
    for cell, part, load in sorted(loads, key=lambda x: (-x[2], x[0], x[1])):
        start = bisect.bisect_left(nodes, (cell << (64 - bits), -1))
        order = list(dict.fromkeys(nodes[(start + i) % len(nodes)][1] for i in range(len(nodes))))
        shard = next((s for s in order if filled[s] + load <= capacity), None)
        if shard is None:
            shard = min(order, key=filled.__getitem__)
        filled[shard] += load
        placed[cell, part] = shard
    return [placed[cell, part] for cell, part, _ in loads]


@pytest.mark.parametrize("shards, slack", [(1, 0.005), (3, 0.0), (8, 0.005), (8, 0.3), (40, 0.02)])
def test_placement_equals_the_plain_walk(shards, slack):
    rng = random.Random(shards)
    for sizes in ([rng.randint(1, 9) for _ in range(400)], [int(rng.paretovariate(0.8)) for _ in range(300)], [5] * 64, [7]):
        loads = [(rng.randrange(1 << 16), i, size) for i, size in enumerate(sizes)]
        assert sharding.place_cells(loads, shards, slack, 16) == plain_walk(loads, shards, slack, 16, 16)


def test_a_thousand_shards_are_placed_in_seconds_and_balanced():
    shards, rng = 1024, np.random.default_rng(1)
    bits = sharding.cell_bits(shards)
    assert bits == 20
    # Just below the cut: the heaviest cells that stay whole.
    sizes = rng.integers(900, 1100, 1 << bits).astype(int).tolist()
    limit = sum(sizes) // (sharding.HEAVY_PER_SHARD * shards)
    for i in range(0, 1 << bits, 5000):
        sizes[i] = limit - 1
    loads = [(i, 0, size) for i, size in enumerate(sizes)]
    started = time.time()
    placed = sharding.place_cells(loads, shards, bits=bits)
    assert time.time() - started < 90
    filled = np.bincount(placed, weights=sizes, minlength=shards)
    assert filled.max() <= filled.mean() * (1 + sharding.SLACK) + 1


def test_ring_with_many_shards_and_clashing_columns(spark):
    rows = [(i, "copy " * 40) for i in range(3000)] + [(i, f"text {i} " * 5) for i in range(3000, 12_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    frame = sharding.shard_rows(df).withColumns({c: F.lit("x") for c in ("_cell", "_part", "_parts", "_rank", "_offset", "shard", "slot")})
    found = sharding.ring_shards(frame.cache(), shards=60)
    assert sorted(found.columns) == sorted([*sharding.shard_rows(df).columns, "shard", "slot"])
    loads = {r["shard"]: (r["load"], r["n"], r["low"], r["high"]) for r in found.groupBy("shard").agg(
        F.sum("size").alias("load"), F.count("*").alias("n"), F.min("slot").alias("low"), F.max("slot").alias("high")).collect()}
    assert len(loads) == 60 and all((low, high) == (0, n - 1) for _, n, low, high in loads.values())
    sizes = [load for load, *_ in loads.values()]
    assert max(sizes) <= sum(sizes) / 60 * (1 + sharding.SLACK) + 300  # and one row
    assert found.select("doc_id").distinct().count() == len(rows)


def test_null_keys_and_ties_share_the_ring(spark):
    df = spark.createDataFrame([(None, "a b")] * 500 + [(7, "a b")] * 500 + [(None, None), (8, "x " * 200_000)], "doc_id bigint, text string")
    rows = sharding.ring_shards(sharding.shard_rows(df).cache(), shards=4).collect()
    assert len(rows) == 1002
    for shard in range(4):
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots)))


# -- quality -----------------------------------------------------------------------------


def plain_scores(model, texts):
    kind = zstandard.DICT_TYPE_FULLDICT if model.trained else zstandard.DICT_TYPE_RAWCONTENT
    scores = []
    for text in texts:
        data = (text or "").encode()
        sizes = []
        for book in (model.good, model.bad):
            coder = zstandard.ZstdCompressor(
                level=3, dict_data=zstandard.ZstdCompressionDict(book, dict_type=kind), write_content_size=False
            )
            sizes.append(sum(len(coder.compress(data[i : i + 256])) for i in range(0, len(data), 256)))
        x = (sizes[1] - sizes[0]) / sum(sizes) if sum(sizes) else 0.0
        scores.append(1 / (1 + math.exp(-(model.slope * x + model.offset))))
    return scores


def test_few_labels_still_compare_texts(spark):
    """The smallest tables have 87 labels, too few to train dictionaries on."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    rows = docs.select("text", quality.score(model).alias("s")).collect()
    assert len({r["s"] for r in rows}) > len({r["text"] for r in rows}) * 0.9
    assert [r["s"] for r in rows] == pytest.approx(plain_scores(model, [r["text"] for r in rows]))
    known = duckdb.sql(f"SELECT quality, text FROM '{SF}/labels.parquet' JOIN '{SF}/documents.parquet' USING (doc_id)").fetchall()
    scores = plain_scores(model, [t for _, t in known])
    good, bad = ([s for s, (q, _) in zip(scores, known) if q == value] for value in (1, 0))
    assert sum(a > b for a in good for b in bad) > 0.7 * len(good) * len(bad)


def test_the_curve_is_the_best_one(spark):
    """Slope and offset against the gradient of the weighted likelihood, worked out from plain compression."""
    texts = {
        1: [f"a clean sentence about topic {i} with words in order and number {i * 7}" * 3 for i in range(60)],
        0: [f"$$ buy {i} now!!! click {i * 3} win win $$$ free {i}" * 4 for i in range(60)],
    }
    counts = {1: 300, 0: 100}
    model = quality.train(texts, counts)
    held = [(t, v) for v in (0, 1) for t in texts[v][::3]]
    x = np.array([math.log(s / (1 - s)) for s in plain_scores(model, [t for t, _ in held])])
    x = (x - model.offset) / model.slope
    y = np.array([v for _, v in held], dtype=float)
    share = {1: 301 / 402, 0: 101 / 402}
    weight = np.array([share[int(v)] / 20 for v in y]) * len(y)
    scale = np.abs(x).max()

    def loss(slope, offset):
        z = slope * x + offset
        return (weight * (np.log1p(np.exp(-np.abs(z))) + np.maximum(z, 0) - y * z)).sum() + 0.5e-2 * (slope * scale) ** 2 + 0.5e-6 * offset**2

    best = loss(model.slope, model.offset)
    for a, b in ((1.05, 0), (0.95, 0), (1, 0.05), (1, -0.05), (1.02, 0.02), (0.98, -0.02)):
        assert loss(model.slope * a, model.offset + b) > best


def test_raw_dictionaries_have_one_size():
    good, bad = quality.raw_books([[b"abc" * 100], [b"xyz" * 40, b"w" * 10]])
    assert len(good) == len(bad) == 130 and quality.trained_books([[b"abc"], [b"xyz"]]) is None
    one = quality.train({0: ["only one bad text"], 1: ["only one good text", "another good text"]}, {0: 1, 1: 2})
    assert one.good and not one.trained
