"""SimHash near-duplicates by the generalised pigeonhole principle.

The 64 fingerprint bits are grouped into partitions, correlated bits together. If two
fingerprints differ in at most D bits and the partitions' thresholds add up to D - m + 1,
some partition differs in no more than its own threshold. Thresholds may be unequal, and -1 leaves a partition
out: a dynamic program picks them to minimise the estimated number of probes and candidates. Each
fingerprint is filed under its value in every partition in use and probes all values
within the threshold; candidates are verified by their bit distance.

A bucket of many fingerprints would give the square of its size in candidates. Where that is more than the
expansion below costs, its members are linked through shared centres instead: two
fingerprints are within two bits exactly if some value is within one bit of both. Each member is listed under the 65
values within one bit of it; no centre can have more than 65 members. That is exact and
linear, so no bucket is capped and no group of copies is expanded into pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

import prefmill.shipping  # noqa: F401
from prefmill.llm.common import small_batches, text_of
from prefmill.operators.lookup import skew_safe_join
from prefmill.session import materialise, with_stable_row_id

BITS = 64
SEED = 42
SHINGLE = 3
DISTANCE = 2
CHUNK = 1 << 14


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text; 0 without words.

    Words are runs without ASCII white space, A-Z lower-cased; shingles are joined by one
    space and count as often as they occur. A text of fewer words is one shingle.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    last = ends[shingle - 1 :].tolist() or [len(joined)]
    digest = xxhash.xxh64_intdigest
    set_in = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(last), CHUNK):
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[at:], last[at : at + CHUNK])]
        octets = np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8)
        set_in += np.unpackbits(octets, axis=1).sum(axis=0, dtype=np.int64)
    bits = set_in * 2 > len(last)
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def fingerprint_column(text: str | Column = "text", shingle: int = SHINGLE) -> Column:
    """The fingerprint as a long with the same 64 bits."""

    def column(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            prints = (fingerprint(t.as_py(), shingle) for t in batch)
            yield pa.array(np.fromiter(prints, np.uint64, len(batch)).view(np.int64))

    column.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(column, returnType="bigint")(text_of(text))


def hex_of(print_column: str) -> Column:
    return F.lower(F.lpad(F.hex(print_column), 16, "0"))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


@dataclass(frozen=True)
class Partition:
    bits: tuple[int, ...]
    threshold: int

    @property
    def mask(self) -> int:
        return sum(1 << b for b in self.bits)

    def flips(self) -> list[int]:
        """All changes of at most ``threshold`` of the partition's bits, no change first."""
        found = [0]
        if self.threshold >= 1:
            found += [1 << b for b in self.bits]
        if self.threshold >= 2:
            found += [1 << b | 1 << c for i, b in enumerate(self.bits) for c in self.bits[:i]]
        return found


def bit_statistics(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many have bits b and c set, for all b and c."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            octets = batch.column(0).to_numpy().astype(">i8").view(np.uint8).reshape(-1, 8)
            matrix = np.unpackbits(octets, axis=1)[:, ::-1].astype(np.float32)
            total += matrix.T @ matrix
            n += batch.num_rows
        yield pa.RecordBatch.from_pydict({"n": [n], "pairs": [total.ravel()]})

    parts = prints.select("fp").mapInArrow(count, "n bigint, pairs array<double>")
    sums = (
        parts.select("n", F.posexplode("pairs"))
        .groupBy("pos")
        .agg(F.sum("col").alias("pairs"), F.sum("n").alias("n"))
        .collect()
    )
    matrix = np.zeros(BITS * BITS)
    for row in sums:
        matrix[row["pos"]] = row["pairs"]
    return (int(sums[0]["n"]) if sums else 0), matrix.reshape(BITS, BITS)


def group_bits(n: int, pairs: np.ndarray, parts: int) -> list[tuple[int, ...]]:
    """Partitions of nearly equal width, each grown around the most correlated free bit."""
    share = np.diag(pairs) / max(n, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-9))
    related = np.abs(pairs / max(n, 1) - np.outer(share, share)) / np.outer(spread, spread)
    np.fill_diagonal(related, 0)
    free, groups = set(range(BITS)), []
    for part in range(parts):
        width = (BITS - sum(map(len, groups))) // (parts - part)
        rest = sorted(free)
        group = [max(rest, key=lambda b: (related[b, rest].sum(), -b))]
        while len(group) < width:
            rest = sorted(free - set(group))
            group.append(max(rest, key=lambda b: (related[b, group].sum(), -b)))
        free -= set(group)
        groups.append(tuple(sorted(group)))
    return groups


def allocate(costs: list[dict[int, float]], distance: int = DISTANCE) -> tuple[float, tuple[int, ...]]:
    """Cheapest thresholds, one a partition, that add up to ``distance - m + 1``.

    ``costs[i][t]`` is what threshold ``t`` costs in partition ``i``; -1 costs nothing.
    """
    best: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
    for cost in costs:
        step: dict[int, tuple[float, tuple[int, ...]]] = {}
        for used, (spent, chosen) in best.items():
            for t in range(-1, distance + 1):
                option = (spent + cost[t], (*chosen, t))
                if used + t not in step or option < step[used + t]:
                    step[used + t] = option
        best = step
    return best[distance - len(costs) + 1]


def choose_partitions(prints: DataFrame, distance: int = DISTANCE) -> list[Partition]:
    """Partitions and thresholds for all ``prints`` (distinct ``fp``).

    Equal values in a partition are counted exactly, over all fingerprints; values a few bits
    apart are estimated from those and from how often each bit agrees.
    """
    n, pairs = bit_statistics(prints)
    layouts = {m: group_bits(n, pairs, m) for m in range(1, distance + 3)}
    masks = [
        (m, i, _signed(Partition(bits, 0).mask))
        for m, groups in layouts.items() for i, bits in enumerate(groups) if m > 1
    ]
    values = prints.select(
        "fp",
        F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.lit(i).alias("i"), F.lit(x).cast("bigint").alias("mask")) for m, i, x in masks])).alias("p"),
    ).groupBy("p.m", "p.i", F.col("fp").bitwiseAND(F.col("p.mask")).alias("value"))
    size = F.col("size").cast("double")
    met = (
        values.agg(F.count(F.lit(1)).alias("size"))
        .groupBy("m", "i")
        .agg(F.sum(F.least(size * (size - 1) / 2, size * (BITS + 1))).alias("candidates"))
    )
    equal = {(r["m"], r["i"]): r["candidates"] for r in met.collect()}
    share = np.diag(pairs) / max(n, 1)
    agree = np.maximum(share**2 + (1 - share) ** 2, 0.5)
    best: tuple[float, list[Partition]] | None = None
    for m, groups in layouts.items():
        costs = []
        for i, bits in enumerate(groups):
            odds = sum((1 - agree[b]) / agree[b] for b in bits)
            near = equal.get((m, i), 0.0) + 1.0
            cost, reach, probes = {-1: 0.0}, 0.0, 0
            for t in range(distance + 1):
                reach += odds**t / math.factorial(t)
                probes += math.comb(len(bits), t)
                cost[t] = n * probes + (0.0 if m == 1 else near * reach)
            costs.append(cost)
        spent, chosen = allocate(costs, distance)
        if best is None or spent < best[0]:
            best = spent, [Partition(b, t) for b, t in zip(groups, chosen) if t >= 0]
    return best[1]


def close_links(prints: DataFrame, partitions: list[Partition], distance: int = DISTANCE) -> DataFrame:
    """Links (a > b) that connect exactly the fingerprints within ``distance`` bits.

    ``prints`` has distinct ``fp`` and is read several times.
    """
    if distance > 2:
        raise ValueError("links through centres are exact up to two bits")
    probes = [
        F.struct(
            F.lit(i).alias("i"),
            F.lit(_signed(p.mask)).cast("bigint").alias("mask"),
            F.lit(_signed(flip)).cast("bigint").alias("flip"),
        )
        for i, p in enumerate(partitions) for flip in p.flips()
    ]
    filed = prints.select("fp", F.explode(F.array(*probes)).alias("p")).select(
        "fp",
        F.col("p.i").alias("i"),
        F.col("fp").bitwiseAND(F.col("p.mask")).bitwiseXOR(F.col("p.flip")).alias("value"),
        (F.col("p.flip") == 0).alias("own"),
    )
    sizes = (
        filed.groupBy("i", "value")
        .agg(F.count(F.lit(1)).alias("members"), F.sum(F.col("own").cast("bigint")).alias("filed"))
        .filter("members > 1 AND filed > 0")
    )
    met = filed.join(sizes, ["i", "value"])
    large = F.col("filed") > BITS + 1
    few = met.filter(~large)
    a = few.filter("own").select("i", "value", F.col("fp").alias("x"))
    b = few.select("i", "value", F.col("fp").alias("y"))
    pairs = (
        a.join(b, ["i", "value"])
        .filter((F.col("x") != F.col("y")) & (F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= distance))
        .select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
    )
    around = [0, *[_signed(1 << bit) for bit in range(BITS)]]
    centres = (
        met.filter(large).select("fp").distinct()
        .withColumn("flip", F.explode(F.array(*[F.lit(x).cast("bigint") for x in around])))
        .filter((F.col("flip") == 0) | F.lit(distance == 2))
        .groupBy(F.col("fp").bitwiseXOR(F.col("flip")).alias("centre"))
        .agg(F.array_sort(F.collect_list("fp")).alias("near"))
        .filter(F.size("near") > 1)
        .select(F.explode(F.slice("near", 2, BITS)).alias("a"), F.col("near")[0].alias("b"))
    )
    if distance == 1:  # neighbours at one bit: the fingerprint itself is a centre
        centres = (
            met.filter(large).select("fp").distinct()
            .withColumn("y", F.explode(F.array(*[F.lit(x).cast("bigint") for x in around[1:]])))
            .withColumn("y", F.col("fp").bitwiseXOR(F.col("y")))
            .filter(F.col("y") < F.col("fp"))
            .join(prints.select(F.col("fp").alias("y")), "y")
            .select(F.col("fp").alias("a"), F.col("y").alias("b"))
        )
    return pairs.unionByName(centres).distinct()


def connect(links: DataFrame) -> DataFrame:
    """(node, root) for all nodes of ``links`` (a > b); the root is the smallest reachable.

    Alternates large stars (a node's larger neighbours move to its smallest) and small stars
    (its smaller ones do) until nothing changes: a logarithmic number of rounds in practice. Minima are
    taken per task before any shuffle; each round is written, so nothing is recomputed.
    """

    def shrink(directed: DataFrame) -> DataFrame:
        lowest = directed.groupBy("a").agg(F.min("b").alias("m"))
        moved = directed.join(lowest, "a").filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        return moved.unionByName(lowest.select("a", F.col("m").alias("b"))).distinct()

    def state(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % (1 << 40))).first())

    edges = materialise(links, "links")
    before = state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.filter(F.col("b") > F.col("a")).join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = materialise(shrink(large.distinct()), "stars")
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def fingerprint_components(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(fp, root) for all distinct ``fp`` of a written table, alone ones included."""
    roots = connect(close_links(prints, choose_partitions(prints, distance), distance))
    return prints.select("fp").join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root")
    )


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
    distance: int = DISTANCE,
) -> DataFrame:
    """One row per row: key, ``fp``, ``component_id`` (the smallest key reachable by links).

    Null texts count as empty, and texts without words share fingerprint 0. A row without
    key belongs to its component but never names it; a component without any key has a
    null id. An empty table gives an empty result.
    """
    with small_batches(docs.sparkSession):
        hashed = materialise(
            docs.select(F.col(key).alias("_key"), fingerprint_column(text, shingle).alias("fp")), "fingerprints"
        )
    prints = materialise(hashed.groupBy("fp").agg(F.min("_key").alias("low")), "distinct-fingerprints")
    roots = fingerprint_components(prints, distance)
    lowest = prints.join(roots, "fp").groupBy("root").agg(F.min("low").alias("component_id"))
    named = roots.join(lowest, "root").select("fp", "component_id")
    spread = hashed.withColumn("_spread", F.xxhash64("_key"))
    return skew_safe_join(spread, materialise(named, "components"), ["fp"], spread="_spread").select(
        F.col("_key").alias(key), "fp", "component_id"
    )


def keep_representatives(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
    distance: int = DISTANCE,
) -> DataFrame:
    """One row of each component with all its columns: the smallest key, null keys last.

    Rows are numbered as written, so of repeated rows exactly one stays.
    """
    columns = docs.columns
    renamed = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    at = {c: f"c{i}" for i, c in enumerate(columns)}
    with small_batches(docs.sparkSession):
        rows = with_stable_row_id(renamed.withColumn("fp", fingerprint_column(at[text], shingle)), "fingerprinted")
    prints = materialise(rows.select("fp").distinct(), "distinct-fingerprints")
    roots = materialise(fingerprint_components(prints, distance), "components")
    first = F.min(F.struct(F.col(at[key]).isNull(), at[key], "row_id"))
    by_print = rows.groupBy("fp").agg(first.alias("first"))
    chosen = by_print.join(roots, "fp").groupBy("root").agg(F.min("first").alias("first"))
    stays = chosen.select(F.col("first.row_id").alias("row_id"))
    return rows.join(stays, "row_id", "left_semi").select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)]
    )


def components_brute(prints: list[int], distance: int = DISTANCE) -> list[int]:
    """For tests: the smallest index reachable from each fingerprint, over all pairs."""
    root = list(range(len(prints)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(prints))]
