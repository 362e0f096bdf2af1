"""Approximate nearest neighbours: NN-descent builds a graph, queries search it greedily.

Nearness is the inner product. The graph holds for every distinct vector its nearest others
found so far. It starts from blocks of a few thousand vectors on the same side of random
hyperplanes. NN-descent then improves it in rounds of Spark joins: the neighbours of a vector, in
both directions, are brought together and each pair that is new to each other is compared, so that a
neighbour's neighbour becomes a neighbour. A query expands the nodes of its beam that are
not yet expanded by a join with the graph until its best nodes are all expanded.

Equal vectors are one node; their smallest ids are attached to results. Vectors travel as single precision
numbers, each vector with a power of two, while the graph is built and searched; the best nodes of each query are scored again in
double precision on the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

import prefmill.shipping  # noqa: F401
from prefmill.llm.common import first_by_hash
from prefmill.session import materialise


@dataclass(frozen=True)
class Settings:
    """``sample`` bounds the vectors that hyperplanes are drawn from; all are indexed.

    Descent goes on until at most the share ``settled`` of all links changed in a round, the search until no
    query has anything left to expand; ``rounds`` and ``search_rounds`` can end them earlier.
    """

    neighbours: int = 40
    trees: int = 18
    block: int = 2048
    per_block: int = 24
    fan: int = 24
    rounds: int | None = None
    settled: float = 0.001
    sample: int = 4096
    beam: int = 32
    search_rounds: int | None = None
    rescored: int = 48
    seed: int = 7


@dataclass(frozen=True)
class Index:
    vectors: DataFrame  # id, vec: one row a distinct vector
    packed: DataFrame  # id, half
    members: DataFrame  # node, id: all rows with the node's vector
    graph: DataFrame  # id, nodes, sims, fresh


def usable(vector: str | Column) -> Column:
    """Neither null, empty, zero, nor with a component that is null or not finite."""
    limit = float(np.finfo(np.float64).max)

    def fine(x: Column) -> Column:
        x = x.cast("double")
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= limit)

    return F.coalesce(
        F.forall(vector, fine) & F.exists(vector, lambda x: x != 0), F.lit(False)
    )


def valid_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, vec) of the rows that take part: one for each id.

    Rows without key, and vectors that are not ``usable`` or not of the most common length (the longest of
    several), are left out. Of several vectors under one id the smallest counts.
    """
    rows = df.select(F.col(key).alias("id"), F.col(vector).alias("vec"))
    rows = rows.filter(F.col("id").isNotNull() & usable("vec"))
    lengths = rows.groupBy(F.size("vec").alias("n")).agg(F.count(F.lit(1)).alias("c"))
    usual = lengths.agg(F.max(F.struct("c", "n"))["n"].alias("n")).scalar()
    return rows.filter(F.size("vec") == usual).groupBy("id").agg(F.min("vec").alias("vec"))


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Packed vectors as rows of mantissas and the power of two of each row."""
    if not len(column):
        return np.zeros((0, 1), np.float32), np.zeros(0, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    rows = data.view(np.int32).reshape(len(column), -1)
    return np.ascontiguousarray(rows[:, :-1]).view(np.float32), rows[:, -1].astype(np.int64)


def _scaled(products: np.ndarray, powers: np.ndarray) -> np.ndarray:
    """Products of mantissas times powers of two, in double precision and finite."""
    with np.errstate(over="ignore"):
        found = np.ldexp(products.astype(np.float64), powers)
    limit = np.finfo(np.float64).max
    return np.clip(found, -limit, limit)


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, values)])
    flat = np.concatenate(values) if values else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, kind))


def _split(column: pa.ListArray) -> list[np.ndarray]:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    return np.split(flat, np.cumsum(lengths)[:-1]) if len(lengths) else []


def pack_vectors(vectors: DataFrame) -> DataFrame:
    """(id, half): each vector as single precision mantissas and, last, one power of two in 32 bits.

    The power is the vector's own, so that a large vector takes nothing from the others. Half precision would not
    tell the members of a tight cluster apart.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            flat = batch.column("vec").flatten().to_numpy(zero_copy_only=False)
            rows = flat.astype(np.float64).reshape(n, -1) if n else np.zeros((0, 1))
            powers = np.frexp(np.abs(rows).max(axis=1))[1]
            mantissas = np.ldexp(rows, -powers[:, None]).astype(np.float32)
            rows = np.hstack([mantissas.view(np.int32), powers.astype(np.int32)[:, None]])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([r.tobytes() for r in rows], pa.binary())], ["id", "half"]
            )

    return vectors.select("id", "vec").mapInArrow(pack, "id bigint, half binary")


def _exact(rows: np.ndarray, powers: np.ndarray) -> np.ndarray:
    return _scaled(rows, powers[:, None])


def _directions(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Normals of planes between points, their largest component below one."""
    planes = a / 2 - b / 2
    largest = np.abs(planes).max(axis=-1, keepdims=True)
    return (planes / np.where(largest > 0, largest, 1)).astype(np.float32)


def _nearest(ids: np.ndarray, sims: np.ndarray, old: int, count: int) -> tuple[np.ndarray, ...]:
    """The best ``count`` distinct ids, nearest first, and which come after the first ``old``."""
    _, first = np.unique(ids, return_index=True)  # an id met twice has the same nearness
    order = first[np.lexsort((ids[first], -sims[first]))][:count]
    return ids[order], sims[order], order >= old


GRAPH = "id bigint, nodes array<bigint>, sims array<double>, fresh array<boolean>"


def _merged(lists: DataFrame, count: int) -> DataFrame:
    """One row an id from rows (id, kept, nodes, sims): the best of all its lists."""
    flat = lists.groupBy("id").agg(
        F.sort_array(F.collect_list(F.struct((~F.col("kept")).alias("late"), "nodes", "sims"))).alias("l")
    )
    flat = flat.select(
        "id",
        F.flatten("l.nodes").alias("nodes"),
        F.flatten("l.sims").alias("sims"),
        F.aggregate("l", F.lit(0), lambda n, x: n + F.when(x["late"], 0).otherwise(F.size(x["nodes"]))).alias("old"),
    )

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = batch.column("old").to_numpy()
            found = [
                _nearest(n, s, o, count)
                for n, s, o in zip(_split(batch.column("nodes")), _split(batch.column("sims")), old)
            ]
            columns = [list(c) for c in zip(*found)] if found else [[], [], []]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), _lists(columns[0], pa.int64()), _lists(columns[1], pa.float64()), _lists(columns[2], pa.bool_())],
                ["id", "nodes", "sims", "fresh"],
            )

    return flat.mapInArrow(best, GRAPH)


BLOCK = ("tree", "code", "cut")
#: Planes that a crowded block is cut by at a time, members that they are drawn from, and the last ``cut`` to be cut again.
CUT_PLANES, CUT_SAMPLE, LAST_CUT = 3, 256, 1 << 56


def _uncrowded(blocks: DataFrame, dimension: int, settings: Settings) -> DataFrame:
    """Blocks (id, half, tree, code, cut, piece) with the crowded ones cut by planes drawn from their own members.

    ``cut`` numbers the parts of a block like a heap, from 1, so that parts of different rounds differ. Rounds go on until no part is
    crowded. Members that are all alike in single precision, which no plane divides, are cut by a hash into pieces.
    """

    def crowded(rows: DataFrame) -> DataFrame:
        counts = rows.groupBy(*BLOCK).agg(F.count(F.lit(1)).alias("n"))
        return materialise(counts.filter(F.col("n") > 2 * settings.block), "crowded-blocks")

    def draw(key: tuple, members: pa.Table) -> pa.Table:
        members = members.sort_by("id")
        rows, powers = _unpacked(members.column("half").combine_chunks())
        points, (tree, code, cut) = _exact(rows, powers), (k.as_py() for k in key)
        kinds = np.unique(points, axis=0)
        rng = np.random.default_rng([settings.seed, tree, code, cut])
        wanted = min(CUT_PLANES, int(np.ceil(np.log2(members.column("n")[0].as_py() / settings.block))))
        planes, middles = np.zeros((CUT_PLANES, dimension), np.float32), np.full(CUT_PLANES, np.inf)
        drawn = 0
        for _ in range(8 * CUT_PLANES if len(kinds) > 1 else 0):
            one, other = rng.choice(len(kinds), 2, replace=False)
            plane = _directions(kinds[one], kinds[other])
            along = _scaled(rows @ plane, powers)
            middle = np.median(along)
            if not (along > middle).any():  # most are equal: the others come apart from them
                if not (along < middle).any():
                    continue
                middle = along[along < middle].max()
            planes[drawn], middles[drawn] = plane, middle
            drawn += 1
            if drawn == wanted:
                break
        found = {"tree": [tree], "code": [code], "cut": [cut], "planes": [planes.tobytes()], "middles": [middles.tolist()]}
        return pa.table({k: v if drawn else [] for k, v in found.items()}, schema=drawing)

    drawing = pa.schema({"tree": pa.int32(), "code": pa.int64(), "cut": pa.int64(), "planes": pa.binary(), "middles": pa.list_(pa.float64())})

    def divide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, powers = _unpacked(batch.column("half"))
            if not len(rows):
                continue
            planes = np.frombuffer(b"".join(batch.column("planes").to_pylist()), np.float32)
            along = _scaled(np.einsum("nd,nbd->nb", rows, planes.reshape(len(rows), CUT_PLANES, -1)), powers[:, None])
            middles = batch.column("middles").flatten().to_numpy().reshape(along.shape)
            side = ((along > middles).astype(np.int64) << np.arange(CUT_PLANES)).sum(axis=1)
            cut = (batch.column("cut").to_numpy() << CUT_PLANES) + side
            columns = [*(batch.column(c) for c in ("id", "half", "tree", "code")), pa.array(cut)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "half", "tree", "code", "cut"])

    over, done = crowded(blocks), []
    while over.limit(1).count():
        done.append(blocks.join(over, [*BLOCK], "left_anti"))
        hot = blocks.join(over, [*BLOCK]).drop("piece")
        sample = hot.filter(F.pmod(F.xxhash64(F.lit("planes"), "id", "tree"), "n") < CUT_SAMPLE).filter(F.col("cut") <= LAST_CUT)
        drawn = sample.groupBy(*BLOCK).applyInArrow(draw, "tree int, code bigint, cut bigint, planes binary, middles array<double>")
        drawn = materialise(drawn, "block-planes")
        alike = F.pmod(F.xxhash64("id", "tree"), F.ceil(F.col("n") / settings.block)).cast("int").alias("piece")
        done.append(hot.join(drawn, [*BLOCK], "left_anti").select("id", "half", *BLOCK, alike))
        parts = hot.join(drawn, [*BLOCK]).mapInArrow(divide, "id bigint, half binary, tree int, code bigint, cut bigint")
        blocks = materialise(parts, "block-parts").withColumn("piece", F.lit(0))
        over = crowded(blocks)
    for part in done:
        blocks = blocks.unionByName(part)
    return blocks


def first_graph(packed: DataFrame, n: int, settings: Settings) -> DataFrame:
    """Neighbours within blocks on the same side of hyperplanes, for several sets of planes.

    A block that more vectors fall into than twice the aim is cut by further planes, see ``_uncrowded``, so none is
    large; no vector is left out.
    """
    rng = np.random.default_rng(settings.seed)
    sample = first_by_hash(packed, F.xxhash64("id"), settings.sample, n).collect()
    points = _exact(*_unpacked(pa.array([bytes(r["half"]) for r in sample], pa.binary())))
    bits = max(0, int(np.ceil(np.log2(max(1, n) / settings.block))))
    shape = (settings.trees, bits)
    ends = rng.integers(0, len(points), (2, *shape))
    planes = _directions(points[ends[0]], points[ends[1]])  # trees, bits, dimension
    middles = np.median(np.einsum("tbd,nd->tbn", planes, points), axis=2) if bits else np.zeros(shape)

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, powers = _unpacked(batch.column("half"))
            if not batch.num_rows:
                rows = np.zeros((0, points.shape[1]), np.float32)
            side = _scaled(np.einsum("nd,tbd->ntb", rows, planes, optimize=True), powers[:, None, None]) > middles
            code = (side.astype(np.int64) << np.arange(bits)).sum(axis=2)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, _lists(list(code), pa.int64())], ["id", "half", "codes"]
            )

    coded = materialise(packed.mapInArrow(codes, "id bigint, half binary, codes array<bigint>"), "coded-vectors")
    blocks = coded.select(
        "id", "half", F.posexplode("codes").alias("tree", "code"), F.lit(1).cast("bigint").alias("cut"), F.lit(0).alias("piece")
    )
    blocks = _uncrowded(blocks, points.shape[1], settings)
    count = settings.per_block

    def compare(block: pa.Table) -> pa.Table:
        ids = block.column("id").to_numpy()
        rows, powers = _unpacked(block.column("half").combine_chunks())
        # what is nearest to a row does not depend on its own power
        top = powers.max()
        factor = np.exp2((powers - top).astype(np.float32 if powers.min() > top - 60 else np.float64))
        near, sims = [], []
        for at in range(0, len(ids), 512):
            some = (rows[at : at + 512] @ rows.T) * factor
            some[np.arange(len(some)), at + np.arange(len(some))] = -np.inf
            k = min(count, len(ids) - 1)
            best = np.argpartition(-some, k - 1, axis=1)[:, :k] if k else np.zeros((len(some), 0), np.int64)
            near += list(ids[best])
            sims += list(_scaled(np.take_along_axis(some, best, axis=1), powers[at : at + 512, None] + top))
        return pa.table({"id": ids, "nodes": _lists(near, pa.int64()), "sims": _lists(sims, pa.float64())})

    found = blocks.groupBy(*BLOCK, "piece").applyInArrow(
        compare, "id bigint, nodes array<bigint>, sims array<double>"
    )
    merged = _merged(found.withColumn("kept", F.lit(False)), settings.neighbours)
    return materialise(merged, "graph")


def descend(graph: DataFrame, packed: DataFrame, settings: Settings, turn: int) -> DataFrame:
    """One round of NN-descent.

    A node's group is its ``fan`` nearest and as many of those that list it, chosen by hash,
    which bounds the group of a node that many list. Groups without a fresh link are skipped. A pair is reported to a member
    if it beats the member's farthest neighbour.
    """
    links = graph.select(
        F.col("id").alias("hub"),
        F.explode(F.arrays_zip(F.slice("nodes", 1, settings.fan).alias("id"), F.slice("fresh", 1, settings.fan).alias("fresh"))).alias("l"),
    ).select("hub", F.col("l.id").alias("id"), F.col("l.fresh").alias("fresh"))
    back = links.select(F.col("id").alias("hub"), F.col("hub").alias("id"), "fresh")
    chance = Window.partitionBy("hub").orderBy(F.xxhash64(F.lit(turn), "hub", "id"))
    back = back.withColumn("r", F.row_number().over(chance)).filter(F.col("r") <= settings.fan).drop("r")
    groups = (
        links.unionByName(back)
        .groupBy("hub")
        .agg(F.collect_list(F.struct("id", "fresh")).alias("m"))
        .filter(F.exists("m", lambda x: x["fresh"]))
        .select("hub", F.explode("m").alias("m"))
        .select("hub", "m.id", "m.fresh")
    )
    # A list that is not full yet takes whatever comes.
    farthest = F.when(F.size("sims") < settings.neighbours, float("-inf")).otherwise(F.array_min("sims"))
    points = packed.join(graph.select("id", farthest.cast("double").alias("kth")), "id")
    gathered = (
        groups.join(points, "id")
        .groupBy("hub")
        .agg(F.collect_list(F.struct("id", "fresh", "kth", "half")).alias("m"))
        .select("m")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group = batch.column("m")
            ids, fresh, kth, half = group.flatten().flatten()
            ids, kth = ids.to_numpy(), kth.to_numpy()
            fresh = fresh.to_numpy(zero_copy_only=False).astype(bool)
            rows, powers = _unpacked(half)
            ends = np.cumsum(group.value_lengths().to_numpy(zero_copy_only=False))
            to, near, sims, start = [], [], [], 0
            for end in ends:
                # of an id listed both ways, the fresh link comes first
                order = np.lexsort((~fresh[start:end], ids[start:end])) + start
                order = order[np.r_[True, ids[order][1:] != ids[order][:-1]]]
                own = ids[order]
                s = _scaled(rows[order] @ rows[order].T, powers[order][:, None] + powers[order])
                new = fresh[order]
                better = (s > kth[order][:, None]) & (new[:, None] | new[None, :])
                np.fill_diagonal(better, False)
                counts = better.sum(axis=1)
                told = np.flatnonzero(counts)
                if len(told):
                    a, b = np.nonzero(better)
                    to.append(own[told])
                    near += np.split(own[b], np.cumsum(counts[told])[:-1])
                    sims += np.split(s[a, b], np.cumsum(counts[told])[:-1])
                start = end
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(to) if to else np.zeros(0, np.int64)), _lists(near, pa.int64()), _lists(sims, pa.float64())],
                ["id", "nodes", "sims"],
            )

    found = gathered.mapInArrow(compare, "id bigint, nodes array<bigint>, sims array<double>")
    lists = found.withColumn("kept", F.lit(False)).unionByName(
        graph.select("id", "nodes", "sims", F.lit(True).alias("kept"))
    )
    return materialise(_merged(lists, settings.neighbours), "graph")


def changed_share(graph: DataFrame) -> float:
    """The share of all links that came in with the last round. Lists only get better, so it falls to zero."""
    fresh, links = graph.agg(F.sum(F.size(F.filter("fresh", lambda x: x))), F.sum(F.size("nodes"))).first()
    return fresh / links if links else 0.0


def build_index(df: DataFrame, key: str = "vec_id", vector: str = "embedding", settings: Settings = Settings()) -> Index | None:
    """Index every usable row; None if there is none."""
    rows = materialise(valid_vectors(df, key, vector), "vectors")
    nodes = rows.groupBy("vec").agg(F.min("id").alias("node"))
    members = materialise(rows.join(nodes, "vec").select("node", "id"), "members")
    vectors = materialise(nodes.select(F.col("node").alias("id"), "vec"), "distinct-vectors")
    n = vectors.count()
    if not n:
        return None
    packed = materialise(pack_vectors(vectors), "packed-vectors")
    graph = first_graph(packed, n, settings)
    for turn in count() if settings.rounds is None else range(settings.rounds):
        graph = descend(graph, packed, settings, turn)
        if changed_share(graph) <= settings.settled:
            break
    return Index(vectors, packed, members, graph)


STATE = "q bigint, half binary, nodes array<bigint>, sims array<double>, expanded array<bigint>, frontier array<bigint>"


def search_graph(index: Index, starts: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(q, nodes): nodes nearest first, for queries (q, half, start: nodes to set out from).

    A round expands those of a query's best ``beam`` nodes that have not been expanded.
    """
    none = F.array().cast("array<bigint>")
    state = starts.select(
        "q", "half", none.alias("nodes"), F.array().cast("array<double>").alias("sims"),
        none.alias("expanded"), F.col("start").alias("frontier"),
    )
    edges = index.graph.select(F.col("id").alias("f"), F.col("nodes").alias("near"))
    for _ in count() if settings.search_rounds is None else range(settings.search_rounds):
        reached = (
            state.select("q", F.explode("frontier").alias("f"))
            .join(edges, "f", "left")
            .groupBy("q")
            # the frontier itself is met as well, for nodes that no one has scored yet
            .agg(F.array_distinct(F.concat(F.flatten(F.collect_list(F.coalesce("near", none))), F.collect_list("f"))).alias("met"))
        )
        unseen = (
            state.join(reached, "q")
            .select("q", F.explode(F.array_except("met", "nodes")).alias("id"))
            .join(index.packed.withColumnRenamed("half", "other"), "id")
            .groupBy("q")
            .agg(F.collect_list(F.struct("id", "other")).alias("m"))
        )
        beam = settings.beam

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                halves, powers = _unpacked(batch.column("half"))
                old = [_split(batch.column(c)) for c in ("nodes", "sims", "expanded", "frontier")]
                group = batch.column("m")
                ids, other = group.flatten().flatten()
                ids, (rows, others) = ids.to_numpy(), _unpacked(other)
                if not len(ids):
                    rows = np.zeros((0, halves.shape[1]), np.float32)
                ends = np.cumsum(group.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                out, start = [[], [], [], []], 0
                for i, end in enumerate(ends):
                    nodes = np.concatenate([old[0][i], ids[start:end]])
                    sims = np.concatenate([old[1][i], _scaled(rows[start:end] @ halves[i], others[start:end] + powers[i])])
                    order = np.lexsort((nodes, -sims))
                    nodes, sims = nodes[order], sims[order]
                    expanded = np.concatenate([old[2][i], old[3][i]])
                    best = nodes[:beam]
                    for part, value in zip(out, (nodes, sims, expanded, best[~np.isin(best, expanded)])):
                        part.append(value)
                    start = end
                kinds = (pa.int64(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("q"), batch.column("half"), *[_lists(p, k) for p, k in zip(out, kinds)]],
                    ["q", "half", "nodes", "sims", "expanded", "frontier"],
                )

        state = materialise(state.join(unseen, "q", "left").mapInArrow(step, STATE), "search")
        if not state.filter(F.size("frontier") > 0).limit(1).count():
            break
    return state.select("q", "nodes")


def entry_points(index: Index, count: int = 64) -> list[int]:
    """Fixed nodes from which a query that is not in the index sets out."""
    nodes = index.packed.select("id")
    return [r[0] for r in first_by_hash(nodes, F.xxhash64("id"), count, nodes.count()).collect()]


def inner_product(a: str, b: str) -> Column:
    """In double precision, from left to right."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def nearest_members(
    index: Index, queries: DataFrame, count: int = 20, settings: Settings = Settings(),
) -> DataFrame:
    """(query_id, rank, vec_id, score) for indexed ids (``query_id``): their nearest others.

    Nearest first, ties to the smaller id, all others if there are fewer than ``count``.
    """
    asked = index.members.join(queries.select(F.col("query_id").alias("id")), "id", "left_semi")
    asked = asked.select(F.col("id").alias("query_id"), F.col("node").alias("q"))
    starts = index.packed.join(asked.select(F.col("q").alias("id")).distinct(), "id").select(
        F.col("id").alias("q"), "half", F.array("id").alias("start")
    )
    found = search_graph(index, starts, settings)
    # Copies of the query and of each other only ever bring results nearer.
    best = found.select("q", F.explode(F.slice("nodes", 1, max(settings.rescored, count + 1))).alias("node"))
    vectors = index.vectors
    scored = (
        best.join(vectors.select(F.col("id").alias("node"), F.col("vec").alias("there")), "node")
        .join(vectors.select(F.col("id").alias("q"), F.col("vec").alias("here")), "q")
        .select("q", "node", inner_product("here", "there").alias("score"))
    )
    few = Window.partitionBy("node").orderBy("id")
    copies = index.members.withColumn("r", F.row_number().over(few)).filter(F.col("r") <= count + 1).drop("r")
    nearer = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    short = (
        scored.join(copies, "node")
        .withColumn("r", F.row_number().over(nearer))
        .filter(F.col("r") <= count + 1)
        .select("q", F.col("id").alias("vec_id"), "score")
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return (
        asked.join(short, "q")
        .filter(F.col("query_id") != F.col("vec_id"))
        .withColumn("rank", rank)
        .filter(F.col("rank") <= count)
        .select("query_id", "rank", "vec_id", "score")
    )
