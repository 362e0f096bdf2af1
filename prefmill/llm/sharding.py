"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring has 65,536 cells, or 1,024 a shard if that is more; a document lies in the cell of its text's hash, so equal
texts lie together. Each shard has virtual nodes on the ring. A cell goes to the first virtual node
clockwise whose shard has room, and on past full shards. Capacity is the mean load times
``1 + slack``, so balance is guaranteed, and only overflow moves when shards are added.

Loads are gathered per cell. A cell with more than 1/256 of all, or 1/32 of a shard's mean if that is less, may hold
one large group of copies: it is cut into up to 1,024 parts, each about 1/256 of a shard's mean or less, by a
hash of the row key, which take their places on the ring one by one. Rows with one key and text that still hold
more than 1/2048 of all (1/256 of a mean) are dealt over the parts row by row. That bounds what the
driver places and the broadcast map: 65,536 + 256 * 1,024 rows for up to 8 shards, 1,312 rows a shard for more than 64.
"""

from __future__ import annotations

import bisect
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prefmill.session import materialise

CELL_BITS, CELLS_PER_SHARD = 16, 1024
HEAVY_SHARE, HEAVY_PER_SHARD = 256, 32
PARTS, PARTS_PER_SHARD = 1024, 256
SAME_SHARE, SAME_PER_SHARD = 2048, 256
VIRTUAL_NODES = 128
SLACK = 0.005

#: Internal columns of a row: place on the ring, key that cuts heavy cells, load.
PLACE, CUT, LOAD = "_place", "_cut", "_load"


@lru_cache(maxsize=8)
def ring(shards: int, virtual_nodes: int = VIRTUAL_NODES) -> tuple[tuple[int, int], ...]:
    """(position, shard) of all virtual nodes in clockwise order, 64-bit positions."""
    nodes = []
    for shard in range(shards):
        for node in range(virtual_nodes):
            digest = hashlib.md5(f"{shard}:{node}".encode()).digest()
            nodes.append((int.from_bytes(digest[:8], "big"), shard))
    return tuple(sorted(nodes))


def cell_bits(shards: int) -> int:
    return max(CELL_BITS, (shards * CELLS_PER_SHARD - 1).bit_length())


class Clockwise:
    """The nodes of a ring, walked from any place past those whose shard is closed for good."""

    def __init__(self, nodes: tuple[tuple[int, int], ...], shards: int):
        self.positions, self.owner = [p for p, _ in nodes], [s for _, s in nodes]
        self.open = list(range(len(nodes)))  # each node, or one further on if its shard is closed
        self.left = shards
        self.nodes_of: list[list[int]] = [[] for _ in range(shards)]
        for i, shard in enumerate(self.owner):
            self.nodes_of[shard].append(i)

    def first(self, position: int) -> int:
        return bisect.bisect_left(self.positions, position) % len(self.positions)

    def close(self, shard: int) -> None:
        self.left -= 1
        for i in self.nodes_of[shard]:
            self.open[i] = (i + 1) % len(self.open)

    def at(self, node: int) -> int:
        """The node itself or the next open one; some shard must be open."""
        path = []
        while self.open[node] != node:
            path.append(node)
            node = self.open[node]
        for passed in path:
            self.open[passed] = node
        return node


def place_cells(
    loads: list[tuple[int, int, int]], shards: int, slack: float = SLACK,
    virtual_nodes: int = VIRTUAL_NODES, bits: int = CELL_BITS,
) -> list[int]:
    """The shard of each (cell, part, load).

    Large loads are placed first, so that small ones fill what is left; ties by cell and
    part. Where no shard has room (a single load may exceed what is left anywhere) the
    emptiest shard takes it, the first clockwise among equals. A shard without room for the smallest load is
    never looked at again, so walks stay short.
    """
    if not loads:
        return []
    nodes = ring(shards, virtual_nodes)
    walk = Clockwise(nodes, shards)
    capacity = sum(load for _, _, load in loads) * (1 + slack) / shards
    smallest = min(load for _, _, load in loads)
    filled = [0] * shards
    closed = [False] * shards
    placed = [0] * len(loads)
    for i in sorted(range(len(loads)), key=lambda i: (-loads[i][2], loads[i][0], loads[i][1])):
        cell, _, load = loads[i]
        start, chosen = walk.first(cell << (64 - bits)), None
        if walk.left:
            met: set[int] = set()
            node = walk.at(start)
            while len(met) < walk.left:
                shard = walk.owner[node]
                if filled[shard] + load <= capacity:
                    chosen = shard
                    break
                met.add(shard)
                node = walk.at((node + 1) % len(nodes))
        if chosen is None:
            least = min(filled)
            chosen = next(s for j in range(len(nodes)) if filled[s := walk.owner[(start + j) % len(nodes)]] == least)
        filled[chosen] += load
        placed[i] = chosen
        if not closed[chosen] and filled[chosen] + smallest > capacity:
            closed[chosen] = True
            walk.close(chosen)
    return placed


def _cut(rows: DataFrame, key: str, total: int, shards: int) -> DataFrame:
    """Rows of heavy cells, which have ``_parts``, with ``_part``.

    Written, as the numbers of equal rows hold for one reading only.
    """
    many = rows.groupBy(F.col(key).alias("_same_key"), F.col(PLACE).alias("_same_place")).agg(F.sum(LOAD).alias("_same"))
    many = many.filter(F.col("_same") * max(SAME_SHARE, SAME_PER_SHARD * shards) > total)
    alike = F.col(key).eqNullSafe(F.col("_same_key")) & (F.col(PLACE) == F.col("_same_place"))
    number = F.monotonically_increasing_id()
    cut = F.when(F.col("_same").isNull(), F.xxhash64(F.lit("cut"), F.col(key)))
    cut = cut.otherwise(F.xxhash64(F.lit("cut"), F.col(key), number))
    found = rows.join(F.broadcast(many), alike, "left").withColumn("_part", F.pmod(cut, F.col("_parts")).cast("int"))
    return materialise(found.drop("_same_key", "_same_place", "_same", "_parts"), "ring-heavy")


def ring_shards(
    rows: DataFrame, shards: int = 8, key: str = "doc_id", slack: float = SLACK,
    virtual_nodes: int = VIRTUAL_NODES,
) -> DataFrame:
    """Add ``shard`` and ``slot`` to rows with ``_place`` (a 64-bit hash) and ``_load``.

    ``rows`` is read three times: pass a written table. Slots number the rows of a shard
    from 0 without gaps, by cell, part, key and place; equal rows are interchangeable. Rows with the same key
    and place stay together unless they are many, a null key being one like any other. A single load above what the
    slack leaves, such as a very long text, goes to the emptiest shard whole. Input columns that bear the name of a
    result or of a helper (``_cell``, ``_part``, ``_rank``, ``_offset``) are replaced. An empty table gives an empty result.
    """
    spark, bits = rows.sparkSession, cell_bits(shards)
    rows = rows.drop(*[c for c in ("_part", "_parts", "_rank", "_offset", "shard", "slot") if c != key])
    rows = rows.withColumn("_cell", F.shiftrightunsigned(PLACE, 64 - bits).cast("int"))
    measure = (F.sum(LOAD).alias("load"), F.count(F.lit(1)).alias("n"))
    cells = rows.groupBy("_cell").agg(*measure).toArrow().to_pydict()
    cells = list(zip(cells["_cell"], cells["load"], cells["n"]))
    total = sum(load for _, load, _ in cells)
    share = max(HEAVY_SHARE, HEAVY_PER_SHARD * shards)
    pieces = max(PARTS * HEAVY_SHARE, PARTS_PER_SHARD * shards)
    heavy = {cell: min(PARTS, -(-pieces * load // total)) for cell, load, _ in cells if load * share > total}
    if heavy:
        known = F.broadcast(spark.createDataFrame(list(heavy.items()), "_cell int, _parts int"))
        light = rows.join(known, "_cell", "left_anti").withColumn("_part", F.lit(0))
        cut = _cut(rows.join(known, "_cell"), key, total, shards)
        rows = light.unionByName(cut)
    else:
        rows = rows.withColumn("_part", F.lit(0))
    units = [(cell, 0, load, n) for cell, load, n in cells if cell not in heavy]
    if heavy:
        parts = cut.groupBy("_cell", "_part").agg(*measure).toArrow().to_pydict()
        units += list(zip(parts["_cell"], parts["_part"], parts["load"], parts["n"]))
    units.sort()
    shard_of = place_cells([u[:3] for u in units], shards, slack, virtual_nodes, bits)
    offset = [0] * shards
    offsets = []
    for (_, _, _, n), shard in zip(units, shard_of):
        offsets.append(offset[shard])
        offset[shard] += n
    columns = [[u[0] for u in units], [u[1] for u in units], shard_of]
    mapping = spark.createDataFrame(pa.table(
        [*[pa.array(c, pa.int32()) for c in columns], pa.array(np.array(offsets, dtype=np.int64))],
        names=["_cell", "_part", "shard", "_offset"],
    ))
    rank = F.row_number().over(
        Window.partitionBy("_cell", "_part").orderBy(F.col(key).asc_nulls_last(), PLACE)
    )
    return (
        rows.withColumn("_rank", rank)
        .join(F.broadcast(mapping), ["_cell", "_part"])
        .withColumn("slot", F.col("_offset") + F.col("_rank") - 1)
        .drop("_cell", "_part", "_offset", "_rank")
    )


def shard_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """What sharding needs of documents: key, size, text checksum, ring place, load.

    Size is the UTF-8 bytes of the text plus 1. A null text counts as empty.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    size = (F.octet_length(body) + 1).cast("bigint")
    return docs.select(
        key,
        size.alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.xxhash64(body).alias(PLACE),
        size.alias(LOAD),
    )
