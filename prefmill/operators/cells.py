"""Verdicts of instances of very different sizes, cut into cells of bounded cost and dealt out by cost.

Row by row, an instance with ten thousand completions is one task's work while the others wait. Here its matrix
(verifiers x texts) is cut into cells: blocks of texts first, then, where one block still costs too much, blocks
of verifiers. The cost of a cell is its verifiers times the bytes of its texts, plus a fixed sum a call. Cells are
dealt to partitions by cost, and the matrices are put together again from the codes, which are small.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefmill import shipping  # noqa: F401
from prefmill.operators.verification import Budget, run_verifiers
from prefmill.session import with_stable_row_id

#: A call costs as much as that many bytes of text.
CALL_BYTES = 256
CELL_COST = 1 << 22
#: Cells are dealt in so many buckets a partition; the driver places the buckets.
BUCKETS = 32
CELLS = "row_id string, first_verifier int, first_input int, sources array<string>, inputs array<string>, cost bigint"


def blocks(costs: np.ndarray, limit: int) -> np.ndarray:
    """Where blocks of at most ``limit`` begin, in order; a cost above the limit is a block of its own."""
    starts, upto = [0], np.cumsum(costs)
    while True:
        before = upto[starts[-1] - 1] if starts[-1] else 0
        after = max(starts[-1] + 1, int(np.searchsorted(upto, before + limit, side="right")))
        if after >= len(costs):
            return np.array(starts)
        starts.append(after)


def cut_cells(rows: DataFrame, cell_cost: int = CELL_COST) -> DataFrame:
    """Cells of at most ``cell_cost`` (unless a single call costs more) from row_id, sources, inputs.

    An instance without verifiers or texts, or with null for them, is one cell.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, sources, inputs in zip(*batch.columns):
                sources = sources.values if sources.is_valid else pa.array([], pa.string())
                inputs = inputs.values if inputs.is_valid else pa.array([], pa.string())
                sizes = pc.fill_null(pc.binary_length(inputs), 0).to_numpy(zero_copy_only=False).astype(np.int64) + CALL_BYTES
                begins = blocks(sizes, cell_cost) if len(sizes) else np.zeros(1, dtype=np.int64)
                for begin, end in zip(begins, np.append(begins[1:], len(inputs))):
                    cost = max(CALL_BYTES, int(sizes[begin:end].sum()))
                    wide = max(1, cell_cost // cost)
                    for verifier in range(0, max(1, len(sources)), wide):
                        own = sources.slice(verifier, wide)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([row.as_py()]), pa.array([verifier], pa.int32()), pa.array([begin], pa.int32()),
                                pa.ListArray.from_arrays([0, len(own)], own),
                                pa.ListArray.from_arrays([0, int(end - begin)], inputs.slice(begin, end - begin)),
                                pa.array([cost * max(1, len(own))], pa.int64()),
                            ],
                            names=["row_id", "first_verifier", "first_input", "sources", "inputs", "cost"],
                        )

    return rows.select("row_id", "sources", "inputs").mapInArrow(run, CELLS)


def place(costs: dict[int, int], partitions: int) -> dict[int, int]:
    """A partition for each bucket: the dearest first, each to the partition that has least so far."""
    loads = [(0, p) for p in range(partitions)]
    placed = {}
    for bucket, cost in sorted(costs.items(), key=lambda x: (-x[1], x[0])):
        load, own = heapq.heappop(loads)
        placed[bucket] = own
        heapq.heappush(loads, (load + cost, own))
    return placed


def deal(cells: DataFrame, partitions: int) -> DataFrame:
    """Cells spread over ``partitions`` so that each has about the same cost.

    The driver sees one sum for each of ``BUCKETS`` buckets a partition, whatever the number of cells. ``cells`` is
    read twice. The partition is named outright, since hashing it would put some together.
    """
    spark = cells.sparkSession
    bucket = F.pmod(F.xxhash64("row_id", "first_verifier", "first_input"), F.lit(partitions * BUCKETS)).cast("int")
    filed = cells.withColumn("bucket", bucket)
    costs = {r["bucket"]: r["cost"] for r in filed.groupBy("bucket").agg(F.sum("cost").alias("cost")).collect()}
    placed = spark.createDataFrame(list(place(costs, partitions).items()), "bucket int, partition int")
    return filed.join(F.broadcast(placed), "bucket").repartitionById(partitions, "partition").drop("bucket", "partition")


def assemble(judged: DataFrame) -> DataFrame:
    """row_id and the struct of its verdicts, from those of its cells."""
    calls = judged.select(
        "row_id", "first_verifier", "first_input", F.col("verdicts.timed_out").alias("timed_out"),
        F.col("verdicts.late").alias("late"), F.posexplode_outer("verdicts.matrix").alias("at", "m"),
    )
    verifiers = calls.groupBy("row_id", (F.col("first_verifier") + F.col("at")).alias("pos")).agg(
        F.bool_or("timed_out").alias("timed_out"), F.bool_or("late").alias("late"),
        F.min_by("m.compiled", "first_input").alias("compiled"),
        F.array_sort(F.collect_list(F.struct("first_input", F.col("m.codes").alias("codes")))).alias("parts"),
    )
    codes = F.flatten(F.transform("parts", lambda p: p["codes"]))
    whole = verifiers.withColumn("codes", codes).groupBy("row_id").agg(
        F.bool_or("timed_out").alias("timed_out"), F.bool_or("late").alias("late"),
        F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "compiled", "codes")))).alias("matrix"),
    )
    matrix = F.transform("matrix", lambda v: F.struct(v["compiled"].alias("compiled"), v["codes"].alias("codes")))
    judged_all = ~F.col("timed_out") & ~F.col("late")
    return whole.select(
        "row_id", F.struct("timed_out", "late", F.when(judged_all, matrix).alias("matrix")).alias("verdicts")
    )


def written_with(df: DataFrame, arguments: dict[str, Column], name: str) -> tuple[DataFrame, dict[str, Column]]:
    """``df`` written with a lasting ``row_id``, and the arguments as columns of it.

    An argument that is a column of ``df`` is read back as that column; texts are not written twice.
    """
    found, more = {}, {}
    for key, value in arguments.items():
        asked = df.select(value)
        own = F.col("`" + asked.columns[0].replace("`", "``") + "`")
        if asked.columns[0] in df.columns and asked.sameSemantics(df.select(own)):
            found[key] = own
        else:
            found[key], more[key] = F.col(key), value
    return with_stable_row_id(df.withColumns(more) if more else df, name), found


def run_balanced(
    df: DataFrame, sources: Column, inputs: Column, partitions: int, out: str = "verdicts",
    budget: Budget = Budget(), allow_execution: bool = False, cell_cost: int = CELL_COST, keep_timed_out: bool = False,
) -> DataFrame:
    """As ``run_verifiers``, with the work dealt to ``partitions`` in cells of bounded cost.

    Verdicts are the same, but for verifiers that remember earlier calls: they see those of their cell. The limit per
    instance holds per cell, and an instance is dropped when any of its cells is over it. The rows are written once, which
    gives them a lasting id; only arrays of sources and texts are dealt out, and only codes come back.
    """
    named, own = written_with(df, {"_sources": sources, "_inputs": inputs}, "cell-rows")
    rows = named.select("row_id", own["_sources"].alias("sources"), own["_inputs"].alias("inputs"))
    dealt = deal(cut_cells(rows, cell_cost), partitions)
    judged = run_verifiers(
        dealt, F.col("sources"), F.col("inputs"), budget=replace(budget, stage_seconds=None),
        allow_execution=allow_execution, keep_timed_out=True,
    )
    whole = assemble(judged).withColumnRenamed("verdicts", out)
    joined = named.drop("_sources", "_inputs").join(whole, "row_id").drop("row_id")
    return joined if keep_timed_out else joined.filter(~F.col(f"{out}.timed_out") & ~F.col(f"{out}.late"))
