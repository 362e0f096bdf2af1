"""Exact deduplication by content sort.

Rows are dealt by sampled splitters into ranges of (head of the normalised text, its SHA-256,
key). Each range is sorted externally, which places equal texts next to each other, smallest
key first, and each row is compared in full with its neighbour. Splitters hold 32 characters
and a digest rather than whole texts, so that they stay small on the driver; the key in them lets a
large group of copies span many ranges. The first and last run of a range are then compared in full
with those of the neighbouring ranges, and runs that continue become one group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

import prefmill.shipping  # noqa: F401
from prefmill.llm.common import BLANKS, small_batches, text_of
from prefmill.session import materialise

HEAD_CHARS = 32


def normalised(text: str | Column) -> Column:
    """The text with each run of ASCII white space as one space; null counts as empty."""
    return F.regexp_replace(text_of(text), BLANKS, " ")


def _runs(batches: Iterator[pa.RecordBatch], schema: pa.Schema, whole: bool) -> Iterator[pa.RecordBatch]:
    """Rows of one sorted range, each with its run's first key and size.

    Runs that end inside a batch leave as arrays. The last run of a batch waits for the next
    one: its first row, and its keys (with ``whole`` only its first row, since then only the
    first row of each run is returned, with its payload).
    """
    head: pa.RecordBatch | None = None  # first row of the run that is still open
    keys: list[pa.Array] = []
    count = runs_done = 0

    def emit(rows: pa.RecordBatch, keep: pa.Array, sizes, lead, last: bool, edge) -> pa.RecordBatch:
        n = rows.num_rows
        first = np.zeros(n, dtype=bool)
        if runs_done == 0:
            first[: n if edge is None else edge] = True
        texts = rows.column("_norm")
        shown = np.asarray(lead) & (first | last)
        columns = {
            "_key": rows.column("_key"),
            "keep_id": keep,
            "group_size": pa.array(sizes, pa.int64()),
            "_lead": pa.array(lead),
            "text_sha256": rows.column("text_sha256"),
            "_part": rows.column("_part"),
            "_first": pa.array(first),
            "_last": pa.array(np.full(n, last)),
            "_edge_text": pa.array([texts[i].as_py() if s else None for i, s in enumerate(shown)], texts.type)
            if shown.any() else pa.nulls(n, texts.type),
        }
        if whole:
            columns["_payload"] = rows.column("_payload")
        return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in schema], schema=schema)

    def close(last: bool) -> Iterator[pa.RecordBatch]:
        """The open run. Its rows differ in nothing but the key; only the first carries the text."""
        if whole:
            yield emit(head, head.column("_key"), [count], np.ones(1, bool), last, None)
            return
        for i, part in enumerate(keys):
            n = len(part)
            lead = np.zeros(n, dtype=bool)
            lead[0] = i == 0
            text = pa.concat_arrays([head.column("_norm"), pa.nulls(n - 1, head.column("_norm").type)])
            columns = [
                part if f.name == "_key"
                else text if f.name == "_norm"
                else pa.repeat(head.column(f.name)[0], n)
                for f in head.schema
            ]
            rows = pa.RecordBatch.from_arrays(columns, schema=head.schema)
            yield emit(rows, pa.repeat(head.column("_key")[0], n), np.full(n, count), lead, last, None)

    def owned(rows: pa.RecordBatch) -> pa.RecordBatch:
        """A copy that does not hold on to the buffers of a whole batch."""
        return rows.take(pa.array(np.arange(rows.num_rows)))

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        norm = batch.column("_norm")
        same = np.zeros(n, dtype=bool)
        if n > 1:
            same[1:] = pc.equal(norm.slice(1), norm.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        if head is not None:
            same[0] = pc.equal(norm.slice(0, 1), head.column("_norm"))[0].as_py()
        starts = np.flatnonzero(~same)
        tail = int(starts[0]) if len(starts) else n  # rows that continue the open run
        if tail:
            count += tail
            if not whole:
                keys.append(owned(batch.slice(0, tail)).column("_key"))
        if not len(starts):
            continue
        if head is not None:
            yield from close(last=False)
            runs_done += 1
        sizes = np.diff(starts)
        if len(sizes):
            if whole:
                rows = batch.take(pa.array(starts[:-1]))
                yield emit(rows, rows.column("_key"), sizes, np.ones(len(sizes), bool), False, 1)
            else:
                begin, end = int(starts[0]), int(starts[-1])
                keep = batch.column("_key").take(pa.array(np.repeat(starts[:-1], sizes)))
                rows = batch.slice(begin, end - begin)
                yield emit(rows, keep, np.repeat(sizes, sizes), ~same[begin:end], False, int(sizes[0]))
            runs_done += len(sizes)
        begin = int(starts[-1])
        head, count = owned(batch.slice(begin, 1)), n - begin
        keys = [] if whole else [owned(batch.slice(begin)).column("_key")]
    if head is not None:
        yield from close(last=True)


def _settle_edges(runs: DataFrame) -> DataFrame:
    """Per edge run: the group it belongs to, as first key, size, and whether it leads.

    Narrow: two rows a range at most, numbered in one small task. Texts are compared in a join by range.
    """
    edges = runs.filter(F.col("_edge_text").isNotNull()).select(
        "_part", "_first", "_last", "keep_id", "group_size", "_edge_text"
    )
    parts = edges.filter("_first").select("_part")
    following = parts.select("_part", F.lead("_part").over(Window.orderBy("_part")).alias("_next"))
    ends = edges.filter("_last").select("_part", F.col("_edge_text").alias("_end"))
    begins = edges.filter("_first").select(F.col("_part").alias("_next"), F.col("_edge_text").alias("_begin"))
    continued = (
        ends.join(following, "_part")
        .join(begins, "_next")
        .filter(F.col("_end") == F.col("_begin"))
        .select(F.col("_next").alias("_part"), F.lit(True).alias("_first"), F.lit(True).alias("_goes_on"))
    )
    nodes = edges.select("_part", "_first", "_last", "keep_id", "group_size").join(
        continued, ["_part", "_first"], "left"
    )
    order = Window.orderBy("_part", "_last")
    chain = F.sum(F.when(F.col("_goes_on"), 0).otherwise(1)).over(order)
    nodes = nodes.withColumn("_chain", chain)
    same = Window.partitionBy("_chain")
    along = same.orderBy("_part", "_last")
    return nodes.select(
        "_part",
        "_first",
        "_last",
        F.first("keep_id").over(along).alias("_keep"),
        F.sum("group_size").over(same).alias("_size"),
        (F.row_number().over(along) == 1).alias("_leads"),
    )


def _sorted_runs(docs: DataFrame, key: str, text: str, payload: list[str]) -> DataFrame:
    whole = bool(payload)
    body = F.col("_payload").getField(text) if whole else F.col("_text")
    rows = docs.select(
        F.col(key).alias("_key"),
        F.struct(*payload).alias("_payload") if whole else F.col(text).alias("_text"),
    )
    norm = normalised(body)
    rows = rows.withColumns({"_head": F.substring(norm, 1, HEAD_CHARS), "text_sha256": F.sha2(norm, 256)})
    key_order = F.col("_key").asc_nulls_last()
    dealt = rows.repartitionByRange("_head", "text_sha256", key_order)
    ordered = (
        dealt.withColumn("_norm", norm)
        .drop("_text")
        .sortWithinPartitions("_head", "text_sha256", "_norm", key_order)
        .withColumn("_part", F.spark_partition_id())
        .drop("_head")
    )
    kind = docs.schema[key].dataType
    fields = [
        T.StructField("_key", kind), T.StructField("keep_id", kind),
        T.StructField("group_size", T.LongType()), T.StructField("_lead", T.BooleanType()),
        T.StructField("text_sha256", T.StringType()), T.StructField("_part", T.IntegerType()),
        T.StructField("_first", T.BooleanType()), T.StructField("_last", T.BooleanType()),
        T.StructField("_edge_text", T.StringType()),
    ]
    if whole:
        fields.append(T.StructField("_payload", ordered.schema["_payload"].dataType))
    schema = T.StructType(fields)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        yield from _runs(batches, to_arrow_schema(schema), whole)

    with small_batches(docs.sparkSession):
        return materialise(ordered.mapInArrow(runs, schema), "sorted-runs")


def _decided(runs: DataFrame) -> DataFrame:
    edges = _settle_edges(runs)
    return runs.join(F.broadcast(edges), ["_part", "_first", "_last"], "left").withColumns(
        {
            "kept": F.col("_lead") & F.coalesce("_leads", F.lit(True)),
            "keep_id": F.when(F.col("_leads").isNull(), F.col("keep_id")).otherwise(F.col("_keep")),
            "group_size": F.coalesce("_size", "group_size"),
        }
    )


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: key, keep_id, group_size, kept, text_sha256 of the normalised text.

    The smallest key of a group of equal texts stays; rows without key come last, so one
    stays only where no row of its group has a key, with a null keep_id. Of repeated rows
    exactly one is kept. Null texts are equal to empty ones. An empty table gives an empty result.
    """
    return _decided(_sorted_runs(docs, key, text, [])).select(
        F.col("_key").alias(key), "keep_id", "group_size", "kept", "text_sha256"
    )


def drop_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that ``exact_groups`` keeps, with all their columns and original texts."""
    columns = docs.columns
    renamed = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    at = {c: f"c{i}" for i, c in enumerate(columns)}
    runs = _sorted_runs(renamed, at[key], at[text], renamed.columns)
    kept = _decided(runs).filter("kept")
    return kept.select(*[F.col(f"_payload.c{i}").alias(c) for i, c in enumerate(columns)])
