"""Huge instances cut into cells, verdicts by content, epochs by permutation, and one merged file."""

import random
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from prefmill.functions.permute import permuted
from prefmill.operators import cells
from prefmill.operators.batching import epoch_batches
from prefmill.operators.cells import CALL_BYTES, blocks, cut_cells, deal, place, run_balanced
from prefmill.operators.verdict_table import VerdictTable, cut
from prefmill.operators.verification import TIMEOUT, Budget, run_verifiers
from prefmill.session import materialise, scratch_path, scratch_run
from prefmill.sources import jsonl

SOURCES = [
    "def evaluate(response):\n    return len(response) % 3 == 0\n",
    "def evaluate(response):\n    return 'x' in response\n",
    "def evaluate(response):\n    return (\n",
    "def evaluate(response):\n    raise ValueError\n",
]
ENDLESS = "def evaluate(response):\n    while len(response) == 2:\n        pass\n    return True\n"
SCHEMA = "instance_id int, verifiers array<string>, completions array<string>"


def mixed(spark):
    """One instance with 10,000 completions beside small and odd ones."""
    huge = (0, SOURCES, [f"x{'y' * (i % 50)}{i}" for i in range(10_000)])
    small = [(i, SOURCES[: 1 + i % 4], ["xyz"[: i % 4] * (i % 7), "no", "no"]) for i in range(1, 60)]
    odd = [(60, [], ["a"]), (61, SOURCES, []), (62, None, None), (63, SOURCES[:1], [None, "a"]), (64, [], [])]
    return spark.createDataFrame([huge, *small, *odd], SCHEMA).repartition(3)


def matrices(df):
    return {
        r["instance_id"]: (r["verdicts"]["timed_out"], [tuple(v) for v in r["verdicts"]["matrix"] or []])
        for r in df.select("instance_id", "verdicts").collect()
    }


def arguments():
    return F.col("verifiers"), F.col("completions")


def test_cells_give_the_same_verdicts(spark):
    df = mixed(spark).filter("instance_id <> 63")
    plain = run_verifiers(df, *arguments(), allow_execution=True)
    for cost in (20_000, cells.CELL_COST):
        balanced = run_balanced(df, *arguments(), partitions=4, allow_execution=True, cell_cost=cost)
        assert balanced.columns == plain.columns
        assert matrices(balanced) == matrices(plain)


def test_a_huge_instance_is_every_tasks_work(spark):
    rows = mixed(spark).select(F.col("instance_id").cast("string").alias("row_id"), F.col("verifiers").alias("sources"),
                               F.col("completions").alias("inputs"))
    made = cut_cells(rows, 40_000)
    assert made.agg(F.max("cost")).first()[0] <= 40_000
    dealt = deal(made, 8).withColumn("task", F.spark_partition_id())
    loads = {r["task"]: (r["cost"], r["huge"]) for r in dealt.groupBy("task").agg(
        F.sum("cost").alias("cost"), F.count_if(F.col("row_id") == "0").alias("huge")).collect()}
    assert sorted(loads) == list(range(8)) and all(huge for _, huge in loads.values())
    costs = [c for c, _ in loads.values()]
    assert max(costs) <= 1.1 * sum(costs) / 8
    assert dealt.select(F.sum(F.size("sources") * F.size("inputs"))).first() == rows.select(
        F.sum(F.size("sources") * F.size("inputs"))).first()


def test_cells_over_a_limit_drop_the_instance(spark):
    df = spark.createDataFrame([(1, [SOURCES[0], ENDLESS], ["abc"] * 30 + ["ab"]), (2, SOURCES[:1], ["a"])], SCHEMA)
    budget = Budget(seconds=0.3)
    options = dict(partitions=2, budget=budget, allow_execution=True, cell_cost=3 * CALL_BYTES)
    assert [r["instance_id"] for r in run_balanced(df, *arguments(), **options).collect()] == [2]
    kept = run_balanced(df, *arguments(), keep_timed_out=True, **options)
    assert matrices(kept)[1] == (True, [])
    with pytest.raises(PermissionError):
        run_balanced(df, *arguments(), partitions=2).collect()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=40), st.integers(1, 40))
def test_blocks_are_full_and_bounded(costs, limit):
    starts = blocks(np.array(costs), limit).tolist()
    parts = [costs[a:b] for a, b in zip(starts, [*starts[1:], len(costs)])]
    assert sum(parts, []) == costs and all(sum(p) <= limit or len(p) == 1 for p in parts)
    assert all(sum(p) + q[0] > limit for p, q in zip(parts, parts[1:]))


def test_buckets_go_to_the_emptiest_partition():
    placed = place({i: c for i, c in enumerate([9, 8, 7, 3, 2, 1])}, 3)
    loads = [sum([9, 8, 7, 3, 2, 1][b] for b, p in placed.items() if p == k) for k in range(3)]
    assert max(loads) == 10


def test_each_distinct_pair_is_judged_once(spark):
    df = mixed(spark).filter("instance_id <> 63")
    table = VerdictTable(spark, scratch_path(spark, "table"))
    plain = matrices(run_verifiers(df, *arguments(), allow_execution=True))
    pairs = {
        (v, t) for r in df.collect() for v in r["verifiers"] or [] for t in r["completions"] or []
    }
    judged, first = table.judge(df, *arguments(), allow_execution=True, cell_cost=50_000)
    assert matrices(judged) == plain and judged.columns == [*df.columns, "verdicts"]
    assert first.judged == len(pairs) < first.cells
    again, second = table.judge(df, *arguments(), allow_execution=True)
    assert second.judged == 0 and matrices(again) == plain
    assert table.rows().groupBy("verifier_key", "text_key").count().filter("count > 1").count() == 0
    # Another stage: other instances, some of whose pairs are known.
    other = spark.createDataFrame([(1, SOURCES[:2], ["xx0", "fresh"]), (2, [SOURCES[1]], ["fresh"])], SCHEMA)
    found, third = table.judge(other, *arguments(), allow_execution=True)
    assert (third.cells, third.distinct, third.judged) == (5, 4, 4)
    assert matrices(found) == matrices(run_verifiers(other, *arguments(), allow_execution=True))


def test_texts_are_written_once_whatever_their_verifiers(spark):
    rng = random.Random(5)
    sources = [f"def evaluate(response):\n    return len(response) % {n} == 0\n" for n in range(2, 10)]
    rows = [(i, sources, [rng.randbytes(10_000).hex() for _ in range(5)]) for i in range(10)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(2)
    with scratch_run(spark) as folder:
        judged, reuse = VerdictTable(spark, scratch_path(spark, "table")).judge(df, *arguments(), allow_execution=True)
        assert matrices(judged) == matrices(run_verifiers(df, *arguments(), allow_execution=True))
        assert reuse.judged == 400
        written = sum(f.stat().st_size for f in Path(folder.removeprefix("file:")).rglob("*.parquet"))
    assert written < 1.5 * 10 * 5 * 20_000


def test_instances_are_cut_into_parts_by_cost(spark):
    df = mixed(spark).filter("instance_id between 1 and 62")
    plain = matrices(run_verifiers(df, *arguments(), allow_execution=True))
    for cost in (1, 2 * CALL_BYTES, 5 * CALL_BYTES):
        judged, _ = VerdictTable(spark, scratch_path(spark, "table")).judge(
            df, *arguments(), allow_execution=True, partitions=3, cell_cost=cost
        )
        assert matrices(judged) == plain
    rows = spark.createDataFrame([(["v"] * 7, ["t"]), (["v"] * 3, ["t"] * 100), ([], ["t"]), (["v"], []), (["v"], ["t"])],
                                 "sources array<string>, texts array<string>").coalesce(1)
    parts = [tuple(r) for r in cut(rows, 3 * (CALL_BYTES + 1)).select("text_parts", "verifier_parts").collect()]
    assert parts == [(1, 3), (100, 1), (1, 1), (1, 1), (1, 1)]


def test_columns_are_not_written_twice(spark):
    df = spark.createDataFrame([(1, SOURCES[:1], ["a", None])], SCHEMA)
    for given, more in ((F.col("completions"), []), (df["completions"], []), (F.reverse("completions"), ["_inputs"])):
        named, own = cells.written_with(df, {"_sources": F.col("verifiers"), "_inputs": given}, "rows")
        assert named.columns == [*df.columns, *more, "row_id"]
        assert named.select(own["_inputs"]).first()[0] == df.select(given).first()[0]


def test_time_outs_in_the_table(spark):
    df = spark.createDataFrame([(1, [SOURCES[0], ENDLESS], ["abc", "ab"]), (2, [ENDLESS], ["abc"])], SCHEMA)
    table, budget = VerdictTable(spark, scratch_path(spark, "table")), Budget(seconds=0.3)
    judged, _ = table.judge(df, *arguments(), budget=budget, allow_execution=True)
    assert list(matrices(judged)) == [2]
    patient, reuse = table.judge(df, *arguments(), budget=Budget(seconds=0.3, timeout_as_false=True), allow_execution=True)
    assert reuse.judged == 0 and matrices(patient)[1][1][1] == (True, [5, TIMEOUT])
    with pytest.raises(PermissionError):
        table.judge(df, *arguments())


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 64, 100, 1000, 4097])
def test_every_epoch_is_a_permutation(spark, n):
    at = permuted(F.col("id"), F.lit(n).cast("bigint"), 7, F.col("epoch"))
    rows = spark.range(n).withColumn("epoch", F.explode(F.array(F.lit(0), F.lit(1)))).select("epoch", "id", at.alias("at")).collect()
    orders = [[r["at"] for r in sorted(rows, key=lambda r: r["id"]) if r["epoch"] == e] for e in (0, 1)]
    assert all(sorted(order) == list(range(n)) for order in orders)
    if n >= 64:
        assert orders[0] != orders[1] and orders[0] != list(range(n))
        assert sum(a == i for i, a in enumerate(orders[0])) < 10


def test_epochs_are_cut_into_full_batches(spark):
    rows = materialise(spark.range(101).select(F.col("id").alias("instance_id"), (F.col("id") % 3).alias("pair_idx")), "rows")
    batched = epoch_batches(rows, 8, 3)
    assert batched.columns == ["instance_id", "pair_idx", "epoch", "batch_id", "batch_pos"]
    sizes = batched.groupBy("epoch", "batch_id").agg(F.count("*").alias("n"), F.countDistinct("batch_pos").alias("d")).collect()
    assert len(sizes) == 3 * 13 and all(r["n"] == r["d"] == (8 if r["batch_id"] < 12 else 5) for r in sizes)
    plan = batched._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(_bucket") + plan.count("Exchange hashpartitioning(epoch") <= 2
    assert epoch_batches(materialise(rows.limit(0), "none"), 8, 3).collect() == []


def test_merging_replaces_the_target_only_when_whole(spark, tmp_path):
    folder = tmp_path / "set-b.jsonl"
    folder.mkdir()
    (folder / "part-1").write_text('{"instance_id":3}')
    (folder / "part-0").write_text('{"instance_id":2}\n')
    (folder / "_SUCCESS").write_text("")
    (folder / ".part-0.crc").write_text("no line")
    (tmp_path / "set-a.jsonl").write_text('{"instance_id":1}')
    (tmp_path / "set-c.jsonl").write_text("")
    (tmp_path / "set.jsonl").write_text("old")
    merged = jsonl.merge_shards(spark, str(tmp_path / "set"))
    assert (tmp_path / "set.jsonl").read_text() == "".join(f'{{"instance_id":{i}}}\n' for i in (1, 2, 3))
    assert jsonl.read_jsonl(spark, merged, "instance_id INT").count() == 3
    (tmp_path / "set-d.jsonl").write_text("x")
    (tmp_path / "set-d.jsonl").chmod(0)
    import os
    if os.geteuid():
        with pytest.raises(Exception):
            jsonl.merge_shards(spark, str(tmp_path / "set"))
        assert (tmp_path / "set.jsonl").read_text().count("\n") == 3
    with pytest.raises(FileNotFoundError):
        jsonl.merge_shards(spark, str(tmp_path / "nothing"))
    (tmp_path / "other.jsonl").mkdir()
    (tmp_path / "other-1.jsonl").write_text("{}\n")
    with pytest.raises((FileExistsError, PySparkException)):
        jsonl.merge_shards(spark, str(tmp_path / "other"))
    assert not [p for p in tmp_path.iterdir() if p.name.startswith(".other") and not p.name.endswith(".crc")]
