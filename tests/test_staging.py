"""Stages that end in time, and totals gathered while writing."""

import json
import subprocess
import sys
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from prefmill.operators import filtering
from prefmill.operators.staging import observed
from prefmill.operators.verification import Budget, Clock, VerifierProcess, run_verifiers
from prefmill.plans import stages
from prefmill.sources import jsonl

ENDLESS = "def evaluate(response):\n    while True:\n        pass\n"
GOOD = "def evaluate(response):\n    return len(response) < 3\n"
CASES = ['{"response": "ab", "result": true}', '{"response": "abcd", "result": false}']


def artifacts(spark, n, endless=lambda i: i % 10 == 0):
    rows = [(i, "q", "i", [GOOD, ENDLESS] if endless(i) else [GOOD, GOOD], CASES) for i in range(n)]
    return spark.createDataFrame(rows, jsonl.ARTIFACTS).repartition(4)


def test_a_stage_ends_within_its_budget(spark):
    """Endless verifiers that no limit of their own stops: their instances are dropped and counted."""
    df = artifacts(spark, 120)
    stages.run_filter(artifacts(spark, 8, lambda i: False), Budget(), allow_execution=True)  # starts the workers
    started = time.time()
    run = stages.run_filter(df, Budget(seconds=600, instance_seconds=None, stage_seconds=24), allow_execution=True)
    assert time.time() - started < 24 + 12  # what ends the last job
    assert run.totals["unfinished"] == 12 and run.totals["finished"] == 108 and run.totals["timed_out"] == 0
    assert run.rounds > 1
    whole = filtering.weigh(filtering.judge_test_cases(df.filter("instance_id % 10 > 0"), allow_execution=True))
    columns = ["instance_id", *jsonl.COUNTERS]
    assert sorted(run.rows.select(columns).collect()) == sorted(whole.select(columns).collect())
    assert {c: run.totals[c] for c in jsonl.COUNTERS} == filtering.funnel(whole).first().asDict()


def test_no_round_is_added_when_all_is_done(spark):
    run = stages.run_filter(artifacts(spark, 20, lambda i: False), Budget(stage_seconds=600), allow_execution=True)
    assert run.rounds == 1 and run.totals["finished"] == run.rows.count() == 20
    assert "_again" not in run.rows.columns and run.totals["unfinished"] == 0


def test_own_limits_and_the_stage_limit_are_told_apart(spark):
    df = artifacts(spark, 20)
    run = stages.run_filter(df, Budget(seconds=0.3, stage_seconds=120), allow_execution=True)
    assert (run.totals["finished"], run.totals["timed_out"], run.totals["unfinished"]) == (18, 2, 0)
    patient = Budget(seconds=0.3, timeout_as_false=True, stage_seconds=120)
    assert stages.run_filter(df, patient, allow_execution=True).totals["finished"] == 20


def test_scoring_stage_counts_what_it_drops(spark):
    rows = [(i, "q", "i", [GOOD, ENDLESS] if i == 3 else [GOOD], ["a", "abcd"]) for i in range(8)]
    df = spark.createDataFrame(
        rows, "instance_id int, query string, instruction string, verifiers array<string>, completions array<string>")
    budget = Budget(seconds=600, instance_seconds=None, stage_seconds=16)
    scored, report = stages.score_completions(df, budget, allow_execution=True)
    assert sorted(r["instance_id"] for r in scored.collect()) == [0, 1, 2, 4, 5, 6, 7]
    assert report.first().asDict() == {
        "instances": 8, "pairs": 7, "unique_completions": 14, "unique_prompts": 7,
        "chosen_completions": 7, "rejected_completions": 7,
    }


def test_late_rows_go_unless_kept(spark):
    df = artifacts(spark, 4)
    args = (F.col("verifiers"), F.array(F.lit("a")))
    past = Clock(time.time() - 1)
    assert run_verifiers(df, *args, allow_execution=True, clock=past).count() == 0
    kept = run_verifiers(df, *args, allow_execution=True, clock=past, keep_timed_out=True).collect()
    assert len(kept) == 4 and all(r["verdicts"]["late"] and r["verdicts"]["matrix"] is None for r in kept)


def test_the_deadline_stops_a_running_call():
    process = VerifierProcess(Budget(seconds=60, timeout_as_false=True))
    started = time.monotonic()
    assert process.judge([GOOD, ENDLESS], ["a"], time.monotonic() + 0.5)["late"]
    assert time.monotonic() - started < 5
    assert not process.judge([GOOD], ["a"], time.monotonic() + 30)["late"]
    process.close()


def test_no_rows_have_totals_too(spark):
    for empty in (spark.createDataFrame([], jsonl.ARTIFACTS), artifacts(spark, 5).filter("instance_id < 0")):
        for budget in (Budget(), Budget(stage_seconds=60)):
            kept, funnel = stages.filter_artifacts(empty, budget, allow_execution=True)
            assert kept.count() == 0 and set(funnel.first().asDict().values()) == {0}


def test_observed_totals_come_with_the_rows(spark):
    written, found = observed(spark.range(100, numPartitions=5), "ids", {"n": F.count("id"), "s": F.sum("id")})
    assert found == {"n": 100, "s": 4950} and written.count() == 100


RETRIED = """
import json, sys
sys.path.insert(0, sys.argv[1])
from pyspark import TaskContext
from prefmill.operators.verification import Budget
from prefmill.plans import stages
from prefmill.session import build_session
from prefmill.sources import jsonl
from pyspark.sql import functions as F

spark = build_session("local[2,4]", scratch=sys.argv[2], **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "3"})
spark.sparkContext.setLogLevel("OFF")
good, cases = json.loads(sys.argv[3])
rows = [(i, "q", "i", [good, good], cases) for i in range(40)]
df = spark.createDataFrame(rows, jsonl.ARTIFACTS).repartition(4)

def failing(batches):
    # Every second task dies once, after it has handed on some rows.
    context = TaskContext.get()
    for i, batch in enumerate(batches):
        if i == 2 and context.partitionId() % 2 == 0 and context.attemptNumber() == 0:
            raise RuntimeError("lost")
        yield batch

from prefmill.operators.staging import run_stage
from prefmill.operators import filtering

def judge(frame, clock):
    judged = filtering.weigh(filtering.judge_test_cases(frame, Budget(), True, None, True, clock))
    return judged.mapInArrow(failing, judged.schema)

outputs = ["instance_id", *jsonl.COUNTERS]
run = run_stage(df, judge, outputs, filtering.funnel_totals(), Budget(stage_seconds=100), "weighed")
print(json.dumps({"totals": run.totals, "again": filtering.funnel(run.rows).first().asDict(), "rows": run.rows.count()}))
"""


def test_totals_are_right_after_retried_tasks(tmp_path):
    """In a session of its own, since tasks of a plain local one are not retried."""
    done = subprocess.run(
        [sys.executable, "-c", RETRIED, str(Path(__file__).resolve().parents[1]), str(tmp_path), json.dumps([GOOD, CASES])],
        capture_output=True, text=True, timeout=300,
    )
    assert done.returncode == 0, done.stderr[-2000:]
    found = json.loads(done.stdout.strip().splitlines()[-1])
    assert found["rows"] == 40 == found["totals"]["finished"] and found["totals"]["unfinished"] == 0
    assert found["again"] == {c: found["totals"][c] for c in jsonl.COUNTERS}
    assert found["again"]["unique_instances"] == 40


@pytest.mark.parametrize("broken", ["no_such_column"])
def test_failing_jobs_are_not_hidden(spark, broken):
    with pytest.raises(Exception):
        observed(spark.range(3).select(F.col("id") / F.raise_error(F.lit("x"))), "bad", {"n": F.count("*")})
