"""All stages in a row with a scripted backend, and the incremental run."""

import json

import pytest
from pyspark.sql import functions as F

from prefmill.operators import filtering
from prefmill.operators.verification import Budget
from prefmill.plans import catalog, fixtures, stages
from prefmill.session import with_stable_row_id
from prefmill.sources import dialogues, jsonl
from prefmill.streaming.incremental import run_incrementally


def scripted_backend():
    """Instruction, verifier, test cases or completion, told apart by the prompt's end."""

    def answer(request):
        key, sample, prompt = request
        if prompt.endswith("Instruction:"):
            return "" if key == 3 else "  Use at most 20 letters. \nQuery: next"
        if prompt.endswith("-> bool:"):
            body = ["len(response) <= 20", "len(response) <= 20", "1 +", "True"][sample]
            return f"\n    return {body}\n``` and more"
        if prompt.endswith('{"response": "'):
            return 'short", "result": true}\n{"response": "' + "long " * 9 + '", "result": false}'
        return ("tiny" if sample % 2 else "a much longer answer than allowed") + "<|eot_id|>tail"

    return lambda options: lambda requests: [answer(r) for r in requests]


def test_from_queries_to_padded_batches(spark):
    scripted = scripted_backend()
    queries = spark.createDataFrame([(i, f"question {i}") for i in range(5)], "qid int, query string")
    instructions = stages.build_instructions(queries, "qid", "SEEDS", 12, scripted)
    rows = {r["instance_id"]: r for r in instructions.collect()}
    assert len(rows) == 12 and rows[3]["instruction"] == ""
    assert rows[0]["instruction"] == "Use at most 20 letters."

    artifacts = stages.build_artifacts(instructions, 4, scripted).cache()
    first = artifacts.first()
    assert artifacts.count() == 11  # the empty instruction is gone
    assert first["verifiers"][0] == "def evaluate(response: str) -> bool:\n    return len(response) <= 20\n"
    assert first["testcases"][0].startswith('{"response": "short", "result": true}\n')

    with pytest.raises(PermissionError):
        stages.filter_artifacts(artifacts)
    kept, funnel = stages.filter_artifacts(artifacts, allow_execution=True)
    assert funnel.first().asDict() == {
        "verifier_count": 44, "testcase_str_count": 44, "compiled_verifiers": 33,
        "test_cases_parse": 88, "test_cases_pass_gte1": 88, "verifiers_pass_80pct": 22,
        "total_passes": 11 * (8 + 8 + 4), "unique_instances": 11,
    }
    completed = stages.build_completions(kept, 5, scripted)
    assert completed.first()["completions"] == [
        "a much longer answer than allowed", "tiny"] * 2 + ["a much longer answer than allowed"]
    scored, report = stages.score_completions(completed, allow_execution=True)
    assert report.first().asDict() == {
        "instances": 11, "pairs": 33, "unique_completions": 55, "unique_prompts": 11,
        "chosen_completions": 22, "rejected_completions": 33,
    }
    # repeated texts collapse in the scores, so pairing finds one pair per instance
    batches = stages.training_batches(scored, 4).collect()
    assert len(batches) == 11 and {r["batch_id"] for r in batches} == {0, 1, 2}


def test_incremental_run_resumes(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "state"))
    (tmp_path / "in").mkdir()

    def add(name, ids):
        lines = [json.dumps({
            "instance_id": i, "query": "q", "instruction": "i",
            "verifiers": ["def evaluate(response):\n    return True\n"],
            "testcases": ['{"response": "a", "result": true}'] if i % 2 else ["bad"],
        }) for i in ids]
        (tmp_path / "in" / name).write_text("\n".join(lines))

    def stage(df):
        return filtering.filtered_instances(
            filtering.weigh(filtering.judge_test_cases(df, allow_execution=True)))

    add("a.jsonl", range(10))
    assert run_incrementally(spark, source, jsonl.ARTIFACTS, stage, target, checkpoint) == 10
    add("b.jsonl", range(10, 14))
    assert run_incrementally(spark, source, jsonl.ARTIFACTS, stage, target, checkpoint) == 4
    assert run_incrementally(spark, source, jsonl.ARTIFACTS, stage, target, checkpoint) == 0
    done = spark.read.parquet(target)
    assert sorted(r["instance_id"] for r in done.collect()) == [1, 3, 5, 7, 9, 11, 13]
    assert done.select(F.explode("test_cases.response")).distinct().count() == 1


def test_every_trigger_is_counted(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(115):
        (tmp_path / "in" / f"{i}.jsonl").write_text(json.dumps({"instance_id": i}))
    paths = [str(tmp_path / n) for n in ("in", "out", "state")]
    assert run_incrementally(
        spark, paths[0], "instance_id BIGINT", lambda df: df, paths[1], paths[2], files_per_trigger=1
    ) == 115
    assert spark.read.parquet(paths[1]).count() == 115


def test_both_rounds_use_the_generators_asked_for(spark):
    instructions = spark.createDataFrame([(i, "q", "i") for i in range(40)], "instance_id int, query string, instruction string")
    backend = scripted_backend()
    artifacts = stages.build_artifacts(instructions, 2, backend, partitions=7)
    assert artifacts.rdd.getNumPartitions() == 7


def test_only_what_is_read_is_written_of_the_verdicts(spark):
    rows = [(1, "q", "i", ["def evaluate(response):\n    return True\n"], ['{"response": "a", "result": true}'])]
    kept, funnel = stages.filter_artifacts(spark.createDataFrame(rows, jsonl.ARTIFACTS), allow_execution=True)
    written = spark.read.parquet(kept.inputFiles()[0].rpartition("/")[0])
    assert written.columns == [
        "instance_id", "query", "instruction", "kept_verifiers", "kept_cases", "kept", *jsonl.COUNTERS
    ]
    assert funnel.first()["unique_instances"] == 1


def test_pairs_do_not_work_out_labels_twice(spark):
    plan = catalog.pairs(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("struct(chosen, filter(") == 1  # relabelled from the scores, and not labelled before
    batched = stages.shuffled_batches(catalog.pairs(spark, "/root/testdata/sf0.001"), 8)
    plan = stages.pad_batches(stages.token_views(batched))._jdf.queryExecution().optimizedPlan().toString()
    assert "attention_mask" not in plan[plan.index("Window"):]


def test_instances_over_the_limit_count_as_input_only(spark):
    loop = "def evaluate(response):\n    while True:\n        pass\n"
    good = "def evaluate(response):\n    return response == 'a'\n"
    rows = [(i, "q", "i", [good, loop] if i == 2 else [good], ["a", "b"]) for i in range(5)]
    completed = spark.createDataFrame(
        rows, "instance_id int, query string, instruction string, verifiers array<string>, "
        "completions array<string>")
    budget = Budget(seconds=0.3)
    scored, report = stages.score_completions(completed, budget, allow_execution=True)
    assert sorted(r["instance_id"] for r in scored.collect()) == [0, 1, 3, 4]
    assert report.first().asDict() == {
        "instances": 5, "pairs": 4, "unique_completions": 8, "unique_prompts": 4,
        "chosen_completions": 4, "rejected_completions": 4,
    }
    patient = Budget(seconds=0.3, timeout_as_false=True)
    scored, _ = stages.score_completions(completed, patient, allow_execution=True)
    slow = scored.filter("instance_id = 2").first()
    assert [tuple(s) for s in slow["scores"]] == [("a", 0.5), ("b", 0.0)]


def test_no_rows_at_all(spark):
    empty = spark.createDataFrame(
        [], "instance_id int, query string, instruction string, verifiers array<string>, "
        "completions array<string>")
    scored, report = stages.score_completions(empty, allow_execution=True)
    assert set(report.first().asDict().values()) == {0}
    assert stages.training_batches(scored, 4).collect() == []


def test_queries_from_a_file_without_keys(spark, tmp_path):
    path = tmp_path / "hh.jsonl"
    path.write_text("\n".join(
        json.dumps({"chosen": f"\n\nHuman: question {i % 2}?\n\nAssistant: x"}) for i in range(9)))
    queries = with_stable_row_id(dialogues.load_queries(spark, "hh", str(path)), "queries")
    drawn = stages.build_instructions(queries, "row_id", "SEEDS", 40, scripted_backend())
    rows = drawn.collect()
    assert sorted(r["instance_id"] for r in rows) == list(range(40))
    assert {r["query"] for r in rows} == {"question 0?", "question 1?"}


def test_completions_are_not_moved_again_to_their_conversation(spark):
    other = spark.newSession()
    other.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = fixtures.completed_instances(other, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(doc_id" in plan and "Exchange hashpartitioning(instance_id" not in plan
