import json
from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from prefmill.session import materialise, scratch_root, scratch_run, with_stable_row_id
from prefmill.sources import dialogues, jsonl


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_seed_blob_is_unchanged(spark, tmp_path):
    text = "Query: a\nInstruction: b\n\nQuery: {c} 'é'\nInstruction: \"d\""
    assert dialogues.read_seed_blob(spark, write(tmp_path / "seeds.txt", text)) == text
    write(tmp_path / "other.txt", "x")
    with pytest.raises(ValueError):
        dialogues.read_seed_blob(spark, str(tmp_path))


def test_delimited_source(spark, tmp_path):
    rows = ["\n\nHuman: What is it?\n\nAssistant: That.", "no marker at all", "\n\nHuman: four",
            "\n\nHuman: What is it?\n\nAssistant: Dup", "\n\nHuman: " + "x" * 201 + "\n\nAssistant: a"]
    path = write(tmp_path / "hh.jsonl", "\n".join(json.dumps({"chosen": r, "rejected": "z"}) for r in rows))
    got = dialogues.load_queries(spark, "hh", path)
    assert got.columns == ["query"]
    assert [r["query"] for r in got.collect()] == ["What is it?", "What is it?"]


def test_message_source(spark, tmp_path):
    rows = [
        {"id": "a", "conversations": [{"from": "human", "value": "Hello there"}, {"from": "gpt", "value": "x"}]},
        {"id": "b", "conversations": [{"from": "system", "value": "Be a system"}]},
        {"id": "c", "conversations": []}, {"id": "d"},
        {"id": "e", "conversations": [{"from": "human", "value": ""}]},
        {"id": "f", "conversations": [{"from": "human", "value": "four"}]},
    ]
    path = write(tmp_path / "share.json", json.dumps(rows, indent=1))
    got = dialogues.load_queries(spark, "sharegpt", path)
    assert [r["query"] for r in got.collect()] == ["Hello there", "Be a system"]
    with pytest.raises(ValueError):
        dialogues.load_queries(spark, "other", path)


def test_opening_equals_the_whole_dialogue(spark):
    turns = [
        (1, 0, "system", "sys"), (1, 1, "user", "one"), (1, 2, "assistant", "two"),
        (2, 5, "assistant", "late\n"), (2, 9, "user", "x"), (2, 3, "user", "tricky\n\nHuman: inside"),
        (3, 0, "user", "ends with Human\n\nHuman:"), (3, 1, "assistant", " y"),
        (4, 0, "system", "only"),
    ]
    df = spark.createDataFrame(turns, "conv_id int, turn int, role string, text string")
    got = {r["conv_id"]: r["query"] for r in dialogues.delimited_queries(
        dialogues.delimited_openings(df), keep=("conv_id",), low=0).collect()}
    whole = {}
    for conv, _, role, text in sorted(turns):
        if role != "system":
            marker = "\n\nHuman: " if role == "user" else "\n\nAssistant: "
            whole[conv] = whole.get(conv, "") + marker + text
    wide = spark.createDataFrame(list(whole.items()), "conv_id int, chosen string")
    expected = {r["conv_id"]: r["query"] for r in
                dialogues.delimited_queries(wide, keep=("conv_id",), low=0).collect()}
    assert got == expected and set(got) == {1, 2, 3}


def test_hot_conversation_is_combined_before_the_shuffle(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") < 1000, 7).otherwise(F.col("id")).alias("conv_id"),
        (-F.col("id")).alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    plan = dialogues.opening_turns(df)._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan and "collect" not in plan
    rows = {r["conv_id"]: r["text"] for r in dialogues.opening_turns(df).collect()}
    assert rows[7] == "999" and len(rows) == 2001


def test_malformed_line_stops_the_scan(spark, tmp_path):
    path = write(tmp_path / "bad.jsonl", '{"instance_id": 1, "query": "a", "instruction": "b"}\n{"oops\n')
    with pytest.raises(Exception):
        jsonl.read_jsonl(spark, path, jsonl.INSTRUCTIONS).collect()


def test_filtered_rows_round_trip(spark, tmp_path):
    rows = [(1, "q é", "i", ["v\n"], [('say "hi"\n\\', True), ("", False)], *range(8)),
            (2, None, "i", [], [], *range(8))]
    schema = jsonl.FILTERED.replace("ARRAY<ARRAY<STRING>>", "ARRAY<STRUCT<response: STRING, result: BOOLEAN>>")
    df = spark.createDataFrame(rows, schema)
    path = str(tmp_path / "filtered.jsonl")
    jsonl.write_jsonl(df, path)
    raw = [json.loads(r["value"]) for r in spark.read.text(path).collect()]
    raw.sort(key=lambda r: r["instance_id"])
    assert raw[0]["test_cases"] == [['say "hi"\n\\', True], ["", False]]
    assert raw[0]["verifiers"] == ["v\n"] and raw[1]["query"] is None
    back = jsonl.read_jsonl(spark, path, jsonl.FILTERED)
    assert sorted(map(str, back.select(df.columns).collect())) == sorted(map(str, df.collect()))


def test_scored_rows_round_trip(spark, tmp_path):
    rows = [(1, "q", "i", ["v"], ["b"], ["a"], [("b", 1.0), ("a", 0.0), ("c", 0.25)])]
    schema = jsonl.SCORED.replace("MAP<STRING,DOUBLE>", "ARRAY<STRUCT<completion: STRING, score: DOUBLE>>")
    path = str(tmp_path / "scored.jsonl")
    jsonl.write_jsonl(spark.createDataFrame(rows, schema), path)
    raw = json.loads(spark.read.text(path).first()["value"])
    assert list(raw["scores"].items()) == [("b", 1.0), ("a", 0.0), ("c", 0.25)]
    back = jsonl.read_jsonl(spark, path, jsonl.SCORED).first()
    assert [tuple(s) for s in back["scores"]] == rows[0][-1]


def test_writing_replaces(spark, tmp_path):
    path = str(tmp_path / "out.jsonl")
    for n in (3, 2):
        jsonl.write_jsonl(spark.range(n), path)
    assert jsonl.read_jsonl(spark, path, "id BIGINT").count() == 2


def test_unterminated_shards_do_not_fuse(spark, tmp_path):
    write(tmp_path / "part-0.jsonl", '{"id": 1}\n{"id": 2}')
    write(tmp_path / "part-1.jsonl", '{"id": 3}\n')
    write(tmp_path / "part-2.jsonl", "")
    write(tmp_path / "other.jsonl", '{"id": 9}\n')
    target = jsonl.merge_shards(spark, str(tmp_path / "part"))
    assert target == str(tmp_path / "part.jsonl")
    assert sorted(r["id"] for r in jsonl.read_jsonl(spark, target, "id BIGINT").collect()) == [1, 2, 3]


def test_scratch_is_the_configured_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    assert scratch_root(spark) == root
    df = materialise(spark.range(5), "five")
    assert f"{root}/prefmill/five-" in df.inputFiles()[0] and df.count() == 5


def test_row_ids_are_unique_and_stable(spark):
    df = with_stable_row_id(spark.range(100).select(F.lit("same").alias("query")).repartition(5), "ids")
    one, two = (sorted(r["row_id"] for r in df.collect()) for _ in range(2))
    assert one == two and len(set(one)) == 100


def test_malformed_dialogues_stop_the_job(spark, tmp_path):
    write(tmp_path / "hh.jsonl", '{"chosen": "\\n\\nHuman: a question\\n\\nAssistant: x"}\n{"chosen": \n')
    write(tmp_path / "cut.json", '[{"conversations": [{"from": "human", "value": "a question"}]}, {"conv')
    for name, path in (("hh", "hh.jsonl"), ("sharegpt", "cut.json")):
        with pytest.raises(Exception, match="(?i)malformed"):
            dialogues.load_queries(spark, name, str(tmp_path / path)).collect()


def test_message_lists_as_lines(spark, tmp_path):
    lists = [{"conversations": [{"from": "human", "value": f"question {i}"}]} for i in range(3)]
    write(tmp_path / "lines.json", "\n".join(map(json.dumps, lists)))
    found = dialogues.load_queries(spark, "sharegpt", str(tmp_path / "lines.json"), lines=True)
    assert sorted(r["query"] for r in found.collect()) == ["question 0", "question 1", "question 2"]


def test_test_cases_alone_are_valid_json(spark, tmp_path):
    df = spark.createDataFrame([([("a", True)],)], "test_cases array<struct<response:string,result:boolean>>")
    path = str(tmp_path / "alone.jsonl")
    jsonl.write_jsonl(df, path)
    assert json.loads(spark.read.text(path).first()["value"]) == {"test_cases": [["a", True]]}


def test_no_scratch_folder_is_made_up():
    class Unset:
        class conf:
            @staticmethod
            def get(name):
                raise PySparkException("unset")

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_root(Unset)


def test_a_run_removes_its_scratch(spark):
    with scratch_run(spark) as folder:
        df = materialise(spark.range(5), "five")
        assert folder in df.inputFiles()[0]
        assert spark.read.parquet(f"{folder}/five-*").count() == 5
    assert not Path(folder.removeprefix("file:")).exists()
    assert folder not in materialise(spark.range(1), "one").inputFiles()[0]


@pytest.mark.parametrize("length", [60_000, 5_000_000, 25_000_000])
def test_completions_of_any_length_round_trip(spark, tmp_path, length):
    """They are names in the score object, and values in the label lists and test cases."""
    long = F.concat(F.lit('"\\\n '), F.repeat(F.lit("é"), length))
    scored = spark.range(1).select(
        F.col("id").alias("instance_id"), F.lit("q").alias("query"), F.lit("i").alias("instruction"),
        F.array(F.lit("v")).alias("verifiers"), F.array(long).alias("chosen"), F.array(F.lit("b")).alias("rejected"),
        F.array(F.struct(long.alias("completion"), F.lit(1.0).alias("score")),
                F.struct(F.lit("b").alias("completion"), F.lit(0.0).alias("score"))).alias("scores"),
    )
    jsonl.write_jsonl(scored, str(tmp_path / "scored"))
    back = jsonl.read_jsonl(spark, str(tmp_path / "scored"), jsonl.SCORED)
    assert back.filter(F.size("scores") == 2).exceptAll(scored).count() == 0 and back.count() == 1
    filtered = scored.select(
        "instance_id", "query", "instruction", "verifiers",
        F.array(F.struct(long.alias("response"), F.lit(True).alias("result"))).alias("test_cases"),
        *[F.lit(1).alias(c) for c in jsonl.COUNTERS],
    )
    jsonl.write_jsonl(filtered, str(tmp_path / "filtered"))
    back = jsonl.read_jsonl(spark, str(tmp_path / "filtered"), jsonl.FILTERED)
    assert back.filter(F.get("test_cases", 0)["response"] == long).count() == 1


GOOD = '{"instance_id":1,"query":"q","verifiers":["v"],"scores":{"b":1,"a":0.5,"b":0.25},"other":[1]}'


@pytest.mark.parametrize("line", [
    '{"instance_id":1,"scores":{"a":1.0}', '{"instance_id":"one"}', '{"instance_id":true}', '{"scores":{"a":"x"}}', '[1]', "7",
    '{"scores":[1]}', '{"verifiers":"v"}', "{'instance_id':1}", '{"instance_id":1} trailing',
])
def test_a_broken_scored_line_stops_the_scan(spark, tmp_path, line):
    path = write(tmp_path / "scored.jsonl", f"{GOOD}\n{line}\n")
    with pytest.raises(PySparkException, match="malformed line"):
        jsonl.read_jsonl(spark, path, jsonl.SCORED).collect()


def test_scored_lines_keep_order_and_tolerate_blanks(spark, tmp_path):
    lines = [GOOD, "", "   ", "{}", '{"query":{"a":1},"scores":{"\\ud800x":1}}', "null"]
    rows = jsonl.read_jsonl(spark, write(tmp_path / "scored.jsonl", "\n".join(lines)), jsonl.SCORED).collect()
    assert [(s["completion"], s["score"]) for s in rows[0]["scores"]] == [("b", 0.25), ("a", 0.5)]
    assert rows[1]["scores"] is None and rows[1]["instance_id"] is None
    assert rows[2]["query"] == '{"a":1}' and rows[2]["scores"][0]["completion"] == "�x"
    assert len(rows) == 4


def test_types_without_a_reader_are_refused():
    with pytest.raises(TypeError):
        jsonl.value_reader(jsonl.T.MapType(jsonl.T.LongType(), jsonl.T.LongType()))
    with pytest.raises(TypeError):
        jsonl.value_reader(jsonl.T.StructType.fromDDL("d DATE"))


def test_lines_are_parsed_a_few_at_a_time(spark):
    import pyarrow as pa

    class Lines:
        """Stands for a table of lines; hands out what Spark would run."""

        sparkSession = spark

        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            return run

    lines = [json.dumps({"instance_id": i, "scores": {f"{i}" * 200: 0.5}}) for i in range(4000)]
    run = jsonl.parse_lines(Lines(), "instance_id BIGINT, scores MAP<STRING,DOUBLE>")
    made = list(run(iter([pa.RecordBatch.from_pydict({"value": [*lines, " ", None]})])))
    assert [i for batch in made for i in batch.column(0).to_pylist()] == list(range(4000))
    assert max(batch.nbytes for batch in made) <= 1 << 20
