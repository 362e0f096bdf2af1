import hashlib
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from prefmill.functions import chat
from prefmill.operators.generation import (
    Patience, SamplingOptions, flaky, generate, generate_in_flight, micro_batches, replay, template_backend,
)
from prefmill.operators.sampling import collect_samples


def test_micro_batches_recut_any_stream():
    for sizes in ([3, 0, 10, 1], [8], [1] * 17, [], [16], [25, 2]):
        at, batches = 0, []
        for n in sizes:
            batches.append(pa.record_batch({"x": list(range(at, at + n))}))
            at += n
        cut = [t.column("x").to_pylist() for t in micro_batches(iter(batches), 8)]
        assert [x for b in cut for x in b] == list(range(at))
        assert all(len(b) == 8 for b in cut[:-1]) and all(0 < len(b) <= 8 for b in cut)


def test_backend_sees_rows_in_batches_and_answers_in_order(spark):
    def factory(options):
        def backend(requests):
            keys = {k for k, _, _ in requests}
            return [f"{k}/{i}/{p}/{len(keys)}/{options.max_tokens}" for k, i, p in requests]
        return backend

    df = spark.range(11).coalesce(1).select(
        F.col("id").alias("instance_id"),
        F.transform(F.sequence(F.lit(0), F.pmod("id", F.lit(3)).cast("int")),
                    lambda i: F.concat(F.lit("p"), i.cast("string"))).alias("prompts"),
        F.array(F.struct(F.col("id").alias("a"))).alias("kept"),
    )
    out = generate(df, factory, SamplingOptions(max_tokens=9), batch_size=4)
    assert out.columns == ["instance_id", "kept", "texts"]
    rows = sorted(out.collect())
    for r in rows:
        k = r["instance_id"]
        batch = 4 if k < 8 else 3
        assert r["texts"] == [f"{k}/{i}/p{i}/{batch}/9" for i in range(k % 3 + 1)]
        assert r["kept"][0]["a"] == k


def test_template_backend_does_not_depend_on_partitions(spark):
    df = spark.range(30).select(
        F.col("id").alias("instance_id"), F.array(F.lit("a"), F.lit("b")).alias("prompts"))
    options = SamplingOptions(seed=3)
    one = generate(df.coalesce(1), template_backend("{n}!"), options, batch_size=7).collect()
    two = generate(df, template_backend("{n}!"), options, partitions=5).collect()
    assert sorted(one) == sorted(two)
    first = int(hashlib.md5(b"3:0:1:b").hexdigest()[:15], 16) % 90 + 10
    assert sorted(one)[0]["texts"][1] == f"{first}!"


def test_no_prompts_no_texts(spark):
    df = spark.createDataFrame([(1, []), (2, None)], "instance_id int, prompts array<string>")
    out = generate(df, template_backend("{n}"))
    assert [r["texts"] for r in sorted(out.collect())] == [[], []]


def test_replay_with_a_hot_prompt(spark):
    prompts = spark.range(600).select(
        "id", F.when(F.col("id") % 3 == 0, "same").otherwise(F.concat(F.lit("p"), "id")).alias("prompt"),
        F.lit(0).alias("sample_idx"))
    recorded = prompts.select(F.md5("prompt").alias("prompt_md5"), "sample_idx").distinct()
    recorded = recorded.withColumn("text", F.concat(F.lit("t-"), "prompt_md5"))
    rows = replay(prompts, recorded, "id", hot_rows=50).collect()
    assert len(rows) == 600
    assert all(r["text"] == "t-" + hashlib.md5(r["prompt"].encode()).hexdigest() for r in rows)


def text_of(spark, expression):
    return spark.range(1).select(expression.alias("t")).first()["t"]


def test_rendering(spark):
    style = chat.ChatStyle("B", "(", ")", "|")
    messages = F.array(chat.message("user", F.lit("hi")), chat.message("assistant", F.lit("yo")))
    assert text_of(spark, chat.render_chat(messages, style)) == "B(user)hi|(assistant)yo|"
    assert text_of(spark, chat.ask(F.lit("hi"), style)) == "B(user)hi|(assistant)"


def test_fill_takes_slots_literally(spark):
    out = text_of(spark, chat.fill("{a}-{b}-{a}{c}", a=F.lit("{b}"), b="x"))
    assert out == "{b}-x-{b}{c}"


@pytest.mark.parametrize("builder,ending", [
    (lambda q: chat.instruction_prompt(q, "SEEDS"), "\nQuery: Why?\nInstruction:"),
    (lambda q: chat.verifier_prompt(q, F.lit("Be short.")),
     "```def evaluate(response: str) -> bool:"),
    (lambda q: chat.test_case_prompt(q, F.lit("Be short."), F.lit("code")), '{"response": "'),
    (lambda q: chat.completion_prompt(q, F.lit("Be short."), F.lit("code")),
     "<|start_header_id|>assistant<|end_header_id|>\n\n"),
])
def test_prompts(spark, builder, ending):
    out = text_of(spark, builder(F.lit("Why?")))
    assert out.startswith("<|begin_of_text|><|start_header_id|>user") and out.endswith(ending)
    assert "Why?" in out


def test_three_turn_prompt_quotes_the_verifier(spark):
    out = text_of(spark, chat.test_case_prompt(F.lit("Why?"), F.lit("Be short."), F.lit("CODE")))
    assert out.count("<|eot_id|>") == 3 and "```\nCODE```<|eot_id|>" in out


def test_training_prompt(spark):
    assert text_of(spark, chat.training_prompt(F.lit("q"), F.lit("i"))) == "q\ni"


def test_replay_keeps_what_was_not_recorded(spark):
    prompts = spark.createDataFrame([("p", i) for i in range(3)] + [("q", i) for i in range(3)], "prompt string, sample_idx int")
    recorded = spark.createDataFrame([("p", 0, "a"), ("p", 2, "c")], "prompt string, sample_idx int, text string")
    recorded = recorded.select(F.md5("prompt").alias("prompt_md5"), "sample_idx", "text")
    with pytest.raises(Exception, match="not recorded"):
        replay(prompts, recorded, "sample_idx").collect()
    found = replay(prompts, recorded, "sample_idx", missing="null")
    folded = collect_samples(found, "prompt", count=3)
    assert {r["prompt"]: r["texts"] for r in folded.collect()} == {"p": ["a", None, "c"], "q": [None] * 3}
    fewer = collect_samples(found.filter("text IS NOT NULL"), "prompt", count=3)
    assert [r["texts"] for r in fewer.collect()] == [["a", None, "c"]]


def test_no_hot_rows_allowed(spark):
    prompts = spark.createDataFrame([("p", 0)], "prompt string, sample_idx int")
    recorded = prompts.select(F.md5("prompt").alias("prompt_md5"), "sample_idx", F.lit("t").alias("text"))
    assert replay(prompts, recorded, "sample_idx", hot_rows=0).first()["text"] == "t"


def answering(wait=0.0, fails=lambda request: False):
    def factory(options):
        return lambda requests: [f"{k}/{i}/{p}" for k, i, p in requests]

    return flaky(factory, fails, wait)


def asked(spark, n):
    return spark.range(n).coalesce(1).select(
        F.col("id").alias("instance_id"),
        F.when(F.col("id") % 7 > 0, F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.concat(F.lit("p"), (i % 2).cast("string")))).alias("prompts"),
        F.struct("id").alias("kept"),
    )


def test_requests_in_flight_give_the_same_rows_faster(spark):
    df = asked(spark, 60)
    seen = {}
    for in_flight in (1, 16):
        made = generate_in_flight(df, answering(0.02, lambda r: r.key % 5 == 0), in_flight=in_flight, retries="retries",
                                  patience=Patience(attempts=2, wait=0.0))
        started = time.time()
        rows = made.collect()
        seen[in_flight] = rows, time.time() - started
    (slow, slow_time), (fast, fast_time) = seen[1], seen[16]
    assert slow == fast and [r["instance_id"] for r in fast] == list(range(60))  # in order
    assert fast_time < slow_time / 2
    for r in fast:
        k = r["instance_id"]
        assert r["texts"] == ([f"{k}/{i}/p{i % 2}" for i in range(4)] if k % 7 else [])
        assert r["retries"] == (2 if k % 5 == 0 and k % 7 else 0) and r["kept"]["id"] == k


def test_one_request_holds_all_samples_of_a_prompt(spark):
    def factory(options):
        return lambda request: [f"{len(request.samples)}"] * len(request.samples)

    rows = generate_in_flight(asked(spark, 3), factory).collect()
    assert [r["texts"] for r in rows] == [[], ["2"] * 4, ["2"] * 4]


def test_requests_that_keep_failing(spark):
    def broken(options):
        def answer(request):
            if request.key == 2 and request.prompt == "p1":
                raise ConnectionError("gone")
            return [request.prompt] * len(request.samples)
        return answer

    patience = Patience(attempts=2, wait=0.0)
    with pytest.raises(Exception, match="gone"):
        generate_in_flight(asked(spark, 4), broken, patience=patience).collect()
    rows = generate_in_flight(asked(spark, 4), broken, patience=patience, missing="null", retries="n").collect()
    assert rows[2]["texts"] == ["p0", None, "p0", None] and rows[2]["n"] == 2 and rows[3]["n"] == 0
    short = lambda options: lambda request: []
    with pytest.raises(Exception, match="0 texts for 2 samples"):
        generate_in_flight(asked(spark, 2), short, patience=patience).collect()
    with pytest.raises(ValueError):
        generate_in_flight(asked(spark, 2), short, missing="skip")
