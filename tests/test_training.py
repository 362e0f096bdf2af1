import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from prefmill.functions.slices import SLICE_BYTES
from prefmill.functions.tokens import Vocabulary, hashed_tokenizer, python_tokenizer
from prefmill.operators import metrics, scorecards, shift
from prefmill.operators.batching import VIEWS, pad_batches, shuffled_batches, token_views

PAIRS = "instance_id int, pair_idx int, prompt string, chosen string, rejected string"


def pairs(spark, n):
    rng = random.Random(2)
    return spark.createDataFrame(
        [(i // 3, i % 3, f"ask {i}", "yes " * rng.randrange(1, 9), "no " * rng.randrange(1, 9))
         for i in range(n)], PAIRS,
    )


def test_views_are_whole_and_share_the_context(spark):
    rows = token_views(pairs(spark, 20)).collect()
    for r in rows:
        n = len(r["input_ids_context"])
        for v in ("chosen", "rejected"):
            assert r[f"input_ids_{v}"][:n] == r["input_ids_context"]
            assert r[f"attention_mask_{v}"] == [1] * len(r[f"input_ids_{v}"])
    marks = ["<|begin_of_text|>", "<|start_header_id|>", "user", "<|end_header_id|>", "ask"]
    assert rows[0]["input_ids_context"][:5] == [zlib.crc32(m.encode()) % 32000 for m in marks]


def test_python_tokenizer(spark):
    def factory():
        return lambda texts: [[len(w) for w in t.split()] for t in texts]

    df = spark.createDataFrame([("a bb ccc",), ("",)], "t string")
    got = df.select(python_tokenizer(factory)(F.col("t")).alias("ids")).collect()
    assert [r["ids"] for r in got] == [[1, 2, 3], []]
    got = df.select(hashed_tokenizer(vocabulary=10)(F.col("t")).alias("ids")).collect()
    assert [len(r["ids"]) for r in got] == [3, 0]


@pytest.mark.parametrize("n,size", [(50, 8), (16, 8), (3, 8), (1, 1)])
def test_batches_are_full_but_the_last(spark, n, size):
    rows = shuffled_batches(pairs(spark, n), size).collect()
    counts = {}
    for r in rows:
        counts.setdefault(r["batch_id"], []).append(r["batch_pos"])
    assert sorted(counts) == list(range(math.ceil(n / size)))
    for b, seen in counts.items():
        assert sorted(seen) == list(range(min(size, n - b * size)))


def test_order_depends_on_seed_and_epoch_only(spark):
    def order(**kw):
        df = shuffled_batches(pairs(spark, 60).repartition(kw.pop("parts", 3)), 8, **kw)
        return {(r["instance_id"], r["pair_idx"]): (r["batch_id"], r["batch_pos"]) for r in df.collect()}

    assert order() == order(parts=7)
    assert order() != order(epoch=1)
    assert order() != order(seed=7)


def test_left_padding_to_the_longest_of_the_batch(spark):
    views = token_views(shuffled_batches(pairs(spark, 30), 8)).cache()
    before = {(r["instance_id"], r["pair_idx"]): r for r in views.collect()}
    by_batch = {}
    for r in pad_batches(views, pad_id=-7).collect():
        raw = before[(r["instance_id"], r["pair_idx"])]
        for v in VIEWS:
            ids, missing = raw[f"input_ids_{v}"], len(r[f"input_ids_{v}"]) - len(raw[f"input_ids_{v}"])
            assert r[f"input_ids_{v}"] == [-7] * missing + ids
            assert r[f"attention_mask_{v}"] == [0] * missing + [1] * len(ids)
            by_batch.setdefault((r["batch_id"], v), []).append((len(r[f"input_ids_{v}"]), missing))
    for sizes in by_batch.values():
        assert len({s for s, _ in sizes}) == 1 and min(m for _, m in sizes) == 0


LOGPROBS = (
    "batch_id int, pi_chosen array<double>, pi_rejected array<double>, "
    "ref_chosen array<double>, ref_rejected array<double>, len_chosen int, len_rejected int"
)


def log_sigmoid(x):
    return -math.log1p(math.exp(-x)) if x > -700 else x


def test_preference_metrics(spark):
    rng = random.Random(4)
    data = []
    for i in range(60):
        arrays = [[round(rng.uniform(-3, 0), 3) for _ in range(6)] for _ in range(4)]
        data.append((i % 5, *arrays, rng.choice([0, 1, 3, 6, 9]), rng.choice([1, 6])))
    data.append((9, [-1.0], [-1.0], [-1.0], [-1.0], 1, 1))  # delta 0: not correct
    data.append((8, [-800.0], [0.0], [0.0], [0.0], 1, 1))
    data.append((8, [0.0], [-800.0], [0.0], [0.0], 1, 1))
    got = {
        r["batch_id"]: r for r in metrics.preference_metrics(
            metrics.completion_sums(spark.createDataFrame(data, LOGPROBS)), 1.0, True
        ).collect()
    }
    for b in {d[0] for d in data}:
        rows = [d for d in data if d[0] == b]

        def tail(array, n):
            return sum(array[-n:]) if n else 0.0

        sums = [(tail(d[1], d[5]), tail(d[2], d[6]), tail(d[3], d[5]), tail(d[4], d[6])) for d in rows]
        deltas = [(a - b_) - (c - e) for a, b_, c, e in sums]
        expected = {
            "dpo_loss": -sum(map(log_sigmoid, deltas)) / len(rows),
            "pi_margin": sum(a - b_ for a, b_, _, _ in sums) / len(rows),
            "ref_margin": sum(c - e for _, _, c, e in sums) / len(rows),
            "chosen_nll_loss": -sum(s[0] for s in sums) / sum(d[5] for d in rows),
        }
        for name, value in expected.items():
            assert got[b][name] == pytest.approx(value, abs=1e-9)
        assert got[b]["margin_delta"] == pytest.approx(got[b]["pi_margin"] - got[b]["ref_margin"])
        assert got[b]["loss"] == pytest.approx(expected["dpo_loss"] + expected["chosen_nll_loss"])
    assert got[9]["dpo_accuracy"] == 0.0
    assert got[8]["dpo_accuracy"] == 0.5 and got[8]["dpo_loss"] == pytest.approx(400.0)


def test_nll_only_on_request(spark):
    df = metrics.completion_sums(spark.createDataFrame(
        [(1, [-1.0], [-2.0], [-1.0], [-1.0], 1, 1)], LOGPROBS))
    row = metrics.preference_metrics(df)
    assert "chosen_nll_loss" not in row.columns
    first = row.first()
    assert first["loss"] == first["dpo_loss"]


def test_completion_length(spark):
    df = spark.createDataFrame([([0, 0, 1, 1, 1], [0, 1, 1])], "s array<int>, c array<int>")
    assert df.select(metrics.completion_length(F.col("s"), F.col("c")).alias("n")).first()["n"] == 1


def test_token_shift(spark):
    tokens = ["<|b|>", "x", "<|end_header_id|>", "ĊĊ", "q", "<|end_header_id|>", "Ċ", "Ġyes", "no", "ok"]
    model = [-1.0] * 6 + [0.0, -5.0, -0.5]
    reference = [-2.0] * 6 + [-9.0, -0.25, -0.5]
    df = spark.createDataFrame([(1, tokens, model, reference)],
                               "k int, tokens array<string>, model_lp array<double>, ref_lp array<double>")
    scored = shift.token_shift_scores(df)
    row = scored.first()
    assert row["tokens"] == [t.replace("Ġ", "").replace("Ċ", "") for t in tokens]
    assert row["scores"] == [0.0] * 7 + [1.0, -1.0, 0.0]
    table = shift.token_shift_table(scored, ["k"])
    rows = sorted(table.collect(), key=lambda r: r["pos"])
    assert [(r["token"], r["direction"]) for r in rows][-3:] == [("yes", "up"), ("no", "down"), ("ok", "none")]
    rolled = {r["token"]: (r["avg_score"], r["n"]) for r in shift.token_shift_rollup(table).collect()}
    assert rolled["yes"] == (1.0, 1) and rolled["<|end_header_id|>"] == (0.0, 2)


def test_missing_header_is_an_error(spark):
    df = spark.createDataFrame([(1, ["a", "b"], [0.0], [0.0])],
                               "k int, tokens array<string>, model_lp array<double>, ref_lp array<double>")
    with pytest.raises(Exception, match="is not in the list"):
        shift.token_shift_scores(df).collect()


def test_instruction_scorecard(spark):
    outcomes = [(1, [True, True], [True, True]), (2, [True, False], [True, True]),
                (3, [False], [True]), (4, [False, False, False], [False, True, True])]
    wide = spark.createDataFrame(outcomes, "prompt_id int, strict array<boolean>, loose array<boolean>")
    row = scorecards.scorecard("ifeval", scorecards.flags_to_rows(wide)).first()
    expected = (1 / 4, 3 / 8, 3 / 4, 7 / 8)
    assert tuple(row)[:4] == pytest.approx(expected)
    assert row["average"] == pytest.approx(sum(expected) / 4)
    limited = scorecards.scorecard("ifeval", scorecards.flags_to_rows(wide), limit=2).first()
    assert limited["prompt_strict_acc"] == 0.5 and limited["inst_strict_acc"] == 0.75


def test_choice_scorecard(spark):
    rows = [
        (1, 0, -4.0, "aaaa", 0), (1, 1, -3.0, "b", 0),
        (2, 0, -2.0, "aa", 1), (2, 1, -2.0, "bb", 1),  # a tie goes to the first
        (3, 0, -9.0, "a", 1), (3, 1, -1.0, "b", 1),
    ]
    df = spark.createDataFrame(rows, "item_id int, option int, ll double, option_text string, gold int")
    row = scorecards.scorecard("hellaswag", df).first()
    assert (row["acc"], row["acc_norm"]) == pytest.approx((1 / 3, 2 / 3))
    for none in (0, None):
        assert scorecards.limit_items(df, "item_id", none).count() == 6
    assert scorecards.limit_items(df, "item_id", 2).count() == 4


def test_unknown_benchmark(spark):
    with pytest.raises(ValueError):
        scorecards.scorecard("other", spark.range(1))


def vocabulary(marks=()):
    import public_tokenizers

    return Vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, marks)


def test_a_vocabulary_tells_tokens_apart_and_spells_them_again(spark):
    known = vocabulary(("<|eot_id|>", "<|start|>"))
    texts = ["", "plain words", "é日本\U0001f600", "a<|eot_id|>b<|start|>", "<|endoftext|>", "x" + " " * 900_000 + "\n y", "tab\t\x00"]
    ids = [known.encode(t) for t in texts]
    assert [known.decode(i) for i in ids] == texts
    assert ids[3].count(known.marks["<|eot_id|>"]) == 1 and known.marks["<|start|>"] in ids[3]
    assert len(set(known.ranks.values())) == len(known.ranks) and not set(known.ranks.values()) & set(known.marks.values())
    assert all(max(i, default=0) < len(known) for i in ids)
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, t string").repartition(2)
    rows = sorted(df.withColumn("ids", known.tokenizer()(F.col("t"))).withColumn("again", known.text(F.col("ids"))).collect())
    assert [r["again"] for r in rows] == [*texts, None] and [r["ids"] for r in rows] == [*ids, None]


def test_a_tokenizer_gets_a_part_of_a_batch_at_a_time(spark):
    def factory():
        return lambda texts: [[len(texts)] for _ in texts]

    df = spark.range(4000).coalesce(1).select(F.repeat(F.lit("x"), 1000).alias("t"))
    seen = df.select(python_tokenizer(factory)(F.col("t")).alias("ids"))
    counted = seen.agg(F.count("ids").alias("n"), F.max(F.col("ids")[0]).alias("most")).first()
    assert counted["n"] == 4000 and counted["most"] <= SLICE_BYTES // 1000


def test_views_share_a_python_worker(spark):
    known = vocabulary(("<|eot_id|>",))
    views = token_views(pairs(spark, 3), known.tokenizer())
    spelled = views.select(*[known.text(F.col(f"input_ids_{v}")).alias(v) for v in VIEWS])
    assert 1 <= spelled._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") <= 2
    assert len(spelled.collect()) == 3


def test_odd_lists_of_ids_are_spelled(spark):
    known = vocabulary()
    whole = known.encode("日本 plain")
    lists = [[], None, whole, whole[:1], whole[1:], []]
    df = spark.createDataFrame(list(enumerate(lists)), "i int, ids array<int>").coalesce(1)
    rows = sorted(df.select("i", known.text(F.col("ids")).alias("t")).collect())
    assert [r["t"] for r in rows] == [None if own is None else known.decode(own) for own in lists]
