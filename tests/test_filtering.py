"""The filter and scoring stages against small plain statements of what they mean."""

import random

import pytest
from pyspark.sql import functions as F

from prefmill.operators import filtering, scoring
from prefmill.operators.verification import EQ_FALSE, EQ_TRUE, TRUTHY
from prefmill.sources.jsonl import COUNTERS

CODES = [EQ_TRUE | TRUTHY, EQ_FALSE, TRUTHY, 0, 8]


def random_instances(n, seed, inputs="cases"):
    rng = random.Random(seed)
    for i in range(n):
        verifiers = [f"v{i}-{j}" for j in range(rng.randrange(1, 6))]
        count = rng.randrange(0, 7) if inputs == "cases" else rng.randrange(1, 9)
        weights = rng.choice([[5, 5, 1, 1, 1], [1, 0, 0, 0, 0], [0, 0, 0, 0, 1], [9, 1, 0, 0, 0]])
        matrix = [
            (True, rng.choices(CODES, weights, k=count)) if rng.random() < 0.8 else (False, None)
            for _ in verifiers
        ]
        if inputs == "cases":
            items = [(f"r{rng.randrange(3)}", rng.random() < 0.5) for _ in range(count)]
        else:
            items = [f"c{rng.randrange(6)}" for _ in range(count)]
        yield i, verifiers, items, matrix


def plain_filter(verifiers, cases, matrix):
    """(kept verifiers, kept cases, counters) of one instance."""
    stats = dict.fromkeys(COUNTERS, 0)
    stats["verifier_count"], stats["testcase_str_count"] = len(verifiers), 2
    alive = [(v, codes) for v, (ok, codes) in zip(verifiers, matrix) if ok]
    stats["compiled_verifiers"] = len(alive)
    if not alive:
        return None, stats
    stats["test_cases_parse"] = len(cases)

    def agree(codes, i):
        return bool(codes[i] & (EQ_TRUE if cases[i][1] else EQ_FALSE))

    kept = [i for i in range(len(cases)) if any(agree(c, i) for _, c in alive)]
    stats["test_cases_pass_gte1"] = len(kept)
    if not kept:
        return None, stats
    passed = [(v, sum(agree(c, i) for i in kept)) for v, c in alive]
    good = [v for v, n in passed if n / len(kept) >= 0.8]
    stats["verifiers_pass_80pct"] = len(good)
    stats["total_passes"] = sum(n for _, n in passed)
    if not good:
        return None, stats
    stats["unique_instances"] = 1
    return (good, [cases[i] for i in kept]), stats


VERDICTS = "struct<timed_out:boolean,late:boolean,matrix:array<struct<compiled:boolean,codes:array<int>>>>"


@pytest.fixture(scope="module")
def filter_case(spark):
    data = list(random_instances(400, 3))
    df = spark.createDataFrame(
        [(i, f"q{i}", "ins", v, ["b", "b"], c, (False, False, m)) for i, v, c, m in data],
        "instance_id int, query string, instruction string, verifiers array<string>, "
        "testcases array<string>, cases array<struct<response:string,result:boolean>>, "
        f"verdicts {VERDICTS}",
    )
    return data, filtering.weigh(df).cache()


def test_counters_match(filter_case):
    data, weighed = filter_case
    got = {r["instance_id"]: r for r in weighed.select("instance_id", *COUNTERS).collect()}
    for i, verifiers, cases, matrix in data:
        _, stats = plain_filter(verifiers, cases, matrix)
        assert {c: got[i][c] for c in COUNTERS} == stats


def test_every_gate_is_hit(filter_case):
    data, _ = filter_case
    outcomes = [plain_filter(v, c, m)[1] for _, v, c, m in data]
    assert any(s["compiled_verifiers"] == 0 for s in outcomes)
    assert any(s["compiled_verifiers"] and not s["test_cases_parse"] for s in outcomes)
    assert any(s["test_cases_parse"] and not s["test_cases_pass_gte1"] for s in outcomes)
    assert any(s["test_cases_pass_gte1"] and not s["verifiers_pass_80pct"] for s in outcomes)
    assert any(s["unique_instances"] for s in outcomes)


def test_kept_instances_match(filter_case):
    data, weighed = filter_case
    got = {
        r["instance_id"]: (r["verifiers"], [tuple(c) for c in r["test_cases"]])
        for r in filtering.filtered_instances(weighed).collect()
    }
    expected = {i: plain_filter(v, c, m)[0] for i, v, c, m in data}
    assert got == {i: e for i, e in expected.items() if e}


def test_funnel_sums_all_finished_instances(filter_case):
    data, weighed = filter_case
    stats = [plain_filter(v, c, m)[1] for _, v, c, m in data]
    row = filtering.funnel(weighed).first()
    assert row.asDict() == {c: sum(s[c] for s in stats) for c in COUNTERS}
    assert filtering.funnel(weighed.filter("false")).first().asDict() == dict.fromkeys(COUNTERS, 0)


def test_eighty_percent_is_inclusive(spark):
    yes, no = EQ_TRUE | TRUTHY, EQ_FALSE
    matrix = [(True, [yes] * 4 + [no]), (True, [yes] * 3 + [no] * 2), (True, [yes] * 5)]
    df = spark.createDataFrame(
        [(1, "q", "i", ["a", "b", "c"], ["x"], [("r", True)] * 5, (False, False, matrix))],
        "instance_id int, query string, instruction string, verifiers array<string>, "
        "testcases array<string>, cases array<struct<response:string,result:boolean>>, "
        f"verdicts {VERDICTS}",
    )
    assert filtering.filtered_instances(filtering.weigh(df)).first()["verifiers"] == ["a", "c"]


def plain_score(verifiers, completions, matrix):
    rates = [
        sum(1 for ok, codes in matrix if ok and codes[i] & TRUTHY) / len(verifiers)
        for i in range(len(completions))
    ]
    chosen = [c for c, r in zip(completions, rates) if r >= 0.5]
    rejected = [c for c, r in zip(completions, rates) if r == 0]
    scores = {}
    for c, r in zip(completions, rates):
        scores[c] = r
    return rates, chosen, rejected, list(scores.items())


@pytest.fixture(scope="module")
def score_case(spark):
    data = list(random_instances(400, 5, "completions"))
    df = spark.createDataFrame(
        [(i, "q", "ins", v, c, (False, False, m)) for i, v, c, m in data],
        "instance_id int, query string, instruction string, verifiers array<string>, "
        f"completions array<string>, verdicts {VERDICTS}",
    )
    return data, scoring.score(df).cache()


def test_rates_labels_and_scores_match(score_case):
    data, scored = score_case
    got = {r["instance_id"]: r for r in scored.collect()}
    for i, verifiers, completions, matrix in data:
        rates, chosen, rejected, scores = plain_score(verifiers, completions, matrix)
        row = got[i]
        assert (row["rates"], row["chosen"], row["rejected"]) == (rates, chosen, rejected)
        assert [tuple(s) for s in row["scores"]] == scores


def test_labels_are_not_complementary(score_case):
    _, scored = score_case
    neither = scored.filter(
        F.size("chosen") + F.size("rejected") < F.size("completions")
    )
    assert neither.count() > 0


def test_yield_report(score_case):
    data, scored = score_case
    sides = [plain_score(v, c, m)[1:3] for _, v, c, m in data]
    both = [(len(c), len(r)) for c, r in sides if c and r]
    row = scoring.yield_report(scored, 1000).first()
    assert row.asDict() == {
        "instances": 1000, "pairs": sum(max(p) for p in both),
        "unique_completions": sum(map(sum, both)), "unique_prompts": len(both),
        "chosen_completions": sum(len(c) for c, _ in sides),
        "rejected_completions": sum(len(r) for _, r in sides),
    }


def test_no_verifiers_give_no_label(spark):
    df = spark.createDataFrame(
        [(1, "q", "i", [], ["a"], (False, False, []))],
        "instance_id int, query string, instruction string, verifiers array<string>, "
        f"completions array<string>, verdicts {VERDICTS}",
    )
    row = scoring.score(df).first()
    assert (row["rates"], row["chosen"], row["rejected"]) == ([None], [], [])
