import random
from itertools import cycle

import pytest

from prefmill.operators.pairing import preference_pairs, relabel

SCHEMA = (
    "instance_id int, query string, instruction string, "
    "scores array<struct<completion:string,score:double>>"
)


def plain_pairs(scores, ct, rt, loop):
    chosen = [c for c, s in scores if s >= ct]
    rejected = [c for c, s in scores if s < rt or (rt == s == 0)]
    longer, shorter = (chosen, rejected) if len(chosen) > len(rejected) else (rejected, chosen)
    if not shorter:
        return []
    repeated = cycle(shorter) if not loop else shorter * loop
    pairs = list(zip(longer, repeated))
    return pairs if longer is chosen else [(b, a) for a, b in pairs]


def instances():
    rng = random.Random(9)
    for i in range(150):
        n = rng.randrange(0, 9)
        yield i, [(f"c{i}-{j}", rng.choice([0.0, 0.0, 0.25, 0.5, 0.75, 1.0])) for j in range(n)]


@pytest.mark.parametrize("loop", [None, 0, 1, 2, -1])
@pytest.mark.parametrize("ct,rt", [(0.5, 0.0), (0.25, 0.5), (1.0, 0.3), (2.0, 0.0)])
def test_pairs_match(spark, loop, ct, rt):
    data = list(instances())
    df = spark.createDataFrame([(i, f"q{i}", "do", s) for i, s in data], SCHEMA)
    got = {}
    for r in preference_pairs(df, ct, rt, loop).collect():
        assert r["prompt"] == f"q{r['instance_id']}\ndo"
        got.setdefault(r["instance_id"], {})[r["pair_idx"]] = (r["chosen"], r["rejected"])
    expected = {i: dict(enumerate(plain_pairs(s, ct, rt, loop))) for i, s in data}
    assert got == {i: p for i, p in expected.items() if p}


def test_zero_threshold_rejects_exact_zero_only(spark):
    df = spark.createDataFrame([(1, "q", "i", [("a", 0.0), ("b", 0.1), ("c", 0.9)])], SCHEMA)
    row = relabel(df, 0.5, 0.0).first()
    assert (row["chosen"], row["rejected"]) == (["c"], ["a"])
    row = relabel(df, 0.1, 0.5).first()  # overlapping thresholds
    assert (row["chosen"], row["rejected"]) == (["b", "c"], ["a", "b"])


def test_a_very_long_list_against_one(spark):
    scores = [("good", 1.0)] + [(f"bad{i}", 0.0) for i in range(5000)]
    df = spark.createDataFrame([(1, "q", "i", scores)], SCHEMA)
    rows = preference_pairs(df).collect()
    assert len(rows) == 5000 and {r["chosen"] for r in rows} == {"good"}
    assert len(preference_pairs(df, max_loop=3).collect()) == 3
