import time

import pytest
from pyspark.sql import functions as F

from prefmill.operators import verifier_child as child
from prefmill.operators.verification import (
    EQ_FALSE, EQ_TRUE, ERROR, TIMEOUT, TRUTHY, Budget, VerifierProcess, run_verifiers,
    verdict_rows,
)
from prefmill.session import BATCH_BYTES

YES, NO = EQ_TRUE | TRUTHY, EQ_FALSE


def fn(body, head=""):
    return f"{head}def evaluate(response: str) -> bool:\n    {body}\n"


LOOP = (
    "def evaluate(response):\n    while True:\n        try:\n            while True:\n"
    "                pass\n        except BaseException:\n            pass\n"
)
GOOD = fn("return len(response) > 3")


@pytest.fixture
def judge():
    process = VerifierProcess(Budget(seconds=0.5, timeout_as_false=True))
    yield lambda sources, inputs: [
        (v["compiled"], v["codes"]) for v in process.judge(sources, inputs)["matrix"]
    ]
    process.close()


CASES = [
    (GOOD, (True, [YES, NO])),
    (fn("return 1"), (True, [YES, YES])),
    (fn("return 1.0"), (True, [YES, YES])),
    (fn("return 0"), (True, [NO, NO])),
    (fn("return None"), (True, [0, 0])),
    (fn("return 'text'"), (True, [TRUTHY, TRUTHY])),
    (fn("return ''"), (True, [0, 0])),
    (fn("return 2"), (True, [TRUTHY, TRUTHY])),
    (fn("return ("), (False, None)),
    (fn("return True", head="import no_such_module_here\n"), (False, None)),
    ("x = 1\n", (False, None)),
    ("raise SystemExit\n", (False, None)),
    ("evaluate = 5\n", (True, [ERROR, ERROR])),
    (fn("raise ValueError"), (True, [ERROR, ERROR])),
    (fn("raise SystemExit(0)"), (True, [ERROR, ERROR])),
    (fn("return evaluate(response)"), (True, [ERROR, ERROR])),
    (fn("return json.loads('true')"), (True, [YES, YES])),
    (fn("return re.match('a', response)"), (True, [ERROR, ERROR])),
    (fn("os._exit(3)", head="import os\n"), (True, [ERROR, ERROR])),
    (fn("return True", head="import os\nos._exit(1)\n"), (False, None)),
    (fn("os.kill(os.getpid(), 9)", head="import os\n"), (True, [ERROR, ERROR])),
    (fn("os.fork(); return True", head="import os\n"), (True, [YES, YES])),
    (fn("return len('a' * (1 << 34)) > 0"), (True, [ERROR, ERROR])),
    (LOOP, (True, [TIMEOUT, TIMEOUT])),
    (fn("print('noise'); return True"), (True, [YES, YES])),
    (fn("return input() == ''"), (True, [ERROR, ERROR])),
]


@pytest.mark.parametrize("source,expected", CASES)
def test_one_verifier(judge, source, expected):
    assert judge([source], ["abcd", "x"]) == [expected]


def test_a_hostile_neighbour_changes_nothing(judge):
    got = judge([source for source, _ in CASES], ["abcd", "x"])
    assert got == [expected for _, expected in CASES]


def test_death_in_the_middle_keeps_the_other_calls(judge):
    source = fn("os._exit(1) if response == 'die' else None; return True", head="import os\n")
    assert judge([source, GOOD], ["a", "die", "bbbb"]) == [
        (True, [YES, ERROR, YES]), (True, [NO, NO, YES]),
    ]


def test_time_out_drops_the_instance_unless_counted_as_false():
    process = VerifierProcess(Budget(seconds=0.3))
    assert process.judge([GOOD, LOOP], ["a"]) == {"timed_out": True, "late": False, "matrix": None}
    assert process.judge(["while True: pass\n"], ["a"])["timed_out"]
    assert process.judge([GOOD], ["abcd"])["matrix"] == [{"compiled": True, "codes": [YES]}]
    process.close()


def test_the_memory_limit_leaves_room_for_long_texts():
    process = VerifierProcess(Budget(seconds=30, memory_bytes=256 << 20))
    text = "a" * (150 << 20)
    hungry = fn("return len('b' * (1 << 30)) > 0")
    got = process.judge([GOOD, hungry], [text, "x"])["matrix"]
    process.close()
    assert [v["codes"] for v in got] == [[YES, NO], [ERROR, ERROR]]


def test_no_inputs_or_no_sources(judge):
    assert judge([GOOD, "def"], []) == [(True, []), (False, None)]
    assert judge([], ["a"]) == []


def test_namespaces_are_fresh(judge):
    helper = "import re\nshared = 7\n" + fn("return shared == 7")
    assert judge([helper, fn("return shared == 7")], ["a"]) == [(True, [YES]), (True, [ERROR])]


STATEFUL = [
    fn("return True", head="import json as j\nj.loads = None\n"),
    fn("return True", head="json.decoder.marker = 1\n"),
    fn("return True", head="import sys\nsys.setrecursionlimit(50)\n"),
    fn("return True", head="import builtins\nbuiltins.len = None\n"),
    fn("return True", head="from json import codecs\ncodecs.sys.marker = 1\n"),
    fn("return True", head="__builtins__['len'] = None\n"),
    fn("setattr(json, 'loads', None); return True"),
    fn("return [f for f in (json,)][0]"),
    fn("json.loads.__globals__['x'] = 1; return True"),
    fn("return True", head="from re import *\n"),
    fn("return True", head="import random\nrandom.seed(1)\n"),
    fn("return True", head="import collections\ncollections.UserDict.register(str)\n"),
    fn("return True", head="import typing\ntyping.SupportsInt.register(str)\n"),
    "import typing\ndef f(x: 'json.__setattr__(\"loads\", None)'): pass\ntyping.get_type_hints(f)\n"
    + fn("return True"),
    fn("return True", head="from typing import get_type_hints\n"),
    fn("return True", head="from datetime import sys\nsys.marker = 1\n"),
    fn("return True", head="class C: pass\n"),
    fn("len = 1; return True"),
]
PLAIN = [
    GOOD, fn("return json.loads(response)"), fn("return re.match('a', response)", "import re\n"),
    fn("return sqrt(4) == 2", "from math import sqrt\n"),
    fn("import string as s\n    return response[0] in s.ascii_letters"),
    fn("words = response.split()\n    return sorted(w.lower() for w in words) == words"),
    "from typing import List\ndef evaluate(response: str) -> bool:\n    x: List[int] = [1]\n    return bool(x)\n",
    fn("return collections.Counter(response).most_common(1)[0][1] > 1", "import collections\n"),
    fn("try:\n        return int(response) > 3\n    except ValueError as e:\n        return False"),
    fn("return not_defined_anywhere"),
]


def test_only_harmless_verifiers_share_the_process():
    assert [s for s in STATEFUL if child.is_plain(child.parse(s))] == []
    assert [s for s in PLAIN if not child.is_plain(child.parse(s))] == []


def test_state_never_reaches_the_next_instance(judge):
    check = fn("return len(json.loads('[1]')) == 1")
    types = fn(
        "return isinstance('', collections.UserDict) or isinstance('', typing.SupportsInt)",
        head="import collections, typing\n",
    )
    for source in STATEFUL:
        judge([source], ["a"])
        assert judge([check, types], ["a"]) == [(True, [YES]), (True, [NO])]


def test_explicit_consent_is_needed(spark):
    df = spark.createDataFrame([([GOOD], ["a"])], "v array<string>, x array<string>")
    with pytest.raises(PermissionError):
        run_verifiers(df, F.col("v"), F.col("x"))


def test_verdict_rows_over_spark(spark):
    data = [(i, [GOOD, "def", fn("return response == 'b'")], ["abcd", "b"]) for i in range(40)]
    data += [(40, [GOOD], []), (41, [LOOP], ["a"]), (42, None, None)]
    df = spark.createDataFrame(data, "k int, v array<string>, x array<string>").repartition(4)
    done = run_verifiers(df, F.col("v"), F.col("x"), budget=Budget(seconds=0.5),
                         allow_execution=True, partitions=3)
    rows = [tuple(r) for r in verdict_rows(done, "k").collect()]
    assert 41 not in {r[0] for r in rows}
    assert [r for r in rows if r[0] == 40] == [(40, 0, True, None, None, None, None, None, None)]
    seven = sorted((r for r in rows if r[0] == 7), key=lambda r: (r[1], r[3] or 0))
    assert [r[:7] for r in seven] == [
        (7, 0, True, 0, True, False, True), (7, 0, True, 1, False, True, False),
        (7, 1, False, None, None, None, None),
        (7, 2, True, 0, False, True, False), (7, 2, True, 1, True, False, True),
    ]
    assert len(rows) == 40 * 5 + 1


SLOW = fn("time.sleep(0.2)\n    return True", head="import time\n")


@pytest.mark.parametrize("source,inputs", [(LOOP, 8), (SLOW, 200)])
def test_an_instance_has_a_time_limit_of_its_own(source, inputs):
    budget = {"seconds": 1.0, "instance_seconds": 1.5}
    started = time.monotonic()
    process = VerifierProcess(Budget(**budget, timeout_as_false=True))
    got = process.judge([GOOD, source, GOOD], ["abcd"] * inputs)["matrix"]
    process.close()
    assert time.monotonic() - started < 20  # a limit, and the start of a process
    assert got[0] == {"compiled": True, "codes": [YES] * inputs}
    assert len(got[1]["codes"]) == inputs and got[1]["codes"][-1] == TIMEOUT
    assert got[2] == {"compiled": False, "codes": None}
    process = VerifierProcess(Budget(**budget))
    assert process.judge([GOOD, source], ["abcd"] * inputs) == {"timed_out": True, "late": False, "matrix": None}
    process.close()


def test_arrow_batches_are_bounded_in_any_session(spark):
    key, bound = next(iter(BATCH_BYTES.items()))
    other = spark.newSession()
    other.conf.unset(key)
    df = other.createDataFrame([(1, [GOOD], ["abcd"])], "instance_id int, v array<string>, t array<string>")
    judged = run_verifiers(df, F.col("v"), F.col("t"), allow_execution=True)
    assert other.conf.get(key) == bound and judged.first()["verdicts"]["matrix"][0]["codes"] == [YES]
    other.conf.set(key, "3m")
    run_verifiers(df, F.col("v"), F.col("t"), allow_execution=True)
    assert other.conf.get(key) == "3m"
