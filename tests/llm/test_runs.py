"""Run detection against a search over all periods."""

import hashlib
import random
import re
import zlib

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from prefmill.llm.queries import QUERIES
from prefmill.llm.runs import Extensions, SuffixTree, collapse, find_runs, word_runs

SF = "/root/testdata/sf0.001"


def smallest_period(words):
    return next(d for d in range(1, len(words) + 1) if words[d:] == words[: len(words) - d])


def brute_runs(words, exponent=4, shortest=6):
    found, n = [], len(words)
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(shortest, exponent * q) and smallest_period(words[i : i + length]) == q:
                found.append((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_collapse(words, found):
    gone = {i for start, length, q in found for i in range(start + q, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def as_tuples(rows):
    return [tuple(r) for r in rows.tolist()]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=40), max_size=3), st.sampled_from([(4, 6), (2, 2), (3, 5)]))
def test_runs_equal_the_search(texts, limits):
    assert [as_tuples(r) for r in word_runs(texts, *limits)] == [brute_runs(t, *limits) for t in texts]


def test_planted_periods_equal_the_search():
    draw = random.Random(5)
    for _ in range(60):
        words = [draw.choice("abcdefghij") for _ in range(draw.randint(0, 400))]
        if words:
            a = draw.randrange(len(words))
            p = draw.randint(1, 1 + (len(words) - a) // 3)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        (rows,) = word_runs([words])
        assert as_tuples(rows) == brute_runs(words)
        assert collapse(words, rows) == brute_collapse(words, brute_runs(words))


def test_suffix_tree_extensions():
    draw = random.Random(7)
    text = [draw.choice([1, 2]) for _ in range(120)]
    depths, first, rank = SuffixTree(text).tour()
    assert sorted(range(121), key=rank.__getitem__) == sorted(range(121), key=lambda i: [*text[i:], 0])
    reverse = SuffixTree(text).reverse_ranks()
    assert sorted(range(121), key=reverse.__getitem__) == sorted(range(121), key=lambda i: [*(3 - s for s in text[i:]), 0])
    a, b = zip(*[(i, j) for i in range(121) for j in range(121) if i != j])
    common = Extensions(depths, first).of(*map(__import__("numpy").array, (a, b)))
    for i, j, found in zip(a, b, common):
        k = 0
        while max(i, j) + k < 120 and text[i + k] == text[j + k]:
            k += 1
        assert found == k


def test_long_stretches():
    base = [f"w{i}" for i in range(3001)]
    periodic = [base[i % 3001] for i in range(60_000)]
    one, whole, none = word_runs([["x"] * 50_000, periodic, [f"u{i}" for i in range(50_000)]])
    assert as_tuples(one) == [(0, 50_000, 1)]
    assert as_tuples(whole) == [(0, 60_000, 3001)]
    assert not len(none)


def test_odd_rows(spark):
    rows = [
        (1, None, "r"), (2, "", "r"), (None, "a b a b a b a b", "r"), (3, "a b a b a b a b", "s"), (3, "a b a b a b a b", "s"),
        (4, " \n\t ", "r"), (5, "A a a a a a a", "r"), (6, "  é é é é é é é", "r"), (7, "x" * 300_000, "r"),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, runs string").withColumnRenamed("runs", "c0")
    df = df.selectExpr("doc_id", "text", "c0", "c0 AS `a.b`", "c0 AS n_words")
    found = find_runs(df).collect()
    assert set(found[0].asDict()) == {"doc_id", "text", "c0", "a.b", "n_words", "runs", "collapsed"}
    assert len(found) == len(rows)
    for before, row in zip(rows, sorted(found, key=lambda r: [x[:2] for x in rows].index((r["doc_id"], r["text"])))):
        words = re.findall(r"[^\x20\x09-\x0D]+", row["text"] or "")
        expected = brute_runs(words)
        assert row["n_words"] == len(words) and [tuple(r) for r in row["runs"]] == expected
        assert row["collapsed"] == brute_collapse(words, expected)
    assert find_runs(df.limit(0)).collect() == []


@pytest.mark.parametrize("limits", [(1, 6), (4, 1)])
def test_limits_are_checked(spark, limits):
    with pytest.raises(ValueError):
        find_runs(spark.range(1).selectExpr("'a' AS text"), exponent=limits[0], shortest=limits[1])


def test_query_equals_brute_force(spark):
    documents = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    rows = {r["doc_id"]: r for r in QUERIES["op13_runs"](spark, SF).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert len(rows) == len(documents)
    some = 0
    for doc_id, text in documents:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        elif n > 2000:
            continue  # the search over all periods is too slow
        expected, row = brute_runs(words), rows[doc_id]
        some += len(expected)
        best = min(expected, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        milli = 1000 * best[1] // best[2] if expected else None
        assert (row["n_runs"], row["start"], row["length"], row["period"], row["exponent_milli"]) == (len(expected), *best, milli)
        assert row["runs_sha256"] == sha("".join(f"{s},{length},{q}\n" for s, length, q in expected))
        assert row["collapsed_sha256"] == sha(brute_collapse(words, expected))
    assert some
