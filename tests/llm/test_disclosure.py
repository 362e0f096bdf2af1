"""Personal data against the plain patterns, disclosing terms against dictionaries."""

import hashlib
import math
import random
import re
import string
from collections import defaultdict

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from prefmill.llm import disclosure
from prefmill.llm.disclosure import KINDS, base_spans, context, fit, rewrite, sanitise
from prefmill.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d if d < 10 else d - 9
    return total % 10 == 0


def brute_spans(text):
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append(("phone", *m.span()))
    return found


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="a1Z@.-_ +()05é", max_size=40))
def test_spans_equal_the_patterns(text):
    assert base_spans(text) == brute_spans(text)


def test_numbers_equal_the_patterns():
    draw = random.Random(2)
    hits = 0
    for _ in range(4000):
        text = "".join(draw.choice(["4111 1111 1111 1111", "+1 (555) 123-4567", "10.0.0.255", "a@b.c", "7", "0", "-", " ", ".", "+", "x"])
                       for _ in range(draw.randint(1, 9)))
        assert base_spans(text) == brute_spans(text)
        hits += len({k for k, _, _ in base_spans(text)}) == 4
    assert hits


@pytest.mark.parametrize("text", ["a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 100_000, "+1((" * 50_000, "a@b." * 60_000, "1 " * 100_000, "0" * 5000 + "1.1.1.1"])
def test_long_texts_take_no_quadratic_time(text):
    base_spans(text)


def test_documents_equal_the_patterns(spark):
    documents = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    rows = {r["doc_id"]: r for r in QUERIES["op12_disclosure"](spark, SF).collect()}
    assert len(rows) == len(documents)
    some = 0
    for doc_id, text in documents:
        spans, row = brute_spans(text or ""), rows[doc_id]
        some += len(spans)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert tuple(row[f"n_{k}"] for k in KINDS) == tuple(sum(s[0] == k for s in spans) for k in KINDS)
        assert row["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert row["spans"] == joined or row["spans"].startswith(joined + ",term:" if joined else "term:")
    assert some


# -- disclosing terms --------------------------------------------------------------------


def brute_model(texts, threshold, support):
    """Terms, what stands for them and what they disclose, from dictionaries."""
    words_total, around_of, seen = 0, defaultdict(list), defaultdict(set)
    for text in texts:
        spans = brute_spans(text or "")
        matches = list(re.finditer(r"[^\x20\x09-\x0D]+", text or ""))
        words_total += len(matches)
        words = [m[0].lower() for m in matches]
        free = [not any(m.end() > a and m.start() < b for _, a, b in spans) for m in matches]

        def at(i):
            return words[i] if 0 <= i < len(words) else ""

        def term(i):
            t = words[i].strip(string.punctuation)
            return t if len(t) >= 3 else ""

        for i in range(len(words)):
            if free[i] and term(i):
                seen[term(i)].add((at(i - 1), term(i), at(i + 1)))
        for kind, a, b in spans:
            value = text[a:b]
            value = re.sub("[^0-9]", "", value) if kind in ("card", "phone") else value.lower()
            first = next((i for i, m in enumerate(matches) if m.end() > a), len(matches))
            last = next((i for i, m in enumerate(matches) if m.start() >= b), len(matches))
            pairs = [(at(first - d - 1), at(first - d)) for d in (8, 7, 6)] + [(at(last + d), at(last + d + 1)) for d in (5, 6, 7)]
            link = tuple((i, context(f"{i}", a, b)) for i, (a, b) in enumerate(pairs) if a or b)
            terms = {
                (at(i - 1), term(i), at(i + 1))
                for i in range(max(0, first - 10), min(len(words), last + 10)) if free[i] and term(i)
            }
            around_of[kind, value].append((link, terms))
    near, family_of = {}, {}
    for e, found in around_of.items():
        left, told = {link for link, _ in found}, {}
        if len(left) < support:
            continue
        for number in range(support - 1):
            counts = defaultdict(int)
            for link in left:
                for pair in link:
                    counts[pair] += 1
            common = {max((p for p in counts if p[0] == place), key=lambda p: (counts[p], p[1])) for place in {p[0] for p in counts}}
            reached = {p for link in left if set(link) & common for p in link}
            own = {link for link in left if set(link) & reached}
            told |= dict.fromkeys(own, number)
            left -= own
        if left:
            near[e] = {o for _, terms in found for o in terms}
            family_of[e] = {o: {told.get(link, link) for link, terms in found if o in terms} for o in near[e]}

    def disclosed(matching, least):
        best = None
        occurrences = {o for t in seen if matching(t) for o in seen[t]}
        for e, around in near.items():
            own = {o for o in around if matching(o[1])}
            together, kinds = len(own), {f for o in own for f in family_of[e][o]}
            if len(kinds) < least or not together or len(around) >= words_total:
                continue
            pmi = math.log2(together * words_total / (len(occurrences) * len(around)))
            value = pmi / math.log2(words_total / len(around))
            best = max(best or (value, e), (value, e))
        return best

    found = {}
    for t in {o[1] for around in near.values() for o in around}:
        best = disclosed(lambda x, t=t: x == t, support)
        if best and best[0] >= threshold - 1e-12:
            general = None
            for k in range(3, min(8, len(t) - 1) + 1):
                rest = disclosed(lambda x, p=t[:k]: x.startswith(p) and len(x) > len(p), 1)
                if not rest or rest[0] < threshold:
                    general = t[:k] + "*"
            found[t] = (general, ":".join(best[1]), round(best[0], 9))
    return words_total, found


def corpus():
    draw = random.Random(4)
    plain = [a + b for a in ("lor", "ips", "dol", "ame", "con") for b in ("em", "um", "or", "tec", "adi", "sit")]

    def filler(n):
        return [draw.choice(plain) for _ in range(n)]

    rows = []
    for i in range(60):
        words = filler(60)
        if i % 4 == 0:  # a nickname that only goes with this address
            words[20:20] = ["Zorrobel,", "Mail:", "jane.roe@example.org"]
        if i % 4 == 1:
            words[30:30] = ["zorrowind", *filler(2)]
        if i % 6 == 2:  # a name whose beginnings all give the number away
            words[10:10] = ["Quxyvia", "+1 (555) 010-2030"]
        if i % 5 == 3:
            words[5:5] = ["(loremum)", f"{i}@single.example.net"]
        rows.append(" ".join(words))
    return rows + rows[:8] * 5 + [rows[0].replace("lorem", "lorum")]


@pytest.mark.parametrize("max_terms", [1 << 20, 3])
def test_disclosing_terms_equal_dictionaries(spark, max_terms):
    texts = corpus()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(3)
    for threshold in (0.95, 0.7):
        model = fit(df, threshold=threshold, max_terms=max_terms)
        words, expected = brute_model(texts, threshold, 3)
        assert model.words == words
        found = {r["term"]: (r["general"], r["entity"], round(r["disclosure"], 9)) for r in model.terms.collect()}
        assert found == expected
        assert found["zorrobel"][:2] == ("zorro*" if threshold > 0.9 else None, "email:jane.roe@example.org")
        assert found["quxyvia"][:2] == (None, "phone:15550102030")
        for row in sanitise(df, model, max_terms=max_terms).collect():
            text, terms = row["text"], [s for s in row["spans"] if s["kind"] == "term"]
            assert [(s["kind"], s["start"], s["end"]) for s in row["spans"] if s["kind"] != "term"] == brute_spans(text)
            wanted = [
                (m.start(), m.end()) for m in re.finditer(r"[a-z0-9]+", text.lower())
                if m[0] in expected and not any(a <= m.start() < b for _, a, b in brute_spans(text))
            ]
            assert [(s["start"], s["end"]) for s in terms] == wanted
            assert not re.search("quxyvia|jane.roe|zorrobel", row["sanitised"].lower())
            assert row["sanitised"] == rewrite(text, [tuple(s) for s in row["spans"]])


def test_copies_and_near_copies_are_one_observation(spark):
    draw = random.Random(9)
    words = "some words here go before Nickname wrote from jane@example.org about other things that come after it".split()
    texts = [" ".join(words)] * 30
    for i in range(120):  # two words changed, never the address
        changed = list(words)
        for place in draw.sample([j for j in range(len(words)) if "@" not in words[j]], 2):
            changed[place] = f"new{i}{place}"
        texts.append(" ".join(changed))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert fit(df).terms.collect() == []
    assert brute_model(texts, 0.95, 3)[1] == {}


def test_frequent_terms_are_told_apart_without_being_gathered(spark, monkeypatch):
    texts = corpus()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(2)
    monkeypatch.setattr(disclosure, "HELD", 4)  # hand occurrences on after every few
    keys = spark.createDataFrame([("loremum", 3), ("zorrobel", 100), ("lorem", 2), ("quxyvia", 50), ("zorro*", 100), ("absent", 9)], "key string, cap long")
    found = {r["key"]: r["n"] for r in disclosure.occurrences(df, "text", keys, 2).collect()}
    seen = defaultdict(set)
    for text in texts:
        words = [w.lower() for w in text.split()]
        for i, w in enumerate(words):
            seen[w.strip(string.punctuation)].add((words[i - 1] if i else "", words[i + 1] if i + 1 < len(words) else ""))
    assert "lorem" not in found and "absent" not in found
    assert found["zorrobel"] == len(seen["zorrobel"]) and found["quxyvia"] == len(seen["quxyvia"])
    assert found["zorro*"] == len(seen["zorrobel"]) + len(seen["zorrowind"])


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "a@b.cc"), (3, "a@b.cc"), (3, "a@b.cc"), (4, " \n"), (5, "é 1.2.3.4\U0001f600 5.6.7.8"), (6, "x " * 100_000 + "a@b.cc")]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id bigint, text string, spans int, c0 int")
    df = df.selectExpr("doc_id", "text", "spans", "c0 AS `a.b`", "c0 AS sanitised")
    found = sanitise(df, fit(df)).collect()
    assert set(found[0].asDict()) == {"doc_id", "text", "a.b", "spans", "sanitised"}
    plain = lambda text, spans: (text, [(s[0], s[1], s[2]) for s in spans])
    assert sorted((plain(r["text"], r["spans"]) for r in found), key=repr) == sorted(((t, brute_spans(t or "")) for _, t in rows), key=repr)
    empty = df.limit(0)
    assert sanitise(empty, fit(empty)).collect() == []


def test_overlaps_are_replaced_once():
    spans = [("a", 0, 4, "[a]"), ("b", 2, 6, "[b]"), ("c", 6, 7, "[c]")]
    assert rewrite("0123456789", spans) == "[a][c]789"
    assert disclosure.rewrite("", []) == ""
