"""Token alignment against plain loops over the libraries' own encodings."""

import hashlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest

from prefmill.llm import alignment
from prefmill.llm.alignment import LEVELS, PerfectHash, Tokenizers, align_documents, byte_of_character, count_pairs
from prefmill.llm.queries import QUERIES, tokenizer

SF = "/root/testdata/sf0.001"
RESULTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def files():
    return Tokenizers.read(tokenizer("byte_bpe_50k.json"), public_tokenizers.PATTERN, tokenizer("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    left = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    left.encode_special_tokens = True
    return left, sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))


def brute(libraries, texts):
    left, right = libraries
    letters = byte_of_character()
    documents, counts = [], Counter()
    for text in texts:
        groups, links = [], []
        if text:
            a = left.encode(" " + text, add_special_tokens=False).ids
            b = right.encode(text)
            spelled_a = [bytes(letters[c] for c in left.id_to_token(i)) for i in a]
            spelled_b = [
                bytes([int(right.id_to_piece(i)[3:5], 16)]) if right.is_byte(i)
                else right.id_to_piece(i).replace("▁", " ").encode() for i in b
            ]
            if b"".join(spelled_a) == b"".join(spelled_b) == b" " + text.encode():
                i = j = ends_a = ends_b = from_a = from_b = 0
                while i < len(a) or j < len(b):
                    if ends_a <= ends_b:
                        ends_a += len(spelled_a[i])
                        i += 1
                    else:
                        ends_b += len(spelled_b[j])
                        j += 1
                    if ends_a == ends_b:
                        groups.append((a[from_a:i], b[from_b:j]))
                        links.append((a[i - 1], b[j - 1]))
                        from_a, from_b = i, j
        counts.update(links)
        documents.append((groups, links))
    best = Counter()
    for (_, b), c in counts.items():
        best[b] = max(best[b], c)
    rows = []
    for groups, links in documents:
        spelled = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        rows.append((
            sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links),
            sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links),
            hashlib.sha256(spelled.encode()).hexdigest() if groups else "",
        ))
    return rows, counts


def test_query_equals_plain_loops(spark, libraries):
    documents = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    expected, _ = brute(libraries, [t for _, t in documents])
    rows = {r["doc_id"]: tuple(r[c] for c in RESULTS) for r in QUERIES["op11_alignment"](spark, SF).collect()}
    assert rows == {d: row for (d, _), row in zip(documents, expected)}


ODD = [
    (1, None), (2, ""), (None, "the cat"), (3, "the cat"), (3, "the cat"), (4, " "), (5, "  \n\t x  "), (6, "a▁b"),
    (7, "日本語 \U0001f600 é"), (8, "<|endoftext|> <s> <0x41> </s>"), (9, "word " * 40_000), (10, "x" * 5_000), (11, "a\x00b"),
    (12, "▁"), (13, "don't  stop…"), (14, "x" + " " * 900_000 + "y  z"),
]


def plain(found):
    rows = []
    for r in found.collect():
        groups = [(g["left"], g["right"]) for g in r["groups"]]
        spelled = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        sha = hashlib.sha256(spelled.encode()).hexdigest() if groups else ""
        rows.append((r["text"], (r["n_left"], r["n_right"], len(groups), r["n_links"], r["n_best"], r["count_sum"], sha)))
    return sorted(rows, key=repr)


@pytest.mark.parametrize("shard_pairs, max_pairs", [(1 << 16, 1 << 23), (7, 20)])
def test_odd_rows_in_one_part_and_in_many(spark, files, libraries, shard_pairs, max_pairs):
    df = spark.createDataFrame([(i, t, i, 1) for i, t in ODD], "doc_id bigint, text string, key bigint, n_left int")
    df = df.repartition(3).withColumnRenamed("key", "a.b")
    counts = count_pairs(df, files, max_pairs=max_pairs, shard_pairs=shard_pairs)
    assert (len(counts.parts(max_pairs)) > 1) == (shard_pairs == 7)
    found = align_documents(df, counts, max_pairs=max_pairs)
    assert found.columns[:3] == ["doc_id", "text", "a.b"] and found.columns.count("n_left") == 1
    expected, pairs = brute(libraries, [t for _, t in ODD])
    assert plain(found) == sorted(((t, row) for (_, t), row in zip(ODD, expected)), key=repr)
    assert {(r["left_id"], r["right_id"]): r["count"] for r in counts.rows().collect()} == dict(pairs)


def test_empty_table(spark, files):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    counts = count_pairs(df, files)
    assert counts.pairs == 0 and counts.rows().collect() == []
    assert align_documents(df, counts).collect() == []


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 100_000])
def test_perfect_hash(n):
    keys = np.unique(np.random.default_rng(3).integers(0, 1 << 40, n))
    built = PerfectHash.build(keys)
    for hashed in (built, PerfectHash.from_bytes(built.to_bytes())):
        assert len(hashed) == len(keys)
        assert sorted(hashed.index(keys).tolist()) == list(range(len(keys)))
    if n == 100_000:
        assert len(built.to_bytes()) * 8 < 4.5 * n
        lookup = alignment.Lookup(1, [(0, built.to_bytes(), _ordered(built, keys), np.ones(len(keys), "<i8").tobytes())])
        strange = np.setdiff1d(np.arange(50_000), keys)
        assert lookup.counts(keys).sum() == len(keys) and lookup.counts(strange).sum() == 0


def _ordered(hashed, keys):
    ordered = np.empty(len(keys), "<i8")
    ordered[hashed.index(keys)] = keys
    return ordered.tobytes()


def test_keys_without_a_bit_are_listed(monkeypatch):
    monkeypatch.setattr(alignment, "LEVELS", 1)
    keys = np.arange(500)
    hashed = PerfectHash.from_bytes(PerfectHash.build(keys).to_bytes())
    assert len(hashed.rest) and sorted(hashed.index(keys).tolist()) == list(range(500))
    assert LEVELS == 40
