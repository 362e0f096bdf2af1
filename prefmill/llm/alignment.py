"""Which tokens of two tokenizers go together, counted over a corpus.

Both tokenizers spell the same bytes, so the places where a token of either ends cut a text into
groups, and the two tokens that end at such a place are linked. A first pass over the documents
tallies linked pairs of ids. Their distinct pairs get a minimal perfect hash: levels of bits, where a
pair takes the first level at which no other falls on its bit, and its index is the number of bits set before.
Counts are then dense vectors indexed by that hash. Every task fills vectors of its own, and these
are summed in a tree. A table of pairs in index order verifies each look-up, since the hash gives any
strange pair an index too. A second pass aligns the documents again and looks the counts up.

Pairs are hashed into shards of about ``SHARD_PAIRS``, each with a hash and a vector of its own. Shards
are broadcast, at most ``max_pairs`` pairs at a time; further pairs take further passes.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

import prefmill.shipping  # noqa: F401
from prefmill.llm.common import quoted, text_of
from prefmill.llm.pieces import MARK, PieceCoder, groups
from prefmill.session import materialise, with_stable_row_id

SHARD_PAIRS = 1 << 16
#: Pairs that are broadcast at once: 24 bytes each.
MAX_PAIRS = 1 << 23
#: Distinct pairs that a task gathers before it hands them on.
HELD_PAIRS = 1 << 20
FAN_IN = 32
#: Texts are aligned in groups of about this many characters: the more, the more words repeat.
GROUP_CHARS = 1 << 21
LEVELS = 40
#: The fast encoder's pattern runs out of stack over some 10^6 blanks in a row; the slow one takes any number.
MANY_BLANKS = 1 << 16
HELD_WORDS = 1 << 19
ROW = "_row"


# -- tokenizers --------------------------------------------------------------------------


def byte_of_character() -> dict[str, int]:
    """The bytes that characters of a byte-level vocabulary stand for.

    Printable characters stand for themselves, the other bytes in order for those from 256 on.
    """
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteTokens:
    """Ids and byte lengths of a byte-level BPE, given as a tokenizers file and its splitting pattern."""

    def __init__(self, file: bytes, pattern: str):
        spec = json.loads(file)
        model, added = spec["model"], {t["content"] for t in spec["added_tokens"]}
        letters = byte_of_character()
        ranks = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if t not in added}
        first = len(ranks) - len(model["merges"])
        for at, merge in enumerate(model["merges"]):
            parts = merge.split(" ") if isinstance(merge, str) else merge
            if model["vocab"]["".join(parts)] != first + at:
                raise ValueError("ids must follow the order of merges")
        self.coder = tiktoken.Encoding("aligned", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.file, self.slow, self.blanks = file, None, re.compile(r"\s{%d}" % MANY_BLANKS)
        self.spelled = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.spelled[i] = token

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of a space and each text in a row, tokens a text, and whether they spell it."""
        ids = [
            self._slowly(" " + t) if len(t) >= MANY_BLANKS and self.blanks.search(t)
            else self.coder.encode_ordinary(" " + t)
            for t in texts
        ]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        # Merges of bytes never lose one: what the tokens spell is the text.
        return np.fromiter(chain.from_iterable(ids), np.int64, int(size.sum())), size, np.ones(len(ids), dtype=bool)

    def _slowly(self, text: str) -> list[int]:
        if self.slow is None:
            self.slow = Tokenizer.from_buffer(self.file)
            self.slow.encode_special_tokens = True  # their strings in a text are ordinary text
        return self.slow.encode(text, add_special_tokens=False).ids


class PieceTokens:
    """Ids and byte lengths of a sentencepiece model that puts a space in front.

    No piece reaches over the start of a word, so each distinct word of some texts is encoded once, and
    up to ``HELD_WORDS`` are kept for the next.
    """

    def __init__(self, model: bytes):
        self.coder = PieceCoder(model)
        if self.coder.map is not None or self.coder.squeeze or not self.coder.prefix or not self.coder.splits:
            raise ValueError("only models that keep the text as it is are supported")
        self.spelled = [
            bytes([int(piece[3:5], 16)]) if byte else piece.replace(MARK, " ").encode() for piece, byte in self.coder.pieces
        ]
        self.held: dict[str, tuple[list[int], bool]] = {}

    def _words(self, words: list[str]) -> list[tuple[list[int], bool]]:
        """The ids of each word with a space in front, and whether they spell it."""
        held = self.held
        if len(held) > HELD_WORDS:
            held.clear()
        new = [MARK + w for w in words if w not in held]
        for word, ids in zip(new, self.coder.merger.encode(new, num_threads=1) if new else []):
            held[word[len(MARK) :]] = ids, b"".join(map(self.spelled.__getitem__, ids)) == word.replace(MARK, " ").encode()
        return [held[w] for w in words]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of each text in a row, tokens a text, and whether they spell it with a space in front."""
        if not texts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, dtype=bool)
        known = [t.encode("utf-8", "replace").decode() for t in texts]
        # A word begins at each space that follows something else. Nearly always that is every space.
        plain = [not (t.startswith(" ") or "  " in t or MARK in t) for t in known]
        split = pc.split_pattern(pa.array([t if p else "" for t, p in zip(known, plain)], pa.large_string()), " ")
        if all(plain):
            values, count = split.flatten(), np.diff(split.offsets.to_numpy())
        else:
            own = split.to_pylist()
            for i in np.flatnonzero(~np.array(plain)):
                own[i] = [w[len(MARK) :] for w in self.coder.segments(MARK + known[i].replace(" ", MARK))]
            values, count = pa.array(chain.from_iterable(own), pa.large_string()), np.fromiter(map(len, own), np.int64, len(own))
        coded = values.dictionary_encode()
        codes = coded.indices.to_numpy()
        ids, right = zip(*self._words(coded.dictionary.to_pylist()))
        right = np.array(right)
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.int64, int(lengths.sum()))
        begins, wanted = np.cumsum(lengths) - lengths, lengths[codes]
        ends = np.cumsum(wanted)
        joined = flat[np.repeat(begins[codes] - (ends - wanted), wanted) + np.arange(int(wanted.sum()))]
        edges = np.cumsum(count)
        size = np.diff(np.concatenate([[0], ends])[np.concatenate([[0], edges])])
        wrong = np.concatenate([[0], np.cumsum(~right[codes])])
        spelled = np.diff(wrong[np.concatenate([[0], edges])]) == 0
        return joined, size, spelled & np.array([MARK not in t for t in known])


@dataclass
class Aligned:
    """Tokens of some texts in a row: ids, tokens a text, and the pairs of tokens that end together."""

    ids: tuple[np.ndarray, np.ndarray]
    sizes: tuple[np.ndarray, np.ndarray]
    last: tuple[np.ndarray, np.ndarray]  # of each group, as places in ids
    links: np.ndarray  # groups of each text


class Aligner:
    def __init__(self, left: ByteTokens, right: PieceTokens):
        self.sides = (left, right)
        self.lengths = [np.array([len(t) for t in side.spelled], dtype=np.int64) for side in self.sides]
        self.width = len(right.spelled)

    def align(self, texts: list[str]) -> Aligned:
        """Texts that either side cannot spell, and empty ones, have no tokens."""
        coded = [side.encode(texts) for side in self.sides]
        kept = np.array([bool(t) for t in texts], dtype=bool) & coded[0][2] & coded[1][2]
        flat, sizes, ends = [], [], []
        for (ids, size, _), lengths in zip(coded, self.lengths):
            joined = ids if kept.all() else ids[np.repeat(kept, size)]
            flat.append(joined), sizes.append(np.where(kept, size, 0)), ends.append(np.cumsum(lengths[joined]))
        last, hits = [], []
        for own, other in ((0, 1), (1, 0)):
            marked = np.zeros(int(ends[0][-1]) + 1 if len(ends[0]) else 1, dtype=bool)
            marked[ends[other]] = True
            hits.append(marked[ends[own]])
            last.append(np.flatnonzero(hits[-1]))
        upto = np.concatenate([[0], np.cumsum(hits[0])])
        return Aligned(tuple(flat), tuple(sizes), tuple(last), np.diff(upto[np.cumsum([0, *sizes[0]])]))

    def keys(self, aligned: Aligned) -> np.ndarray:
        """The pair of ids of each link as one number."""
        (a, b), (i, j) = aligned.ids, aligned.last
        return a[i] * self.width + b[j]


@dataclass(frozen=True)
class Tokenizers:
    """Files of the two tokenizers, read on the driver; they travel with the task."""

    left: bytes
    pattern: str
    right: bytes

    @classmethod
    def read(cls, left: str, pattern: str, right: str) -> Tokenizers:
        with open(left, "rb") as a, open(right, "rb") as b:
            return cls(a.read(), pattern, b.read())

    def aligner(self) -> Aligner:
        return Aligner(ByteTokens(self.left, self.pattern), PieceTokens(self.right))


# -- minimal perfect hash ----------------------------------------------------------------


def scatter(keys: np.ndarray, level: int = 0) -> np.ndarray:
    """A 64-bit mix of numbers, one to one, another at each level."""
    x = keys.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (scatter(keys, LEVELS) % np.uint64(shards)).astype(np.int64)


class PerfectHash:
    """Numbers 0 to n - 1 for n distinct keys, in about four bits a key.

    Keys that find no bit of their own on any level, of which there are hardly ever any, are listed.
    """

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray):
        self.levels, self.rest = levels, rest
        self.before, at = [], 0
        for words in levels:
            counts = np.bitwise_count(words).astype(np.int64)
            self.before.append(at + np.cumsum(counts) - counts)
            at += int(counts.sum())
        self.found = at

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], keys
        while len(left) and len(levels) < LEVELS:
            words = max(1, -(-3 * len(left) // 128))  # one and a half bits a key
            bit = (scatter(left, len(levels)) % np.uint64(64 * words)).astype(np.int64)
            alone = np.bincount(bit, minlength=64 * words) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            left = left[~alone[bit]]
        return cls(levels, np.sort(left))

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; that of a strange key is -1 or any."""
        found = np.full(len(keys), -1, dtype=np.int64)
        open_ = np.arange(len(keys))
        for level, (words, before) in enumerate(zip(self.levels, self.before)):
            bit = scatter(keys[open_], level) % np.uint64(64 * len(words))
            word, shift = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
            own = words[word]
            hit = (own >> shift) & np.uint64(1) == 1
            below = own[hit] & ((np.uint64(1) << shift[hit]) - np.uint64(1))
            found[open_[hit]] = before[word[hit]] + np.bitwise_count(below)
            open_ = open_[~hit]
        if len(self.rest) and len(open_):
            at = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            known = self.rest[at] == keys[open_]
            found[open_[known]] = self.found + at[known]
        return found

    def __len__(self) -> int:
        return self.found + len(self.rest)

    def to_bytes(self) -> bytes:
        head = np.array([len(self.levels), *map(len, self.levels)], dtype="<i8")
        return b"".join([head.tobytes(), *[w.tobytes() for w in self.levels], self.rest.astype("<i8").tobytes()])

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectHash:
        numbers = np.frombuffer(data, dtype="<i8")
        sizes = numbers[1 : 1 + numbers[0]]
        ends = 1 + len(sizes) + np.cumsum(sizes)
        words = np.frombuffer(data, dtype="<u8")
        return cls([words[e - s : e] for e, s in zip(ends, sizes)], numbers[ends[-1] if len(ends) else 1 :])


# -- counting ----------------------------------------------------------------------------

PAIRS = "key bigint, count bigint"
HASHES = "shard bigint, hash binary, keys binary"
VECTORS = "shard bigint, node bigint, counts binary"


def tally(df: DataFrame, tokenizers: Tokenizers, text: str) -> DataFrame:
    """Linked pairs of ids and how often each was seen, combined within tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = tokenizers.aligner()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def combined() -> tuple[np.ndarray, np.ndarray]:
            keys, place = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            counts = np.zeros(len(keys), dtype=np.int64)
            np.add.at(counts, place, np.concatenate([c for _, c in held]))
            return keys, counts

        def out(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["key", "count"])

        for batch in batches:
            for part in groups((t.as_py() for t in batch.column(0)), GROUP_CHARS):
                held.append(np.unique(aligner.keys(aligner.align(part)), return_counts=True))
                size += len(held[-1][0])
                if size > 2 * HELD_PAIRS:
                    held = [combined()]
                    size = len(held[0][0])
                    if size > HELD_PAIRS:
                        yield out(*held.pop())
                        size = 0
        if held:
            yield out(*combined())

    return df.select(text_of(quoted(text))).mapInArrow(run, PAIRS)


@dataclass
class PairCounts:
    """How often each pair of ids is linked in a corpus: perfect hashes and dense vectors, by shard.

    ``table`` has a row for each shard: its hash, its pairs in index order and their counts.
    """

    tokenizers: Tokenizers
    shards: int
    pairs: int
    table: DataFrame

    def parts(self, max_pairs: int) -> list[tuple[int, int]]:
        """Ranges of shards that hold about ``max_pairs`` pairs each."""
        wide = max(1, self.shards * max_pairs // max(1, self.pairs))
        return [(s, min(s + wide, self.shards)) for s in range(0, self.shards, wide)]

    def rows(self) -> DataFrame:
        """left_id, right_id, count."""
        width = len(PieceTokens(self.tokenizers.right).spelled)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    keys, counts = np.frombuffer(row["keys"], "<i8"), np.frombuffer(row["counts"], "<i8")
                    columns = [pa.array(c) for c in (keys // width, keys % width, counts)]
                    yield pa.RecordBatch.from_arrays(columns, names=["left_id", "right_id", "count"])

        return self.table.mapInArrow(run, "left_id bigint, right_id bigint, count bigint")


def hash_shards(pairs: DataFrame, shards: int) -> DataFrame:
    """A perfect hash of each shard's distinct pairs, and these in index order."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard = pa.array(shard_of(batch.column(0).to_numpy(), shards))
            yield pa.RecordBatch.from_arrays([shard, batch.column(0)], names=["shard", "key"])

    def build(group: pa.Table) -> pa.Table:
        keys = np.sort(group.column("key").to_numpy())
        found = PerfectHash.build(keys)
        ordered = np.empty(len(keys), dtype="<i8")
        ordered[found.index(keys)] = keys
        columns = [group.column("shard").slice(0, 1), pa.array([found.to_bytes()]), pa.array([ordered.tobytes()])]
        return pa.table(columns, names=["shard", "hash", "keys"])

    return pairs.select("key").mapInArrow(place, "shard bigint, key bigint").groupBy("shard").applyInArrow(build, HASHES)


def dense_counts(pairs: DataFrame, hashes: DataFrame, shards: int, part: tuple[int, int]) -> DataFrame:
    """The counts of each shard of one part, summed up in a tree: (shard, counts)."""
    spark = pairs.sparkSession
    first, last = part
    known = hashes.filter(F.col("shard").between(first, last - 1)).select("shard", "hash").collect()
    sent = spark.sparkContext.broadcast({row["shard"]: bytes(row["hash"]) for row in known})

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookups: dict[int, PerfectHash] = {}
        vectors: dict[int, np.ndarray] = {}
        for batch in batches:
            keys, counts = (c.to_numpy() for c in batch.columns)
            shard = shard_of(keys, shards)
            order = np.argsort(shard, kind="stable")
            edges = np.flatnonzero(np.diff(shard[order], prepend=-1, append=-1))
            for begin, end in zip(edges[:-1], edges[1:]):
                own = order[begin:end]
                s = int(shard[own[0]])
                if not first <= s < last:
                    continue
                if s not in vectors:
                    lookups[s] = PerfectHash.from_bytes(sent.value[s])
                    vectors[s] = np.zeros(len(lookups[s]), dtype="<i8")
                np.add.at(vectors[s], lookups[s].index(keys[own]), counts[own])
        node = TaskContext.get().partitionId()
        for s, vector in vectors.items():
            columns = [pa.array([s]), pa.array([node], pa.int64()), pa.array([vector.tobytes()])]
            yield pa.RecordBatch.from_arrays(columns, names=["shard", "node", "counts"])

    def add(group: pa.Table) -> pa.Table:
        vectors = group.column("counts")
        total = np.frombuffer(vectors[0].as_py(), "<i8").copy()
        for other in range(1, len(vectors)):
            total += np.frombuffer(vectors[other].as_py(), "<i8")
        columns = [group.column("shard").slice(0, 1), group.column("node").slice(0, 1), pa.array([total.tobytes()])]
        return pa.table(columns, names=["shard", "node", "counts"])

    summed, nodes = pairs.mapInArrow(fill, VECTORS), pairs.rdd.getNumPartitions()
    while True:
        nodes = -(-nodes // FAN_IN)
        up = summed.withColumn("node", F.expr(f"node div {FAN_IN}"))
        summed = up.groupBy("shard", "node").applyInArrow(add, VECTORS)
        if nodes <= 1:
            return summed.select("shard", "counts")


def count_pairs(
    df: DataFrame, tokenizers: Tokenizers, text: str = "text", max_pairs: int = MAX_PAIRS,
    shard_pairs: int = SHARD_PAIRS,
) -> PairCounts:
    """The first pass: how often each pair of ids is linked, over all texts.

    What a task hands on are distinct pairs with their counts, so hot pairs are combined first. Texts that
    are null, empty or not spelled alike by both tokenizers, and so empty tables, add nothing.
    """
    spark = df.sparkSession
    seen = materialise(tally(df, tokenizers, text), "link-tallies")
    distinct = materialise(seen.select("key").distinct(), "link-pairs")
    pairs = distinct.count()
    shards = max(1, -(-pairs // shard_pairs))
    hashes = materialise(hash_shards(distinct, shards), "link-hashes")
    counts = PairCounts(tokenizers, shards, pairs, hashes)
    summed = None
    for part in counts.parts(max_pairs):
        own = materialise(dense_counts(seen, hashes, shards, part), "link-counts")
        summed = own if summed is None else summed.unionByName(own)
    counts.table = materialise(hashes.join(summed, "shard"), "link-table")
    return counts


class Lookup:
    """Counts of pairs from the shards of one part; a pair that is not among them counts nothing."""

    def __init__(self, shards: int, rows: list[tuple[int, bytes, bytes, bytes]]):
        self.shards = shards
        self.known = {
            s: (PerfectHash.from_bytes(h), np.frombuffer(k, "<i8"), np.frombuffer(c, "<i8")) for s, h, k, c in rows
        }

    def counts(self, keys: np.ndarray) -> np.ndarray:
        found = np.zeros(len(keys), dtype=np.int64)
        shard = shard_of(keys, self.shards)
        for s, (hashed, pairs, counts) in self.known.items():
            own = np.flatnonzero(shard == s)
            at = hashed.index(keys[own])
            valid = (at >= 0) & (at < len(pairs))
            valid[valid] = pairs[at[valid]] == keys[own][valid]
            found[own[valid]] = counts[at[valid]]
        return found


def best_counts(counts: PairCounts, width: int) -> np.ndarray:
    """The highest count of any pair with each right id: one number for each id of that vocabulary."""
    best = np.zeros(width, dtype=np.int64)
    top = counts.rows().groupBy("right_id").agg(F.max("count").alias("count"))
    for row in top.collect():  # bounded by the vocabulary
        best[row["right_id"]] = row["count"]
    return best


TOKENS = T.ArrayType(T.IntegerType())
GROUPS = T.ArrayType(T.StructType([T.StructField("left", TOKENS), T.StructField("right", TOKENS)]))


def results(written: bool) -> list[T.StructField]:
    numbers = ("n_left", "n_right", "n_groups", "n_links", "n_best", "count_sum")
    return [*[T.StructField(n, T.LongType()) for n in numbers], T.StructField("groups", T.StringType() if written else GROUPS)]


def group_lists(aligned: Aligned) -> list[pa.ListArray]:
    """The ids of each group, left and right."""
    return [
        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], last + 1]), pa.int32()), pa.array(ids.astype(np.int32)))
        for ids, last in zip(aligned.ids, aligned.last)
    ]


class GroupWriter:
    """Writes the groups of a text as ``1,2|3;4|5,6``: left ids, right ids."""

    def __init__(self, left: int, right: int):
        signs = [("," , "|"), (",", ";")]
        self.behind = 2 * left  # where the right side's begin
        self.table = pa.array(
            [f"{i}{sign}" for width, pair in zip((left, right), signs) for i in range(width) for sign in pair], pa.large_string()
        )

    def write(self, aligned: Aligned) -> list[str]:
        """Every token is its id and a sign, which tells the last of a group; all in a row, then cut into texts."""
        (a, b), (last_a, last_b) = aligned.ids, aligned.last
        ends = [np.concatenate([[0], last + 1]) for last in aligned.last]
        codes = [2 * a, self.behind + 2 * b]
        codes[0][last_a] += 1
        codes[1][last_b] += 1
        row = np.empty(len(a) + len(b), dtype=np.int64)
        row[np.arange(len(a)) + np.repeat(ends[1][:-1], np.diff(ends[0]))] = codes[0]
        row[np.arange(len(b)) + np.repeat(ends[0][1:], np.diff(ends[1]))] = codes[1]
        spelled = self.table.take(pa.array(row))
        offsets = np.frombuffer(spelled.buffers()[1], np.int64)[: len(row) + 1]
        data = memoryview(spelled.buffers()[2]) if len(row) else b""
        edges = offsets[np.cumsum([0, *(aligned.sizes[0] + aligned.sizes[1])])]
        return [bytes(data[s : e - 1]).decode() if e > s else "" for s, e in zip(edges[:-1].tolist(), edges[1:].tolist())]


def _part_rows(
    df: DataFrame, counts: PairCounts, text: str, kept: list[str], part: tuple[int, int], best, written: bool,
) -> DataFrame:
    spark = df.sparkSession
    shards = counts.table.filter(F.col("shard").between(part[0], part[1] - 1))
    sent = spark.sparkContext.broadcast(
        [(r["shard"], bytes(r["hash"]), bytes(r["keys"]), bytes(r["counts"])) for r in shards.collect()]
    )
    tokenizers, number = counts.tokenizers, counts.shards
    columns = [F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(kept)]  # whatever they are called
    schema = T.StructType([*[df.schema[c] for c in kept], *results(written)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target, aligner = to_arrow_schema(schema), tokenizers.aligner()
        lookup, highest = Lookup(number, sent.value), best.value
        writer = GroupWriter(*map(len, aligner.lengths)) if written else None
        for batch in batches:
            at = 0
            for part in groups((t.as_py() for t in batch.column(len(kept))), GROUP_CHARS):
                found = aligner.align(part)
                keys, place = np.unique(aligner.keys(found), return_inverse=True)
                count = lookup.counts(keys)
                top = (count > 0) & (count == highest[keys % aligner.width])
                edges = np.concatenate([[0], np.cumsum(found.links)])
                running = np.concatenate([[0], np.cumsum(count[place])])
                tops = np.concatenate([[0], np.cumsum(top[place])])
                if written:
                    spelled = pa.array(writer.write(found), pa.string())
                else:
                    nested = pa.StructArray.from_arrays(group_lists(found), ["left", "right"])
                    spelled = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), nested)
                own = [
                    *[pa.array(s) for s in found.sizes],
                    *[pa.array(found.links)] * 2,
                    pa.array(tops[edges[1:]] - tops[edges[:-1]]),
                    pa.array(running[edges[1:]] - running[edges[:-1]]),
                    spelled,
                ]
                rows = batch.slice(at, len(part))
                values = [*[rows.column(i) for i in range(len(kept))], *own]
                yield pa.RecordBatch.from_arrays([v.cast(f.type) for v, f in zip(values, target)], schema=target)
                at += len(part)

    return df.select(*columns, text_of(quoted(text)).alias("text")).mapInArrow(run, schema)


def align_documents(
    df: DataFrame, counts: PairCounts, text: str = "text", keep: list[str] | None = None, max_pairs: int = MAX_PAIRS,
    written: bool = False,
) -> DataFrame:
    """The second pass: columns ``keep`` (all by default), ``n_left`` and ``n_right`` (tokens), ``n_groups``, ``n_links``
    (one a group: the tokens that end it), ``n_best`` (links whose pair is the most frequent of its right
    id), ``count_sum`` (of the links' counts) and ``groups`` (the ids of both sides in each; ``written`` makes it
    one text, as in ``1,2|3;4|5,6``).

    A text that is null, empty or not spelled alike by both tokenizers has zeros and no groups. Rows of
    one key stay apart, and a null key is carried along; an input column that bears a result's name is
    replaced. Where the pairs do not fit into one broadcast of ``max_pairs``, the rows are written once, so that
    they have a lasting name, and every further part is another pass over them.
    """
    spark = df.sparkSession
    taken = {f.name for f in results(written)}
    kept = [c for c in (df.columns if keep is None else keep) if c not in taken]
    best = spark.sparkContext.broadcast(best_counts(counts, len(PieceTokens(counts.tokenizers.right).spelled)))
    parts = counts.parts(max_pairs)
    if len(parts) == 1:
        return _part_rows(df, counts, text, kept, parts[0], best, written)
    names = [f"c{i}" for i in range(len(kept))]
    plain = df.select(*[F.col(quoted(c)).alias(n) for n, c in zip(names, kept)], text_of(quoted(text)).alias("text"))
    named = with_stable_row_id(plain, "link-rows").withColumnRenamed("row_id", ROW)
    first, more = None, None
    for part in parts:
        if first is None:
            first = _part_rows(named, counts, "text", [*names, ROW], part, best, written)
            sums = first.select(ROW, "n_best", "count_sum")
        else:
            sums = _part_rows(named, counts, "text", [ROW], part, best, written).select(ROW, "n_best", "count_sum")
        sums = materialise(sums, "link-sums")
        more = sums if more is None else more.unionByName(sums)
    total = more.groupBy(ROW).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    whole = first.drop("n_best", "count_sum").join(total, ROW)
    return whole.select(
        *[F.col(n).alias(c) for n, c in zip(names, kept)], *[f.name for f in results(written)]
    )
