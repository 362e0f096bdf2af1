"""Language-model scoring with n-gram tries in Elias-Fano form, trained on the documents themselves.

The model is a trigram model with Witten-Bell smoothing. An n-gram of two or three tokens is kept from
its second occurrence on; what the others would have got goes to the shorter context:

    P(w | u v) = a(u v w) + l(u v) * (a(v w) + l(v) * P(w)),   a = count / (context count + distinct followers)

where l makes the sum over all words one, P(w) = c(w) / (N + V), and unknown words have V / (N + V) together. As many
unknown words are allowed for as there are known ones, and the end: each has 1 / (V + 1) of that. From which occurrence on
n-grams count is a parameter, two by default.

The model is cut by its middle word v into shards, so that one shard holds the whole path of any
trigram and no task needs all of the model. Documents are tokenised into chunks of about two million
tokens. A chunk sends each of its distinct trigrams once, packed, to their shards; a shard
adds up the counts of all chunks, builds its trie, answers every chunk from it, and the chunk sums its
documents. Shards grow in number with the text. A word so frequent that a shard would grow too large is
split twice: its trigrams by the word before it, so that a context (u, v) lies in one place as a whole; its bigrams by the
word behind, so that every count of (v, w) is whole too. What the bigrams of a split word add up to is gathered
from its buckets, two numbers a bucket, and goes to all tasks. So scores are those of a model that is not split.

A shard's trie has four monotone sequences in Elias-Fano form: middle words; the successors of
each; the predecessors with which each forms a context; and the successors of each context. The last
are not stored as words but relative to the context: as positions among the successors of the middle
word. Pointers between levels are monotone and coded alike; probabilities are quantised
logarithms. Levels are files that a task maps into memory.

Words are known by 64-bit hashes, and neighbours of a given word by 32 bits of theirs.
"""

from __future__ import annotations

import math
import os
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

import prefmill.shipping  # noqa: F401
from prefmill.llm.common import crc_fold, quoted, small_batches, text_of
from prefmill.session import materialise, scratch_path

FOLDS, HELD_FOLD = 7, 2
CHUNK_TOKENS = 1 << 21
SHARD_BYTES = 6 << 20
#: A word is split as a context beyond this many tokens, or this share of all if that is more;
#: so at most HOT_WORDS words are.
HOT_TOKENS, HOT_WORDS = 1 << 20, 1 << 16
MIN_COUNT = 2
#: What a key of a shard holds: a word's contexts, or of a split word a bucket of its trigrams or of its bigrams.
PLAIN, TRIGRAMS, BIGRAMS = 0, 1, 2
STEPS = 512  # of a code, per power of ten; codes take up to 16 bits, mostly fewer
NOTHING = 65535
END = b""
HASHED_AT_ONCE = 1 << 18
ONE = np.uint64(1)


# -- packing ------------------------------------------------------------------------------


def pack_arrays(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value; bytes of equal rank lie together."""
    parts = []
    for a in arrays:
        parts.append(f"{a.dtype.str}:{len(a)};".encode())
        parts.append(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes() if len(a) else b"")
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack_arrays(data: bytes) -> list[np.ndarray]:
    raw, at, found = zstandard.ZstdDecompressor().decompress(data), 0, []
    while at < len(raw):
        end = raw.index(b";", at)
        kind, n = raw[at:end].decode().split(":")
        kind, n = np.dtype(kind), int(n)
        at = end + 1
        planes = np.frombuffer(raw, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        found.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += n * kind.itemsize
    return found


def steps_of(values: np.ndarray) -> np.ndarray:
    """Differences of neighbours, modulo the type's range: small where values are sorted."""
    return np.diff(values, prepend=values.dtype.type(0))


def from_steps(steps: np.ndarray) -> np.ndarray:
    return np.cumsum(steps, dtype=steps.dtype)


def to_codes(p: np.ndarray) -> np.ndarray:
    """Probabilities as logarithms in steps, in 16 bits."""
    with np.errstate(divide="ignore"):
        steps = np.round(-np.log10(p) * STEPS)
    return np.where(p > 0, np.clip(steps, 0, NOTHING - 1), NOTHING).astype(np.uint16)


def from_codes(codes: np.ndarray) -> np.ndarray:
    return np.where(codes == NOTHING, 0.0, 10.0 ** (codes / -STEPS))


# -- Elias-Fano sequences and the trie of a shard -----------------------------------------


@dataclass
class EliasFano:
    """A sorted sequence below ``universe``: low bits as they are, high bits in unary."""

    size: int
    width: int
    low: np.ndarray  # one packed plane of bits for each of ``width``
    high: np.ndarray

    @staticmethod
    def encode(values: np.ndarray, universe: int) -> EliasFano:
        values, n = values.astype(np.uint64), len(values)
        width = max(0, (universe // max(1, n)).bit_length() - 1)
        planes = [np.packbits((values >> np.uint64(b) & ONE).astype(np.uint8)) for b in range(width)]
        tops = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        unary = np.zeros((int(tops[-1]) if n else 0) + 1, dtype=np.uint8)
        unary[tops] = 1
        return EliasFano(n, width, np.concatenate(planes) if planes else np.zeros(0, np.uint8), np.packbits(unary))

    def values(self) -> np.ndarray:
        n = self.size
        tops = np.flatnonzero(np.unpackbits(np.asarray(self.high)))[:n] - np.arange(n)
        found = tops.astype(np.uint64) << np.uint64(self.width)
        for b, plane in enumerate(np.asarray(self.low).reshape(self.width, (n + 7) // 8)):
            found |= np.unpackbits(plane, count=n).astype(np.uint64) << np.uint64(b)
        return found

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Where each key is, or -1: the successor of a key is looked up and compared."""
        values = self.values()
        if not len(values):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(values, keys), len(values) - 1)
        return np.where(values[at] == keys, at, -1)


@dataclass
class Trie:
    """The levels of a shard; see the module's docstring."""

    middles: EliasFano
    followers: EliasFano  # middle << 32 | word
    follower_at: EliasFano  # first follower of each middle, and the end
    contexts: EliasFano  # middle << 32 | word before
    relative: EliasFano  # context * reach + position among the middle's followers
    reach: int
    follower_codes: np.ndarray
    middle_codes: np.ndarray
    relative_codes: np.ndarray
    context_codes: np.ndarray

    SEQUENCES = ("middles", "followers", "follower_at", "contexts", "relative")
    CODES = ("follower_codes", "middle_codes", "relative_codes", "context_codes")

    def arrays(self) -> list[np.ndarray]:
        heads = [self.reach]
        for name in self.SEQUENCES:
            heads += [getattr(self, name).size, getattr(self, name).width]
        parts = [np.array(heads, dtype=np.int64)]
        for name in self.SEQUENCES:
            parts += [getattr(self, name).low, getattr(self, name).high]
        return parts + [getattr(self, name) for name in self.CODES]

    @staticmethod
    def of(arrays: list[np.ndarray]) -> Trie:
        heads = arrays[0].tolist()
        sequences = [
            EliasFano(heads[1 + 2 * i], heads[2 + 2 * i], arrays[1 + 2 * i], arrays[2 + 2 * i]) for i in range(5)
        ]
        return Trie(*sequences, heads[0], *arrays[11:15])

    def save(self, folder: str) -> None:
        for i, array in enumerate(self.arrays()):
            np.save(f"{folder}/{i}.npy", array)

    @staticmethod
    def mapped(folder: str) -> Trie:
        return Trie.of([np.load(f"{folder}/{i}.npy", mmap_mode="r") for i in range(len(os.listdir(folder)))])

    def ask(
        self, keys: np.ndarray, key_of: np.ndarray, before: np.ndarray, word: np.ndarray, kind: np.ndarray | None = None,
    ) -> tuple[np.ndarray, np.ndarray]:
        """Factors (A, B) with P(word) = A + B * P1(word), for trigrams (before, keys[key_of], word).

        For keys that hold the trigrams of a split word, P2 takes the place of P1. For those that hold its bigrams, A is
        a word's share of its bucket.
        """
        kind = np.zeros(len(keys), dtype=np.uint8) if kind is None else kind
        middle = self.middles.find(keys)[key_of]
        hit = np.flatnonzero(middle >= 0)
        m = middle[hit].astype(np.uint64)
        follower = self.followers.find(m << np.uint64(32) | word[hit])
        context = self.contexts.find(m << np.uint64(32) | before[hit])
        a2 = np.zeros(len(hit))
        a2[follower >= 0] = from_codes(np.asarray(self.follower_codes)[follower[follower >= 0]])
        l2 = from_codes(np.asarray(self.middle_codes)[middle[hit]])
        split = kind[key_of[hit]] == TRIGRAMS
        a2[split], l2[split] = 0.0, 1.0
        a3, l3 = np.zeros(len(hit)), np.ones(len(hit))
        known = np.flatnonzero(context >= 0)
        l3[known] = from_codes(np.asarray(self.context_codes)[context[known]])
        both = known[follower[known] >= 0]
        rank = follower[both] - self.follower_at.values().astype(np.int64)[middle[hit][both]]
        at = self.relative.find((context[both] * self.reach + rank).astype(np.uint64))
        a3[both[at >= 0]] = from_codes(np.asarray(self.relative_codes)[at[at >= 0]])
        a, b = np.zeros(len(middle)), np.ones(len(middle))
        a[hit], b[hit] = a3 + l3 * a2, l3 * l2
        return a, b


def _sums(places: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    return np.bincount(places, weights=values, minlength=size)


def build_trie(
    keys: np.ndarray, key_of: np.ndarray, before: np.ndarray, word: np.ndarray, counts: np.ndarray,
    kind: np.ndarray | None = None, min_count: int = MIN_COUNT,
) -> tuple[Trie, np.ndarray, np.ndarray]:
    """The trie of all trigrams (before, keys[key_of], word), which may repeat, with their counts.

    Keys that hold bigrams have no contexts. Also returns what the bigrams of each key add up to, with
    one for each distinct word, and the share of it that is left to single words.
    """
    shift = np.uint64(32)
    own = key_of.astype(np.uint64) << shift
    pairs, pair_of = np.unique(own | word, return_inverse=True)
    whole = slice(None) if kind is None else kind[key_of] != BIGRAMS
    contexts, context_of = np.unique((own | before)[whole], return_inverse=True)
    triples, triple_of = np.unique(context_of.astype(np.uint64) << shift | pair_of[whole].astype(np.uint64), return_inverse=True)
    triple_context, triple_pair = (triples >> shift).astype(np.int64), (triples & np.uint64(0xFFFFFFFF)).astype(np.int64)
    pair_key = (pairs >> shift).astype(np.int64)
    c2, c3 = _sums(pair_of, counts, len(pairs)), _sums(triple_of, counts[whole], len(triples))

    def smoothed(c: np.ndarray, parent: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Kept entries, their probabilities, and what each parent leaves to the shorter context."""
        weight = _sums(parent, c, size) + _sums(parent, c > 0, size)
        kept = np.flatnonzero(c >= min_count)
        a = c[kept] / weight[parent[kept]]
        return kept, a, 1 - _sums(parent[kept], a, size), weight

    kept2, a2, left2, weight2 = smoothed(c2, pair_key, len(keys))
    kept3, a3, left3, _ = smoothed(c3, triple_context, len(contexts))
    middles = np.unique(pair_key[kept2])
    place = np.full(len(keys), -1)
    place[middles] = np.arange(len(middles))
    follower_key = place[pair_key[kept2]]
    ends = np.cumsum(np.bincount(follower_key, minlength=len(middles))) if len(middles) else np.zeros(0, np.int64)
    starts = np.concatenate([[0], ends]).astype(np.int64)
    pair_place = np.full(len(pairs), -1)
    pair_place[kept2] = np.arange(len(kept2))
    used = np.unique(triple_context[kept3])
    context_place = np.full(len(contexts), -1)
    context_place[used] = np.arange(len(used))
    context_key = place[(contexts[used] >> shift).astype(np.int64)]
    follower = pair_place[triple_pair[kept3]]
    rank = follower - starts[follower_key[follower]]
    reach = int(np.diff(starts).max()) if len(middles) else 1
    word_bits = np.uint64(0xFFFFFFFF)
    followers = follower_key.astype(np.uint64) << shift | pairs[kept2] & word_bits
    befores = context_key.astype(np.uint64) << shift | contexts[used] & word_bits
    relative = context_place[triple_context[kept3]] * reach + rank
    trie = Trie(
        EliasFano.encode(keys[middles], 1 << 64),
        EliasFano.encode(followers, max(1, len(middles)) << 32),
        EliasFano.encode(starts, len(kept2) + 1),
        EliasFano.encode(befores, max(1, len(middles)) << 32),
        EliasFano.encode(relative, max(1, len(used) * reach)),
        reach,
        to_codes(a2),
        to_codes(left2[middles]),
        to_codes(a3),
        to_codes(left3[used]),
    )
    return trie, weight2, left2


# -- chunks -------------------------------------------------------------------------------


def tokenise(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct tokens, frequent ones first, all tokens as places among them, tokens a text."""
    digest = xxhash.xxh64_intdigest
    parts, lengths, tokens = [], [], []

    def flush() -> None:
        coded = pa.array(tokens, pa.large_binary()).dictionary_encode()
        hashes = np.fromiter((digest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
        parts.append(hashes[coded.indices.to_numpy()])
        tokens.clear()

    for text in texts:
        words = (text or "").encode("utf-8", "replace").lower().split()
        tokens += words
        tokens.append(END)
        lengths.append(len(words) + 1)
        if len(tokens) > HASHED_AT_ONCE:  # 8 bytes a token are kept, not its object
            flush()
    flush()
    words, found = np.unique(np.concatenate(parts), return_inverse=True)
    order = np.argsort(-np.bincount(found, minlength=len(words)), kind="stable")
    rank = np.empty(len(words), dtype=np.uint32)
    rank[order] = np.arange(len(words), dtype=np.uint32)
    return words[order], rank[found], np.array(lengths, dtype=np.int64)


def read_chunk(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes, tokens as places among them, tokens a text, and which texts are held out."""
    words, tokens, lengths, held = unpack_arrays(data)
    order = np.argsort(words)
    place = np.empty(len(words), dtype=np.uint32)
    place[order] = np.arange(len(words), dtype=np.uint32)
    return words[order], place[tokens], lengths.astype(np.int64), held


@dataclass
class Windows:
    """The distinct trigrams of a chunk and the distinct bigrams of split words, in order of shard and key, and where
    each token's are (-1: its bigram is not apart)."""

    shard: np.ndarray
    key: np.ndarray
    kind: np.ndarray
    before: np.ndarray
    word: np.ndarray
    counts: np.ndarray
    of_token: np.ndarray
    pair_of_token: np.ndarray


def mixed(word: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """The key of a split word's bucket, counted from 1."""
    found = (word ^ bucket * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93)
    return found ^ found >> np.uint64(32)


def places_among(words: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Where each word is in the sorted list ``hot``, or -1."""
    if not len(hot):
        return np.full(len(words), -1)
    at = np.minimum(np.searchsorted(hot, words), len(hot) - 1)
    return np.where(hot[at] == words, at, -1)


def bucket_of(word: np.ndarray, number: np.ndarray) -> np.ndarray:
    return (word >> np.uint64(7)) % number + ONE


def windows(
    words: np.ndarray, tokens: np.ndarray, lengths: np.ndarray, learn: np.ndarray, shards: int,
    hot: np.ndarray, buckets: np.ndarray,
) -> Windows:
    """A document's tokens each with the two before it; the end stands in front of the first."""
    n = len(tokens)
    end = np.searchsorted(words, np.uint64(xxhash.xxh64_intdigest(END)))
    starts = np.cumsum(lengths) - lengths
    third = tokens.astype(np.int64)
    second = np.concatenate([[end], third[:-1]]) if n else third
    second[starts] = end
    first = np.concatenate([[end], second[:-1]]) if n else third
    first[starts] = end
    bits = max(1, int(len(words)).bit_length())
    if 3 * bits <= 63:
        packed = second << 2 * bits | first << bits | third
        del first, second, third
        packed, of_token = np.unique(packed, return_inverse=True)
        of_token = of_token.astype(np.int32)
        mask = (1 << bits) - 1
        second, first, third = packed >> 2 * bits, packed >> bits & mask, packed & mask
    else:  # a text of millions of words
        rows, of_token = np.unique(np.stack([second, first, third], axis=1), axis=0, return_inverse=True)
        second, first, third = rows.T
        of_token = of_token.ravel()
    counts = np.bincount(of_token, weights=np.repeat(learn, lengths), minlength=len(third)).astype(np.uint32)
    short = (words >> np.uint64(32)).astype(np.uint32)
    key, before, word = words[second], short[first], short[third]
    at = places_among(words, hot)[second]
    split = np.flatnonzero(at >= 0)
    kind = np.where(at >= 0, TRIGRAMS, PLAIN).astype(np.uint8)
    pair = np.full(len(third), -1)
    if len(split):
        number = buckets[at[split]]
        key[split] = mixed(key[split], bucket_of(words[first[split]], number))
        pairs, pair_of = np.unique(second[split] << 32 | third[split], return_inverse=True)
        v, w = pairs >> 32, pairs & 0xFFFFFFFF
        pair[split] = len(third) + pair_of
        key = np.concatenate([key, mixed(~words[v], bucket_of(words[w], buckets[places_among(words[v], hot)]))])
        kind = np.concatenate([kind, np.full(len(pairs), BIGRAMS, dtype=np.uint8)])
        before, word = np.concatenate([before, np.zeros(len(pairs), np.uint32)]), np.concatenate([word, short[w]])
        apart = np.bincount(pair_of, weights=counts[split], minlength=len(pairs)).astype(np.uint32)
        counts = np.concatenate([counts, apart])
    shard = (key % np.uint64(shards)).astype(np.int64)
    order = np.lexsort((key, shard))
    moved = np.empty(len(order) + 1, dtype=np.int32)
    moved[order] = np.arange(len(order), dtype=np.int32)
    moved[-1] = -1  # where -1 points
    return Windows(
        shard[order], key[order], kind[order], before[order], word[order], counts[order], moved[of_token], moved[pair[of_token]]
    )


def by_shard(words: np.ndarray, w: Windows, shards: int) -> Iterator[tuple[int, np.ndarray, int, int]]:
    """Each shard that a chunk has to do with: the places of its words, and the range of its windows."""
    home = (words % np.uint64(shards)).astype(np.int64)
    order = np.argsort(home, kind="stable")
    present = np.union1d(home, w.shard)
    sorted_home = home[order]
    words_at = np.searchsorted(sorted_home, present), np.searchsorted(sorted_home, present, side="right")
    windows_at = np.searchsorted(w.shard, present), np.searchsorted(w.shard, present, side="right")
    for i, shard in enumerate(present.tolist()):
        yield shard, order[words_at[0][i] : words_at[1][i]], windows_at[0][i], windows_at[1][i]


def _chunk_rows(batches: Iterator[pa.RecordBatch], schema: pa.Schema, share: float) -> Iterator[pa.RecordBatch]:
    """Documents (key, held, text) as chunks; ``top`` are a chunk's words with at least ``share`` of it."""
    part, number = TaskContext.get().partitionId(), 0
    keys, held, texts, size = [], [], [], 0

    def row() -> pa.RecordBatch:
        nonlocal keys, held, texts, size, number
        words, tokens, lengths = tokenise(texts)
        counts = np.bincount(tokens, minlength=len(words))
        top = np.flatnonzero(counts >= share * len(tokens))
        values = {
            "chunk": [part << 32 | number],
            "keys": [pa.concat_arrays(keys).to_pylist()],
            "size": [len(tokens)],
            "data": [pack_arrays(words, tokens, lengths.astype(np.uint32), np.concatenate(held))],
            "top": [words[top].view(np.int64).tolist()],
            "top_counts": [counts[top].tolist()],
        }
        keys, held, texts, size, number = [], [], [], 0, number + 1
        return pa.RecordBatch.from_pydict(values, schema=schema)

    for batch in batches:
        column = batch.column("text").to_pylist()
        sizes = np.cumsum([len(t or "") for t in column])
        start = 0
        while start < len(column):
            room = CHUNK_TOKENS * 6 - size + (sizes[start - 1] if start else 0)
            stop = max(start + 1, int(np.searchsorted(sizes, room, side="right")))
            keys.append(batch.column("key").slice(start, stop - start))
            held.append(batch.column("held").slice(start, stop - start).to_numpy(zero_copy_only=False).astype(np.uint8))
            texts += column[start:stop]
            size += int(sizes[min(stop, len(column)) - 1] - (sizes[start - 1] if start else 0))
            start = stop
            if size >= CHUNK_TOKENS * 6 or start < len(column):
                yield row()
    if texts:
        yield row()


def _shard_group(group: pa.Table, min_count: int) -> pa.Table:
    """A shard's words from all chunks: trie, what the bigrams of split words add up to, and an answer for each chunk."""
    shard = group.column("shard")[0].as_py()
    chunks = group.column("chunk").to_pylist()
    sent = [unpack_arrays(v.as_py()) for v in group.column("data")]
    for s in sent:
        s[0], s[3] = from_steps(s[0]), from_steps(s[3])
    keys = np.unique(np.concatenate([s[0] for s in sent]))
    places = [np.searchsorted(keys, s[0]) for s in sent]
    known = np.zeros(len(keys))
    kind = np.zeros(len(keys), dtype=np.uint8)
    for place, s in zip(places, sent):
        known[place] += s[2]
        kind[place] = np.maximum(kind[place], s[6])
    key_of = np.concatenate([np.repeat(p, s[1]) for p, s in zip(places, sent)])
    before, word, counts = (np.concatenate([s[i] for s in sent]) for i in (3, 4, 5))
    sizes = [len(s[3]) for s in sent]
    del sent
    before, word = before.astype(np.uint64), word.astype(np.uint64)
    with tempfile.TemporaryDirectory() as folder:
        built, weight, left = build_trie(keys, key_of, before, word, counts, kind, min_count)
        built.save(folder)
        trie = Trie.mapped(folder)
        a, b = trie.ask(keys, key_of, before, word, kind)
        level = pack_arrays(*[np.asarray(x) for x in trie.arrays()])
    a, b = to_codes(a), to_codes(b)
    apart = kind == BIGRAMS
    ends = np.cumsum(sizes)
    answers = [
        pack_arrays(known[p].astype(np.uint64), a[e - n : e], b[e - n : e]) for p, n, e in zip(places, sizes, ends)
    ]
    return pa.table(
        {
            "shard": pa.array([shard] * (len(chunks) + 1), pa.int32()),
            "chunk": pa.array([*chunks, None], pa.int64()),
            "data": pa.array([*answers, level], pa.binary()),
            "tokens": pa.array([None] * len(chunks) + [int(known.sum())], pa.int64()),
            "types": pa.array([None] * len(chunks) + [int((known > 0).sum())], pa.int64()),
            "split_keys": pa.array([None] * len(chunks) + [keys[apart].view(np.int64).tolist()], pa.list_(pa.int64())),
            "split_sums": pa.array([None] * len(chunks) + [weight[apart].tolist()], pa.list_(pa.float64())),
            "split_left": pa.array([None] * len(chunks) + [left[apart].tolist()], pa.list_(pa.float64())),
        }
    )


def _split_words(model: DataFrame, hot: np.ndarray, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each bucket of a split word's bigrams, by key: its share of them, and what the word leaves to single words.

    Three numbers a bucket, and fewer than ``2 * HOT_WORDS`` buckets.
    """
    rows = model.select(F.explode(F.arrays_zip("split_keys", "split_sums", "split_left")).alias("s")).select("s.*").collect()
    known = {r["split_keys"] & 0xFFFFFFFFFFFFFFFF: (r["split_sums"], r["split_left"]) for r in rows}
    keys, shares, left = [], [], []
    for word, number in zip(hot, buckets):
        own = mixed(np.full(int(number), ~word), np.arange(1, int(number) + 1, dtype=np.uint64))
        sums, rest = np.array([known.get(int(k), (0.0, 1.0)) for k in own]).T
        whole = sums.sum()
        keys.append(own)
        shares.append(sums / whole if whole else sums)
        left.append(np.full(len(own), (sums * rest).sum() / whole if whole else 1.0))
    if not keys:
        return hot, np.zeros(0), np.zeros(0)
    keys = np.concatenate(keys)
    order = np.argsort(keys)
    return keys[order], np.concatenate(shares)[order], np.concatenate(left)[order]


def _hot_words(chunks: DataFrame, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Words with more than ``limit`` tokens, and into how many buckets each is split.

    Chunks tell words above a share of theirs; what they leave out of one word is less than half
    the limit in all, so every such word comes up with half the limit. Those, at most
    twice ``HOT_WORDS``, are then counted exactly.
    """
    likely = (
        chunks.select(F.explode(F.arrays_zip("top", "top_counts")).alias("t"))
        .groupBy("t.top")
        .agg(F.sum("t.top_counts").alias("n"))
        .filter(F.col("n") > limit / 2)
        .select("top")
        .collect()
    )
    asked = np.sort(np.array([r["top"] for r in likely], dtype=np.int64).view(np.uint64))
    if not len(asked):
        return asked, asked

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("data"):
                words, tokens, _, _ = read_chunk(data.as_py())
                both, at, _ = np.intersect1d(words, asked, assume_unique=True, return_indices=True)
                counts = np.bincount(tokens, minlength=len(words))[at]
                yield pa.RecordBatch.from_pydict({"word": both.view(np.int64), "n": counts})

    counted = (
        chunks.select("data").mapInArrow(count, "word bigint, n bigint")
        .groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") > limit).collect()
    )
    order = sorted((r["word"] & 0xFFFFFFFFFFFFFFFF, math.ceil(r["n"] / limit)) for r in counted)
    return np.array([w for w, _ in order], dtype=np.uint64), np.array([k for _, k in order], dtype=np.uint64)


def _bucketed(df: DataFrame, column: str, buckets: int) -> DataFrame:
    """Write to scratch in buckets, so that joins on the column need not move these rows.

    Only the entry in the catalog is dropped; the frame reads the files.
    """
    spark, name = df.sparkSession, f"lm_{uuid.uuid4().hex}"
    path = scratch_path(spark, name)
    df.write.bucketBy(buckets, column).option("path", path).format("parquet").saveAsTable(name)
    written = spark.table(name)
    written.schema  # resolved from here on
    spark.sql(f"DROP TABLE {name}")
    return written


SHARDS = (
    "shard int, chunk bigint, data binary, tokens bigint, types bigint, "
    "split_keys array<bigint>, split_sums array<double>, split_left array<double>"
)


@dataclass(frozen=True)
class Scored:
    """Rows of (key, held_out, n_tokens, n_known, train_tokens, base_score, score), and the
    model: one packed trie a shard (shard, data)."""

    rows: DataFrame
    model: DataFrame


def score_documents(
    docs: DataFrame, key: str = "doc_id", text: str = "text", held: Column | None = None, min_count: int = MIN_COUNT,
) -> Scored:
    """Train on the rows that are not ``held`` and score all rows; n-grams count from their ``min_count``-th occurrence on.

    ``held`` is by default the fold that op9 holds out. Null texts are empty, which is one token, the end; rows may lack a
    key or repeat. Without any row to learn from, every token is unknown and certain.
    """
    spark = docs.sparkSession
    held = crc_fold(key, FOLDS) == HELD_FOLD if held is None else held
    rows = docs.select(
        F.col(quoted(key)).alias("key"), F.coalesce(held, F.lit(False)).alias("held"), text_of(quoted(text)).alias("text")
    )
    size = F.octet_length("text").cast("bigint")
    volume, most = rows.agg(F.sum(size), F.sum(F.floor(size / 2) + 2)).first()
    volume, most = volume or 0, most or 1  # bytes, and more tokens than there can be
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(volume / SHARD_BYTES))
    kind = docs.schema[key].dataType
    schema = T.StructType([
        T.StructField("chunk", T.LongType()), T.StructField("keys", T.ArrayType(kind)), T.StructField("size", T.LongType()),
        T.StructField("data", T.BinaryType()), T.StructField("top", T.ArrayType(T.LongType())), T.StructField("top_counts", T.ArrayType(T.LongType())),
    ])
    share = max(1 / (2 * HOT_WORDS), HOT_TOKENS / (2 * most))

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        yield from _chunk_rows(batches, to_arrow_schema(schema), share)

    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with small_batches(spark):
        chunks = _bucketed(rows.mapInArrow(chunked, schema), "chunk", partitions)
    total = chunks.agg(F.sum("size")).first()[0] or 0
    limit = max(HOT_TOKENS, total / HOT_WORDS)
    hot, buckets = _hot_words(chunks, limit)

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, data in zip(batch.column("chunk").to_pylist(), batch.column("data")):
                words, tokens, lengths, out = read_chunk(data.as_py())
                learn = out == 0
                w = windows(words, tokens, lengths, learn, shards, hot, buckets)
                known = np.bincount(tokens, weights=np.repeat(learn, lengths), minlength=len(words)).astype(np.uint32)
                for shard, own, a, b in by_shard(words, w, shards):
                    keys = np.union1d(words[own], w.key[a:b])
                    counts = np.zeros(len(keys), dtype=np.uint32)
                    counts[np.searchsorted(keys, words[own])] = known[own]
                    per_key = np.bincount(np.searchsorted(keys, w.key[a:b]), minlength=len(keys)).astype(np.uint32)
                    kind = np.zeros(len(keys), dtype=np.uint8)
                    kind[np.searchsorted(keys, w.key[a:b])] = w.kind[a:b]
                    blob = pack_arrays(
                        steps_of(keys), per_key, counts, steps_of(w.before[a:b]), w.word[a:b], w.counts[a:b], kind
                    )
                    yield pa.RecordBatch.from_pydict(
                        {"shard": pa.array([shard], pa.int32()), "chunk": pa.array([chunk]), "data": pa.array([blob], pa.binary())}
                    )

    sent = chunks.select("chunk", "data").mapInArrow(routed, "shard int, chunk bigint, data binary")
    grouped = sent.groupBy("shard").applyInArrow(lambda group: _shard_group(group, min_count), SHARDS)
    answered = materialise(grouped, "lm-shards")
    model = answered.filter(F.col("chunk").isNull())
    learned, types = model.agg(F.sum("tokens"), F.sum("types")).first()
    learned, types = learned or 0, types or 0
    split_keys, split_shares, split_left = _split_words(model, hot, buckets)
    out_schema = T.StructType([
        T.StructField("key", kind), T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()),
        T.StructField("n_known", T.LongType()), T.StructField("train_tokens", T.LongType()),
        T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType()),
    ])

    def summed(left: pa.Table, right: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(out_schema)
        if not left.num_rows:
            return target.empty_table()
        words, tokens, lengths, out = read_chunk(left.column("data")[0].as_py())
        w = windows(words, tokens, lengths, out == 0, shards, hot, buckets)
        count = np.zeros(len(words))
        a, b = np.zeros(len(w.key)), np.ones(len(w.key))
        answers = {s: d for s, d in zip(right.column("shard").to_pylist(), right.column("data"))}
        for shard, own, s, e in by_shard(words, w, shards):
            known, a_codes, b_codes = unpack_arrays(answers[shard].as_py())
            keys = np.union1d(words[own], w.key[s:e])
            count[own] = known[np.searchsorted(keys, words[own])]
            a[s:e], b[s:e] = from_codes(a_codes), from_codes(b_codes)
        c = count[tokens]
        lower = np.where(c > 0, c, types / (types + 1)) / (learned + types) if types else np.ones(len(c))
        split = np.flatnonzero(w.pair_of_token >= 0)
        if len(split):
            pair = w.pair_of_token[split]
            at = np.searchsorted(split_keys, w.key[pair])
            lower[split] = a[pair] * split_shares[at] + split_left[at] * lower[split]
        logs = np.log10(a[w.of_token] + b[w.of_token] * lower)
        base = np.log10((c + 1) / (learned + types + 1))
        starts = np.cumsum(lengths) - lengths
        values = [
            left.column("keys").combine_chunks().flatten(),
            pa.array(out != 0),
            pa.array(lengths),
            pa.array(np.add.reduceat((c > 0).astype(np.int64), starts)),
            pa.array(np.full(len(lengths), learned, dtype=np.int64)),
            pa.array(np.add.reduceat(base, starts)),
            pa.array(np.add.reduceat(logs, starts)),
        ]
        return pa.Table.from_arrays([v.cast(f.type) for v, f in zip(values, target)], schema=target)

    replies = answered.filter(F.col("chunk").isNotNull()).select("shard", "chunk", "data")
    scored = (
        chunks.select("chunk", "keys", "data").groupBy("chunk")
        .cogroup(replies.groupBy("chunk"))
        .applyInArrow(summed, out_schema)
    )
    return Scored(scored.withColumnRenamed("key", key), model.select("shard", "data"))
