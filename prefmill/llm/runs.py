"""Periodic runs of words, from suffix trees.

A run is a stretch of words with smallest period q, as long as ``exponent`` periods at least, that no
neighbouring word extends. Ukkonen's algorithm builds the suffix trees of a stretch and of its
reversal; an Euler tour of each, with minima over powers of two, tells the longest common extension (LCE) of
any two places in constant time. The root of every run is a longest Lyndon word under the order of
symbols or under its reverse, and begins at some place: these are two candidates a place, read off the
order of the leaves. Each is extended to the right by an LCE in the text and to the left by one in the reversal.

Trees are only built where runs can be. In a run of exponent e three words in a row occur e - 1 times
at least (``shortest`` - 2 times if the period is one), so all places of a run are covered by frequent
triples. Stretches covered so hold every run as a whole, with the words that end it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

import prefmill.shipping  # noqa: F401
from prefmill.llm.common import WORD, quoted, text_of
from prefmill.llm.pieces import groups

RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))
# Odd multipliers that mix the codes of three words into one number.
MIXERS = tuple(np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


class SuffixTree:
    """Ukkonen's suffix tree of symbols from 1 up, ended by a symbol 0 found nowhere else."""

    def __init__(self, symbols: list[int]):
        self.text = text = [*symbols, 0]
        n = len(text)
        begins, ends, links = [0], [0], [0]  # of the edge into each node; suffix links
        self.begins, self.ends, self.below = begins, ends, [{}]
        below = self.below
        node = edge = length = waiting = 0
        for at, symbol in enumerate(text):
            waiting += 1
            fresh = 0  # the node made last, whose suffix link is still open
            while waiting:
                if not length:
                    edge = at
                child = below[node].get(text[edge])
                if child is None:
                    below[node][text[edge]] = len(begins)
                    begins.append(at), ends.append(n), links.append(0), below.append(None)
                    if fresh:
                        links[fresh] = node
                        fresh = 0
                else:
                    begin = begins[child]
                    width = min(ends[child], at + 1) - begin
                    if length >= width:
                        node, edge, length = child, edge + width, length - width
                        continue
                    if text[begin + length] == symbol:
                        length += 1
                        if fresh:
                            links[fresh] = node
                        break
                    middle = len(begins)
                    below[node][text[edge]] = middle
                    begins.append(begin), ends.append(begin + length), links.append(0)
                    begins.append(at), ends.append(n), links.append(0)
                    begins[child] = begin + length
                    below.append({symbol: middle + 1, text[begin + length]: child})
                    below.append(None)
                    if fresh:
                        links[fresh] = middle
                    fresh = middle
                waiting -= 1
                if node:
                    node = links[node]
                elif length:
                    length -= 1
                    edge = at - waiting + 1

    def tour(self) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Text depths along an Euler tour, where it first meets each suffix, and the suffixes' ranks."""
        n, begins, ends, below = len(self.text), self.begins, self.ends, self.below
        depths, first, rank = [], [0] * n, [0] * n
        stack, seen = [(0, 0)], 0
        while stack:
            node, depth = stack.pop()
            depths.append(depth)
            if node < 0:  # back at an inner node
                continue
            children = below[node]
            if children is None:
                first[n - depth], rank[n - depth] = len(depths) - 1, seen
                seen += 1
                continue
            for symbol in sorted(children, reverse=True):
                child = children[symbol]
                stack.append((-1, depth))
                stack.append((child, depth + ends[child] - begins[child]))
        return np.array(depths, dtype=np.int32), np.array(first), rank

    def reverse_ranks(self) -> list[int]:
        """Ranks of the suffixes when larger symbols come first, but the end before all."""
        n, begins, ends, below = len(self.text), self.begins, self.ends, self.below
        rank, stack, seen = [0] * n, [(0, 0)], 0
        while stack:
            node, depth = stack.pop()
            children = below[node]
            if children is None:
                rank[n - depth] = seen
                seen += 1
                continue
            for symbol in sorted(children, key=lambda s: s or len(self.text) + n):
                child = children[symbol]
                stack.append((child, depth + ends[child] - begins[child]))
        return rank


class Extensions:
    """Longest common extensions of suffixes, from the depths along an Euler tour."""

    def __init__(self, depths: np.ndarray, first: np.ndarray):
        self.first, self.levels, width = first, [depths], 1
        while 2 * width <= len(depths):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols the suffixes ``a`` and ``b``, which differ in place, have in common."""
        left = np.minimum(self.first[a], self.first[b])
        right = np.maximum(self.first[a], self.first[b])
        level = np.frexp((right - left + 1).astype(np.float64))[1] - 1
        found = np.empty(len(left), dtype=np.int64)
        for k in np.unique(level):
            own, row = level == k, self.levels[k]
            found[own] = np.minimum(row[left[own]], row[right[own] - (1 << int(k)) + 1])
        return found


def next_smaller(rank: list[int]) -> list[int]:
    """For each suffix but the empty last one the next that is smaller: there its Lyndon word ends."""
    after = [0] * (len(rank) - 1)
    for i in range(len(after) - 1, -1, -1):
        j, own = i + 1, rank[i]
        while rank[j] > own:
            j = after[j]
        after[i] = j
    return after


def stretch_runs(symbols: list[int], exponent: int, shortest: int) -> np.ndarray:
    """Rows (start, length, period) of the runs in one stretch, by start, then period."""
    m = len(symbols)
    tree = SuffixTree(symbols)
    depths, first, rank = tree.tour()
    ends = np.array([next_smaller(rank), next_smaller(tree.reverse_ranks())]).ravel()
    del tree
    starts = np.tile(np.arange(m), 2)
    right = Extensions(depths, first).of(starts, ends)
    left = Extensions(*SuffixTree(symbols[::-1]).tour()[:2]).of(m - starts, m - ends)
    period, length = ends - starts, ends - starts + right + left
    keep = length >= np.maximum(shortest, exponent * period)
    return np.unique(np.stack([starts - left, length, period], axis=1)[keep][:, [0, 2, 1]], axis=0)[:, [0, 2, 1]]


def stretches(codes: np.ndarray, text: np.ndarray, exponent: int, shortest: int) -> list[tuple[int, int]]:
    """Where runs can be: first word, and the one after the last, of stretches inside one text."""
    often = min(exponent - 1, shortest - 2)
    covered = np.ones(len(codes), dtype=bool)
    if often > 1:
        covered[:] = False
        whole = np.flatnonzero(text[2:] == text[:-2]) if len(codes) > 2 else np.zeros(0, dtype=np.int64)
        parts = (text[whole], codes[whole], codes[whole + 1], codes[whole + 2])
        mixed = np.zeros(len(whole), dtype=np.uint64)
        for part, by in zip(parts, MIXERS):  # triples that clash only make stretches longer
            mixed = (mixed ^ part.astype(np.uint64)) * by
            mixed ^= mixed >> np.uint64(29)
        _, place, count = np.unique(mixed, return_inverse=True, return_counts=True)
        hot = whole[count[place] >= often]
        for step in range(3):
            covered[hot + step] = True
    if not covered.any():
        return []
    breaks = np.concatenate([[True], (covered[1:] != covered[:-1]) | (text[1:] != text[:-1])])
    begins = np.flatnonzero(breaks)
    ends = np.append(begins[1:], len(codes))
    wanted = covered[begins] & (ends - begins >= shortest)
    return list(zip(begins[wanted].tolist(), ends[wanted].tolist()))


def word_runs(texts: list[list[str]], exponent: int = 4, shortest: int = 6) -> list[np.ndarray]:
    """Rows (start, length, period) of all runs of each list of words, by start, then period."""
    sizes = np.array([len(w) for w in texts], dtype=np.int64)
    found: list[list[np.ndarray]] = [[] for _ in texts]
    if sizes.sum():
        flat = pa.array([w for words in texts for w in words], pa.large_string())
        codes = flat.dictionary_encode().indices.to_numpy().astype(np.int64)
        offsets = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(texts)), sizes)
        for begin, end in stretches(codes, owner, exponent, shortest):
            symbols = np.unique(codes[begin:end], return_inverse=True)[1] + 1
            rows = stretch_runs(symbols.tolist(), exponent, shortest)
            rows[:, 0] += begin - offsets[owner[begin]]
            found[owner[begin]].append(rows)
    none = np.zeros((0, 3), dtype=np.int64)
    return [np.concatenate(rows) if rows else none for rows in found]


def collapse(words: list[str], runs: np.ndarray) -> str:
    """The words that stay, joined by spaces: of each run only its first period."""
    if not len(runs):
        return " ".join(words)
    depth = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return " ".join([words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0)])


def find_runs(
    df: DataFrame, text: str = "text", keep: list[str] | None = None, exponent: int = 4, shortest: int = 6,
) -> DataFrame:
    """Columns ``keep`` (all by default), ``n_words``, ``runs`` (start, length, period in words, by start, then
    period) and ``collapsed``, the words that stay when of each run only the first period does.

    Row by row, without a shuffle: rows of one key stay apart, and a null key is carried along. A
    null or empty text, or one of blanks, has no words, no runs and an empty collapsed text. Runs that
    overlap are all told; an input column that bears a result's name is replaced. Time is near
    linear in the words. Memory is about 1 KB a word of the longest stretch that repeats itself, however long the texts.
    """
    if exponent < 2 or shortest < 2:
        raise ValueError("exponent and shortest must be two at least")
    results = [T.StructField("n_words", T.LongType()), T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())]
    taken = {f.name for f in results}
    kept = [c for c in (df.columns if keep is None else keep) if c not in taken]
    columns = [F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(kept)]  # whatever they are called
    source = df.select(*columns, text_of(quoted(text)).alias("text"))
    schema = T.StructType([*[df.schema[c] for c in kept], *results])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target, word = to_arrow_schema(schema), re.compile(WORD)
        for batch in batches:
            at = 0
            for part in groups(t.as_py() for t in batch.column(len(kept))):
                texts = [word.findall(t) for t in part]
                found = word_runs(texts, exponent, shortest)
                rows, flat = batch.slice(at, len(part)), np.concatenate(found)
                fields = [pa.array(flat[:, i]) for i in range(3)]
                offsets = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
                columns = [
                    *[rows.column(i) for i in range(len(kept))],
                    pa.array(list(map(len, texts)), pa.int64()),
                    pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, ["start", "length", "period"])),
                    pa.array(map(collapse, texts, found), pa.string()),
                ]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, target)], schema=target)
                at += len(part)

    return source.mapInArrow(run, schema)
