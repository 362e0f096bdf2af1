"""Tokenizers as columns: text -> ARRAY<INT>."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefmill import shipping  # noqa: F401
from prefmill.functions.slices import sliced

# A chat marker, or a run without blanks that stops before a marker.
TOKEN_PATTERN = r"<\|[a-z_]+\|>|[^\s<]+|<"
HASHED_VOCABULARY = 32_000

Tokenizer = Callable[[Column], Column]


def split_tokens(text: Column, pattern: str = TOKEN_PATTERN) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def hashed_tokenizer(
    pattern: str = TOKEN_PATTERN, vocabulary: int = HASHED_VOCABULARY
) -> Tokenizer:
    """Regex tokens with CRC-32 ids: no vocabulary table, hence no join on hot tokens."""

    def tokenize(text: Column) -> Column:
        return F.transform(
            split_tokens(text, pattern),
            lambda t: F.pmod(F.crc32(t.cast("binary")), F.lit(vocabulary)).cast("int"),
        )

    return tokenize


def python_tokenizer(factory: Callable[[], Callable[[list[str]], list[list[int]]]]) -> Tokenizer:
    """Any Python tokenizer, built once per task and column and fed a part of an Arrow batch at a time.

    Ids may come as lists or as int32 arrays; the latter spare a Python object per token. Columns that are
    tokenized side by side share one Python worker.
    """
    made: list[Callable] = []

    def run(texts: pa.Array) -> pa.Array:
        if not made:
            made.append(factory())
        parts = [pa.array(made[0](part.to_pylist()), type=pa.list_(pa.int32())) for part in sliced(texts)]
        return pa.concat_arrays(parts)

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, returnType=T.ArrayType(T.IntegerType()))


#: Longer runs of blanks are encoded in pieces: over some 10^6 of them the encoder's pattern runs out of stack.
MANY_BLANKS = 1 << 16


class Vocabulary:
    """A byte-level vocabulary: a file of ranks, the pattern that splits text, and marks that are one token each.

    The file is read where this is made, and travels with the tasks. Every token has an id of its own, and
    any text comes back from its ids. Marks get the ids behind the ranks, in the order given.
    """

    def __init__(self, path: str, pattern: str, marks: tuple[str, ...] = ()):
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        behind = max(self.ranks.values()) + 1
        self.pattern, self.marks = pattern, {mark: behind + i for i, mark in enumerate(marks)}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "coder"}  # each task makes its own

    @cached_property
    def coder(self) -> tiktoken.Encoding:
        return tiktoken.Encoding("vocabulary", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens=self.marks)

    def __len__(self) -> int:
        return len(self.ranks) + len(self.marks)

    def _parts(self, text: str) -> list[str]:
        return [text] if len(text) <= MANY_BLANKS else re.split(r"(\s{%d})" % MANY_BLANKS, text)

    def encode(self, text: str) -> list[int]:
        return [i for part in self._parts(text) for i in self.coder.encode(part, allowed_special="all")]

    def ids(self, text: str) -> np.ndarray:
        """As ``encode``, in four bytes a token."""
        found = [self.coder.encode_to_numpy(part, allowed_special="all") for part in self._parts(text)]
        return np.concatenate(found).astype(np.int32)

    def decode(self, ids: list[int]) -> str:
        return self.coder.decode(ids)

    def tokenizer(self) -> Tokenizer:
        """A column of ids; a null text has null ids."""
        return python_tokenizer(lambda: lambda texts: [None if t is None else self.ids(t) for t in texts])

    def spellings(self) -> pa.Array:
        """The bytes of every token, at its id; null at ids that stand for nothing."""
        known = {i: token for token, i in self.ranks.items()} | {i: mark.encode() for mark, i in self.marks.items()}
        return pa.array([known.get(i) for i in range(max(known) + 1)], pa.large_binary())

    def text(self, ids: Column) -> Column:
        """The text that a column of ids spells."""
        spelled = self.spellings()

        def run(ids: pa.Array) -> pa.Array:
            return pa.concat_arrays([spell(part, spelled) for part in sliced(ids)])

        run.__annotations__ = {"ids": pa.Array, "return": pa.Array}
        return F.arrow_udf(run, returnType=T.StringType())(ids)


def spell(ids: pa.Array, spelled: pa.Array) -> pa.Array:
    """The texts of lists of ids, null for null: looked up in one piece, and cut where the lists end."""
    taken = spelled.take(ids.flatten())
    if taken.null_count:
        raise ValueError("an id that is null or stands for no token")
    counts = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
    starts = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset:]
    cuts = starts[np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])]
    texts = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(cuts), taken.buffers()[2]])
    if ids.null_count:
        texts = pc.if_else(ids.is_valid(), texts, pa.scalar(None, pa.large_binary()))
    try:
        return texts.cast(pa.string())
    except pa.ArrowInvalid:  # ids that cut a character in two
        return pa.array([None if t is None else t.decode(errors="replace") for t in texts.to_pylist()], pa.string())
