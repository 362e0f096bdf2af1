"""Token counts by section or field, from one encoding of the whole document.

Encoding parts apart counts other tokens than encoding the whole, since tokens reach across their borders.
Here the whole text is encoded once with a byte-level tokenizer. Its tokens tile the bytes of the text, so
their lengths give each token's span, first in bytes, then in characters. Token spans meet section
spans in an interval join of two sorted lists. A token that crosses a border is
allocated whole, by one rule: to the section that holds most of its characters, the earlier one
of equals. A character spelled by several tokens counts for each of them. So the counts of the sections add up to the tokens of the document.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

import prefmill.shipping  # noqa: F401
from prefmill.llm.common import quoted, text_of


#: Longer runs of blanks are encoded in pieces: over some 10^6 of them the encoder's pattern runs out of stack.
MANY_BLANKS = 1 << 16


class SpanCoder:
    """A byte-level tokenizer, given as its ranks file and splitting pattern."""

    def __init__(self, ranks: bytes, pattern: str):
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.coder = tiktoken.Encoding("spans", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.lengths = np.zeros(max(table.values()) + 1, dtype=np.int64)
        self.lengths[list(table.values())] = [len(t) for t in table]

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """First character of each token, and the one after its last."""
        data = text.encode("utf-8", "replace")
        known = data.decode()
        parts = [known] if len(known) <= MANY_BLANKS else re.split(r"(\s{%d})" % MANY_BLANKS, known)
        ids = np.array([i for part in parts for i in self.coder.encode_ordinary(part)], dtype=np.int64)
        if not len(ids):
            return ids, ids
        ends = np.cumsum(self.lengths[ids])
        lead = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
        character = np.cumsum(lead) - 1
        return character[ends - self.lengths[ids]], character[ends - 1] + 1


def allocate(begins: np.ndarray, ends: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The section of each token span, and which tokens cross a border.

    ``starts`` are the first characters of sections that tile the text; of sections that
    start at the same place all but the last are empty and get nothing.
    """
    first = np.searchsorted(starts, begins, side="right") - 1
    last = np.searchsorted(starts, ends - 1, side="right") - 1
    crossing = first != last
    chosen = first.copy()
    for i in np.flatnonzero(crossing):
        edges = np.clip(np.append(starts[first[i] : last[i] + 1], ends[i]), begins[i], ends[i])
        chosen[i] = first[i] + int(np.argmax(np.diff(edges)))
    return chosen, crossing


def line_starts(text: str) -> np.ndarray:
    """Sections are lines; a line feed ends its line and belongs to it."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    starts = np.concatenate([[0], np.flatnonzero(points == 10) + 1])
    return starts[:-1] if len(starts) > 1 and starts[-1] == len(points) else starts


COUNTS = (
    T.StructField("n_chars", T.LongType()),
    T.StructField("n_tokens", T.LongType()),
    T.StructField("n_crossing", T.LongType()),
)


def _counted(
    source: DataFrame, key: str, starts_of, tokenizer: str, pattern: str, section: T.StructField,
    names: list[str] | None,
) -> DataFrame:
    """``source`` has the key and the columns whose texts make up one document, in order."""
    with open(tokenizer, "rb") as file:
        ranks = file.read()
    schema = T.StructType([source.schema[0], section, *COUNTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target, coder = to_arrow_schema(schema), SpanCoder(ranks, pattern)
        for batch in batches:
            rows, sections, chars, tokens, crossed = [], [], [], [], []
            for row, parts in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:]))):
                text, starts = starts_of(parts)
                begins, ends = coder.spans(text)
                own, crossing = allocate(begins, ends, starts)
                rows.append(np.full(len(starts), row))
                sections.append(np.arange(len(starts)))
                chars.append(np.diff(np.append(starts, len(text))))
                tokens.append(np.bincount(own, minlength=len(starts)))
                crossed.append(np.bincount(own[crossing], minlength=len(starts)))
            if not rows:
                continue
            place = np.concatenate(sections)
            columns = [
                batch.column(0).take(pa.array(np.concatenate(rows))),
                pa.array(np.array(names, dtype=object)[place]) if names else pa.array(place),
                *[pa.array(np.concatenate(c)) for c in (chars, tokens, crossed)],
            ]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, target)], schema=target)

    return source.mapInArrow(run, schema).withColumnRenamed("_key", key)


def count_lines(df: DataFrame, tokenizer: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each line of each text: key, line (from 0), characters, tokens, and how many of
    those tokens cross into or out of the line.

    A null or empty text has one line without characters or tokens. Rows of one key stay apart; a null key is carried along.
    """
    source = df.select(F.col(quoted(key)).alias("_key"), text_of(quoted(text)).alias("_text"))

    def starts_of(parts: tuple[str, ...]) -> tuple[str, np.ndarray]:
        return parts[0], line_starts(parts[0])

    return _counted(source, key, starts_of, tokenizer, pattern, T.StructField("line", T.IntegerType()), None)


def count_fields(
    df: DataFrame, fields: list[str], tokenizer: str, pattern: str, key: str, joint: str = "\n",
) -> DataFrame:
    """A row for each field of each row: key, field, characters, tokens, crossing tokens.

    The document is the fields' texts with ``joint`` after each but the last, which counts for the
    field before it. A null field is empty.
    """
    texts = [text_of(F.col(quoted(f)).cast("string")).alias(f"f{i}") for i, f in enumerate(fields)]
    source = df.select(F.col(quoted(key)).alias("_key"), *texts)

    def starts_of(parts: tuple[str, ...]) -> tuple[str, np.ndarray]:
        pieces = [*(p + joint for p in parts[:-1]), parts[-1]]
        return "".join(pieces), np.cumsum([0, *map(len, pieces[:-1])])

    return _counted(source, key, starts_of, tokenizer, pattern, T.StructField("field", T.StringType()), list(fields))
