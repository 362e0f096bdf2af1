"""SentencePiece encoding and decoding with byte spans of the original text.

Text is normalised by the model's compiled character map: at each place the longest prefix
found in its double-array trie is replaced, and every byte of the output remembers where its
source begins. The normalised text falls apart at each space mark that follows something else, since
no piece crosses such a place; each distinct segment of a batch is merged into pieces once. Every
piece is then projected back through the alignment to bytes of the original.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sentencepiece import sentencepiece_model_pb2 as proto

import prefmill.shipping  # noqa: F401
from prefmill.llm.common import quoted, text_of

MARK = "▁"  # stands for a space
SEGMENT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: Texts are encoded in groups of about this many characters, which bounds a worker's memory.
GROUP_CHARS = 1 << 20


class CharacterMap:
    """The compiled character map: a double-array trie over UTF-8 keys, and replacements.

    The layout (little-endian): size of the trie, its 32-bit units, then zero-ended strings.
    """

    def __init__(self, compiled: bytes):
        size = int.from_bytes(compiled[:4], "little")
        self.units = np.frombuffer(compiled[4 : 4 + size], dtype="<u4").tolist()
        self.strings = compiled[4 + size :]

    @staticmethod
    def _jump(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def longest(self, text: bytes, start: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest key that ``text`` has at ``start``."""
        units, found = self.units, None
        at = self._jump(units[0])
        for i in range(start, len(text)):
            byte = text[i]
            at ^= byte
            if at >= len(units):
                break
            unit = units[at]
            if unit & 0x800000FF != byte:
                break
            at ^= self._jump(unit)
            if unit & 0x100:
                found = (i + 1 - start, units[at] & 0x7FFFFFFF)
        if found is None:
            return None
        end = self.strings.index(b"\0", found[1])
        return found[0], self.strings[found[1] : end]


class PieceCoder:
    """Encodes and decodes texts with one model, given as its serialised bytes."""

    def __init__(self, model: bytes):
        spec = proto.ModelProto.FromString(model)
        rules = spec.normalizer_spec
        if spec.trainer_spec.treat_whitespace_as_suffix or not rules.escape_whitespaces:
            raise ValueError("only models that mark spaces in front of words are supported")
        if not any(p.type == proto.ModelProto.SentencePiece.BYTE for p in spec.pieces):
            raise ValueError("spans need a model with byte fallback")
        if any(p.type == proto.ModelProto.SentencePiece.USER_DEFINED for p in spec.pieces):
            raise ValueError("user-defined pieces are not supported")
        self.map = CharacterMap(rules.precompiled_charsmap) if rules.precompiled_charsmap else None
        self.prefix, self.squeeze = rules.add_dummy_prefix, rules.remove_extra_whitespaces
        self.splits = not any(re.search(f"[^{MARK}]{MARK}", p.piece) for p in spec.pieces)
        self.decoder = sentencepiece.SentencePieceProcessor(model_proto=model)
        rules.precompiled_charsmap = b""
        rules.add_dummy_prefix = rules.remove_extra_whitespaces = rules.escape_whitespaces = False
        #: Merges text that is normalised already.
        self.merger = sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString())
        self.pieces = [(p.piece, p.type == proto.ModelProto.SentencePiece.BYTE) for p in spec.pieces]

    @cached_property
    def byte_lengths(self) -> np.ndarray:
        """Bytes of normalised text that each piece stands for."""
        return np.array([1 if byte else len(p.encode()) for p, byte in self.pieces])

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its bytes, and its end, where the source begins."""
        data = text.encode("utf-8", "replace")
        if not data:
            return "", np.zeros(1, dtype=np.int64)
        if self.map is None and not self.squeeze:
            return self._escape(data)
        out, align = bytearray(), []
        mark = MARK.encode()

        def put(piece: bytes, source: int) -> None:
            out.extend(piece)
            align.extend([source] * len(piece))

        at, opened, after_space = 0, False, self.squeeze
        while at < len(data):
            width, replaced = self._step(data, at)
            if not opened:
                if self.squeeze and replaced == b" ":
                    at += width
                    continue
                opened = True
                if self.prefix:
                    put(mark, at)
            while after_space and replaced.startswith(b" "):
                replaced = replaced[1:]
            if replaced:
                for char in replaced.decode("utf-8", "replace"):
                    put(mark if char == " " else char.encode(), at)
                after_space = replaced.endswith(b" ")
            at += width
            if not self.squeeze:
                after_space = False
        if self.squeeze:
            while out.endswith(mark):
                at = align[-3]
                del out[-3:], align[-3:]
        return out.decode(), np.array([*align, at], dtype=np.int64)

    def _step(self, data: bytes, at: int) -> tuple[int, bytes]:
        hit = self.map.longest(data, at) if self.map else None
        if hit:
            return hit
        lead = data[at]
        width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return width, data[at : at + width]

    def _escape(self, data: bytes) -> tuple[str, np.ndarray]:
        """Normalisation without a character map: spaces become marks, all else stays."""
        octets = np.frombuffer(data, dtype=np.uint8)
        widths = np.where(octets == 0x20, 3, 1)
        lead = (octets & 0xC0) != 0x80
        starts = np.maximum.accumulate(np.where(lead, np.arange(len(octets)), 0))
        align = np.repeat(starts, widths)
        text = data.decode().replace(" ", MARK)
        if self.prefix:
            text, align = MARK + text, np.concatenate([np.zeros(3, dtype=np.int64), align])
        return text, np.append(align, len(data))

    def segments(self, normalised: str) -> list[str]:
        return SEGMENT.findall(normalised) if self.splits else [normalised] if normalised else []

    def _merge(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all segments in a row, and the number of ids of each segment."""
        if not segments:
            return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)
        coded = pa.array(segments, pa.large_string()).dictionary_encode()
        codes = coded.indices.to_numpy()
        merged = self.merger.encode(coded.dictionary.to_pylist(), num_threads=1)
        lengths = np.fromiter(map(len, merged), np.int64, len(merged))
        flat = np.fromiter(chain.from_iterable(merged), np.int32, int(lengths.sum()))
        begins, wanted = np.cumsum(lengths) - lengths, lengths[codes]
        shift = np.repeat(begins[codes] - (np.cumsum(wanted) - wanted), wanted)
        return flat[shift + np.arange(len(shift))], wanted

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each text: ids, and the byte where the source of each piece begins and ends.

        Pieces tile the text. Of a character spelled in byte pieces the last one gets the
        whole source, the others are empty at its start. A null text counts as empty.
        """
        done = [self.normalise(t or "") for t in texts]
        split = [self.segments(n) for n, _ in done]
        ids, per_segment = self._merge([s for part in split for s in part])
        counts = np.array([len(part) for part in split], dtype=np.int64)
        ends = np.concatenate([[0], np.cumsum(per_segment)])[np.cumsum(counts)] if len(texts) else []
        found, start = [], 0
        for (_, align), end in zip(done, ends):
            own = ids[start:end]
            upto = np.cumsum(self.byte_lengths[own])
            found.append((own, align[upto - self.byte_lengths[own]], align[upto]))
            start = int(end)
        return found

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.decoder.decode(ids, num_threads=1) if ids else []


def groups(texts: Iterable[str | None], size: int = GROUP_CHARS) -> Iterator[list[str | None]]:
    part, chars = [], 0
    for text in texts:
        part.append(text)
        chars += len(text or "")
        if chars >= size:
            yield part
            part, chars = [], 0
    if part:
        yield part


def encode_texts(
    df: DataFrame, model_path: str, text: str = "text", keep: list[str] | None = None,
    spans: bool = True, decode: bool = True,
) -> DataFrame:
    """Columns ``keep`` (all by default), ``ids``, ``begins`` and ``ends`` in bytes, ``decoded``,
    and ``covered``, the bytes that the spans cover.

    Nothing is added in front or behind. A null text is encoded as empty: no ids, decoded
    empty. An input column that bears a result's name is replaced. The model file is read once, on the driver.
    """
    with open(model_path, "rb") as file:
        model = file.read()
    results = [
        T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
        *([T.StructField(n, T.ArrayType(T.LongType(), False)) for n in ("begins", "ends")] if spans else []),
        *([T.StructField("decoded", T.StringType())] if decode else []),
        T.StructField("covered", T.LongType()),
    ]
    taken = {f.name for f in results}
    kept = [c for c in (df.columns if keep is None else keep) if c not in taken]
    columns = [F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(kept)]  # whatever they are called
    source = df.select(*columns, text_of(quoted(text)).alias("text"))
    schema = T.StructType([*[df.schema[c] for c in kept], *results])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target, coder = to_arrow_schema(schema), PieceCoder(model)
        for batch in batches:
            at = 0
            for part in groups(t.as_py() for t in batch.column(len(kept))):
                found = coder.encode(part)
                offsets = pa.array(np.cumsum([0, *[len(i) for i, _, _ in found]]), pa.int32())
                lists = {
                    name: pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([f[k] for f in found])))
                    for k, name in enumerate(("ids", "begins", "ends"))
                }
                lists["covered"] = pa.array([int((e - b).sum()) for _, b, e in found], pa.int64())
                if decode:
                    lists["decoded"] = pa.array(coder.decode([i.tolist() for i, _, _ in found]))
                rows = batch.slice(at, len(part))
                columns = [
                    rows.column(i) if i < len(kept) else lists[f.name] for i, f in enumerate(target)
                ]
                yield pa.RecordBatch.from_arrays(
                    [c.cast(f.type) for c, f in zip(columns, target)], schema=target
                )
                at += len(part)

    return source.mapInArrow(run, schema)
