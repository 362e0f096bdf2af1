"""Quality classifier by compression.

One zstandard dictionary is built from good and one from bad labelled texts. Every whole
text is compressed piece by piece with both; pieces keep the dictionary at work throughout a long
text. The difference of the two sizes, divided by their sum, becomes a probability through
a logistic curve fitted on labelled texts that neither dictionary has seen.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

import prefmill.shipping  # noqa: F401
from prefmill.llm.common import crc_fold, first_by_hash, text_of

FOLDS = 5
THRESHOLD = 0.3
#: Bounds of the sample that the classifier is fitted on: labelled documents a class, and bytes a document
#: (longer ones take no part in fitting; they are scored like all others).
SAMPLE_PER_CLASS = 4000
SAMPLE_BYTES = 65_536
DICTIONARY_BYTES = 112 << 10
PIECE_BYTES = 256
LEVEL = 3


@dataclass(frozen=True)
class CompressionModel:
    """Dictionaries and curve; without dictionaries every text gets the prior.

    ``trained`` tells dictionaries that zstandard made from samples from raw text.
    """

    good: bytes
    bad: bytes
    slope: float
    offset: float
    trained: bool = True


def pieces(text: str | None, size: int = PIECE_BYTES) -> list[bytes]:
    data = (text or "").encode("utf-8", "replace")
    return [data[i : i + size] for i in range(0, len(data), size)]


class Measure:
    """The normalised difference of a text's compressed sizes."""

    def __init__(self, good: bytes, bad: bytes, trained: bool = True):
        self.coders = []
        kind = zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT
        for raw in (good, bad):
            words = zstandard.ZstdCompressionDict(raw, dict_type=kind)
            words.precompute_compress(level=LEVEL)
            self.coders.append(
                zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_content_size=False)
            )

    def __call__(self, text: str | None) -> float:
        """In (-1, 1), higher for good; 0 for an empty text."""
        good, bad = self.coders
        a = b = 0
        for piece in pieces(text):
            a += len(good.compress(piece))
            b += len(bad.compress(piece))
        return (b - a) / (a + b) if a + b else 0.0


def logistic(x: float) -> float:
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, x))))


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a weighted logistic curve, by Newton steps with a weak prior."""
    scale = float(np.abs(x).max()) or 1.0
    design = np.column_stack([x / scale, np.ones_like(x)])
    beta = np.zeros(2)
    ridge = np.diag([1e-2, 1e-6])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -50, 50)))
        gradient = design.T @ (weight * (y - p)) - ridge @ beta
        curvature = design.T @ (design * (weight * p * (1 - p) + 1e-9)[:, None]) + ridge
        step = np.linalg.solve(curvature, gradient)
        beta += step * min(1.0, 4 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0] / scale), float(beta[1])


def labelled_sample(
    docs: DataFrame, labels: DataFrame, key: str, text: str, label: str,
    per_class: int = SAMPLE_PER_CLASS,
) -> tuple[dict[int, list[str]], dict[int, int]]:
    """Texts by class, in hash order of their keys, and how many keys each class has.

    Keys are chosen from the labels alone, at most ``per_class`` a class, so only chosen
    documents meet the labels. A key labelled both ways or not at all has no class.
    """
    classes = (
        labels.filter(F.col(key).isNotNull() & F.col(label).isin(0, 1))
        .groupBy(key)
        .agg(F.min(label).alias("_low"), F.max(label).alias("_high"))
        .filter((F.col("_low") == F.col("_high")) & (crc_fold(key, FOLDS) != 0))
        .select(F.col(key).alias("_key"), F.col("_low").cast("int").alias("_class"))
    )
    counts = {r[0]: r[1] for r in classes.groupBy("_class").count().collect()}
    chosen = None
    for value in (0, 1):
        part = classes.filter(F.col("_class") == value)
        part = first_by_hash(part, F.xxhash64("_key"), per_class, counts.get(value, 0))
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = (
        docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
        .filter(F.octet_length("_text").between(1, SAMPLE_BYTES))
        .join(F.broadcast(chosen), "_key")
        .groupBy("_key", "_class")
        .agg(F.min("_text").alias("_text"))
        .orderBy(F.xxhash64("_key"), "_key")
        .select("_class", "_text")
    )
    texts: dict[int, list[str]] = {0: [], 1: []}
    for row in rows.collect():
        texts[row[0]].append(row[1])
    return texts, counts


def trained_books(samples: list[list[bytes]]) -> list[bytes] | None:
    """A dictionary from each class's pieces; None where one class has too little text to learn from."""
    if min(map(len, samples)) < 16:
        return None
    try:
        return [zstandard.train_dictionary(DICTIONARY_BYTES, own).as_bytes() for own in samples]
    except zstandard.ZstdError:
        return None


def raw_books(samples: list[list[bytes]]) -> list[bytes]:
    """The texts themselves as dictionaries, of one length, so that their sizes compare."""
    room = min(DICTIONARY_BYTES, *[sum(map(len, own)) for own in samples])
    return [b"".join(own)[:room] for own in samples]


def samples_of(texts: dict[int, list[str]], left_out: int | None) -> list[list[bytes]]:
    """Pieces of the good and the bad texts without every third one, from ``left_out`` on; all of a class that has one text."""
    return [
        [p for i, t in enumerate(texts[v]) if i % 3 != left_out or len(texts[v]) == 1 for p in pieces(t, 1024)] for v in (1, 0)
    ]


def train(texts: dict[int, list[str]], counts: dict[int, int]) -> CompressionModel:
    """Two of three texts of a class build its dictionary, the third fits the curve.

    Too few texts to train on are dictionaries as they are. Each third is then measured with the other two, so that
    all of them fit the curve, and all of them make the dictionaries. The curve never falls: so few texts
    may suggest that, but a smaller size is what the method goes by. Without any text of one class
    there is nothing to compare, and the score of every text is the share of good labels.
    """
    prior = {c: counts.get(c, 0) + 1 for c in (0, 1)}
    if not texts[0] or not texts[1]:
        return CompressionModel(b"", b"", 0.0, math.log(prior[1] / prior[0]))
    books = trained_books(samples_of(texts, 0))
    trained = books is not None
    held = []
    for fold in range(1 if trained else 3):
        measure = Measure(*books) if trained else Measure(*raw_books(samples_of(texts, fold)), trained=False)
        held += [(measure(t), value) for value in (0, 1) for t in texts[value][fold::3]]
    x, y = (np.array(v, dtype=float) for v in zip(*held))
    share = {c: prior[c] / sum(prior.values()) / max(1, (y == c).sum()) for c in (0, 1)}
    weight = np.where(y == 1, share[1], share[0]) * len(y)
    slope, offset = fit_curve(x, y, weight)
    if trained:
        return CompressionModel(books[0], books[1], slope, offset)
    return CompressionModel(*raw_books(samples_of(texts, None)), max(1.0, slope), offset, trained=False)


def fit(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
    label: str = "quality", per_class: int = SAMPLE_PER_CLASS,
) -> CompressionModel:
    """Fit on at most ``2 * per_class`` labelled texts outside the held-out fold.

    A key that occurs repeatedly counts once, with its smallest text; one that is null, labelled both ways or
    not at all takes no part, nor do null and empty texts and those above ``SAMPLE_BYTES``. Of equal hashes the smaller key
    comes first. Empty tables leave no labels, and so the prior. Only the named columns are read.
    """
    return train(*labelled_sample(docs, labels, key, text, label, per_class))


def score(model: CompressionModel, text: str | Column = "text") -> Column:
    """Probability that a text is good; null counts as empty, which is scored as well.

    Whole texts are scored, however long, piece by piece; the score is a function of the text alone.
    """
    good, bad, slope, offset, trained = model.good, model.bad, model.slope, model.offset, model.trained

    def probability(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        measure = Measure(good, bad, trained) if good else (lambda _: 0.0)
        for batch in batches:
            yield pa.array([logistic(slope * measure(t.as_py()) + offset) for t in batch], pa.float64())

    probability.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(probability, returnType="double")(text_of(text))
