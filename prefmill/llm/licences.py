"""Licence scan: a trained paragraph classifier, confirmed by comparison with templates.

Sparse multinomial logistic regression over word n-grams (one to three words) tells licence families and
an unknown class apart. It is trained on variants of the notices below (words left out, words put in, text
around them, changes of case) against a bounded sample of ordinary paragraphs of the corpus
and shuffled notices. A temperature fitted on variants that training has not
seen calibrates its probabilities, that of the unknown class included. A predicted family is
reported only if a stretch of words, which may span lines, also covers most of the n-grams of one of the family's
templates; a template covered whole needs no classifier.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

import prefmill.shipping  # noqa: F401
from prefmill.llm.common import first_by_hash, quoted, text_of

# Customary notices of each licence family.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "This project is licensed under the Apache 2.0 license.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "Licensed under the GPL v3.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "Licensed under the GPL v2.",
    ),
    "LGPL": (
        "This library is licensed under the GNU Lesser General Public License.",
        "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License.",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Released under the BSD 3-Clause License.",
        "Released under the BSD 2-Clause License.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC0": (
        "Released into the public domain under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    ),
    "Proprietary": (
        "All rights reserved.",
        "Copyright. All rights reserved. No part of this publication may be reproduced without permission.",
    ),
}
UNKNOWN = "unknown"
FAMILIES = (UNKNOWN, *TEMPLATES)

WORDS = re.compile(r"[^\W_]+(?:[.\-/][^\W_]+)*")
LONGEST_GRAM = 3
COVERAGE = 0.8
VARIANTS = 60
#: Ordinary paragraphs for training: at most this many, of at most so many bytes.
SAMPLE, SAMPLE_BYTES = 1500, 4096


def words_of(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def grams_of(words: list[str], known: dict[str, int] | None = None) -> set:
    """N-grams of a word list; with ``known`` the numbers of those that it holds.

    An n-gram is known only if its words are, so the search goes on only from known words.
    """
    found = set()
    for i, word in enumerate(words):
        if known is not None and word not in known:
            continue
        gram = word
        for n in range(1, LONGEST_GRAM + 1):
            if known is None:
                found.add(gram)
            elif gram in known:
                found.add(known[gram])
            if i + n >= len(words) or n == LONGEST_GRAM or known is not None and words[i + n] not in known:
                break
            gram += " " + words[i + n]
    return found


def _template_grams(words: list[str]) -> frozenset[str]:
    """The longest n-grams that a template has: what its coverage is measured by."""
    n = min(LONGEST_GRAM, len(words))
    return frozenset(" ".join(words[i : i + n]) for i in range(len(words) - n + 1))


@dataclass(frozen=True)
class LicenceModel:
    grams: dict[str, int]
    weights: np.ndarray  # gram x class, the last row is the offset
    temperature: float

    def probabilities(self, found: list[int]) -> np.ndarray:
        scores = (self.weights[found].sum(axis=0) + self.weights[-1]) / self.temperature
        scores = np.exp(scores - scores.max())
        return scores / scores.sum()


def _variants(rng: random.Random, plain: list[list[str]]) -> list[tuple[list[str], int]]:
    """Training paragraphs as word lists with their class numbers."""
    some = [w for p in plain for w in p[:40]] or ["word"]

    def filler(most: int) -> list[str]:
        return rng.choices(some, k=rng.randint(0, most))

    rows = [(p, 0) for p in plain] + [(filler(60), 0) for _ in range(200)]
    for number, notices in enumerate(TEMPLATES.values(), 1):
        for notice in notices:
            words = words_of(notice)
            for i in range(VARIANTS):
                own = [w for w in words if i == 0 or rng.random() > 0.04] or words
                if i % 3 == 1:
                    own = filler(8) + own
                if i % 3 == 2:
                    own = filler(120) + own + filler(120)
                rows.append((own, number))
            for _ in range(VARIANTS // 4):  # the words alone do not make a notice
                rows.append((rng.sample(words, k=max(1, len(words) // 3)) + filler(30), 0))
    rng.shuffle(rows)
    return rows


def _fit(x: np.ndarray, y: np.ndarray, classes: int, steps: int = 250) -> np.ndarray:
    """Weights of regularised softmax regression, by accelerated gradient steps."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)])
    target = np.eye(classes, dtype=x.dtype)[y]
    weight = 1 / np.bincount(y, minlength=classes).clip(1)[y] ** 0.5
    weight = (weight / weight.mean()).astype(x.dtype)[:, None]
    rate = 2.0 / float((x**2).sum(axis=1).mean())
    w = np.zeros((x.shape[1], classes), dtype=x.dtype)
    ahead, momentum = w, 0.9
    for _ in range(steps):
        scores = x @ ahead
        p = np.exp(scores - scores.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        gradient = x.T @ (weight * (p - target)) / len(x) + 1e-5 * ahead
        new = ahead - rate * gradient * 4
        ahead, w = new + momentum * (new - w), new
    return w


def train(plain: list[str], seed: int = 11) -> LicenceModel:
    """Train on the templates and ordinary paragraphs; those that look like a notice are skipped."""
    templates = [_template_grams(words_of(t)) for notices in TEMPLATES.values() for t in notices]
    ordinary = []
    for text in plain:
        words = words_of(text)
        grams = grams_of(words)
        if not any(len(t & grams) > len(t) / 2 for t in templates):
            ordinary.append(words)
    rng = random.Random(seed)
    rows = _variants(rng, ordinary)
    vocabulary = sorted({g for notices in TEMPLATES.values() for t in notices for g in grams_of(words_of(t))})
    grams = {g: i for i, g in enumerate(vocabulary)}
    x = np.zeros((len(rows), len(grams)), dtype=np.float32)
    for i, (words, _) in enumerate(rows):
        x[i, list(grams_of(words, grams))] = 1
    y = np.array([c for _, c in rows])
    held = np.arange(len(rows)) % 4 == 0
    weights = _fit(x[~held], y[~held], len(FAMILIES))
    scores = x[held] @ weights[:-1] + weights[-1]

    def loss(temperature: float) -> float:
        s = scores / temperature
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), y[held]]).mean())

    return LicenceModel(grams, weights, min((0.3, 0.5, 0.7, 1.0, 1.4, 2.0, 3.0), key=loss))


class Scanner:
    """Finds notices among the paragraphs of a text."""

    def __init__(self, model: LicenceModel, coverage: float = COVERAGE):
        self.model, self.coverage = model, coverage
        self.notices = [
            (number, words, _template_grams(words))
            for number, notices in enumerate(TEMPLATES.values(), 1) for words in map(words_of, notices)
        ]
        self.templates = [
            (number, [model.grams[g] for g in _template_grams(words_of(t))])
            for number, notices in enumerate(TEMPLATES.values(), 1) for t in notices
        ]

    def paragraph(self, text: str) -> tuple[int, float, float] | None:
        """Family number, probability and coverage, or None."""
        found = grams_of(words_of(text), self.model.grams)
        if not found:
            return None
        covered = {}
        for number, grams in self.templates:
            share = sum(g in found for g in grams) / len(grams)
            if share >= self.coverage and share > covered.get(number, 0):
                covered[number] = share
        if not covered:  # no family could be confirmed
            return None
        p = self.model.probabilities(list(found))
        family = int(p.argmax())
        return (family, float(p[family]), covered[family]) if family in covered else None

    def windows(self, words: list[str]) -> list[tuple[int, int, int, float]]:
        """(start, end, family number, coverage) of bounded stretches of words that cover a template.

        A stretch is at most twice as long as the template's words, and eight more.
        """
        known = grams_of(words, self.model.grams)
        places: dict[int, dict[str, list[int]]] = {}
        found = []
        for (number, own, grams), (_, numbers) in zip(self.notices, self.templates):
            need = self.coverage * len(grams)
            if sum(g in known for g in numbers) < need:
                continue
            n = min(LONGEST_GRAM, len(own))
            if n not in places:
                places[n] = {}
                for i in range(len(words) - n + 1):
                    places[n].setdefault(" ".join(words[i : i + n]), []).append(i)
            met = sorted((i, g) for g in grams for i in places[n].get(g, ()))
            longest, left, right, held = 2 * len(own) + 8, 0, 0, Counter()
            while right < len(met):
                held[met[right][1]] += 1
                right += 1
                while met[right - 1][0] + n - met[left][0] > longest or held[met[left][1]] > 1:
                    held[met[left][1]] -= 1
                    held += Counter()
                    left += 1
                if len(held) < need:
                    continue
                while right < len(met) and met[right][1] not in held and met[right][0] + n - met[left][0] <= longest:
                    held[met[right][1]] += 1
                    right += 1
                found.append((met[left][0], met[right - 1][0] + n, number, len(held) / len(grams)))
                left, held = right, Counter()
        return found

    def stretch(self, words: list[str]) -> list[tuple[int, int, int, float, float]]:
        """(start, end, family number, probability, coverage) of all notices, those that overlap counting once.

        The classifier may overrule templates that are not covered whole.
        """
        judged = []
        for start, end, number, share in self.windows(words):
            p = self.model.probabilities(list(grams_of(words[start:end], self.model.grams)))
            if share == 1 or p.argmax() == number:
                judged.append((start, end, number, float(p[number]), share))
        hits: list[tuple[int, int, int, float, float]] = []
        for hit in sorted(judged, key=lambda h: (-h[4], -h[3], h[0] - h[1], h[0])):
            over = [i for i, h in enumerate(hits) if h[0] < hit[1] and hit[0] < h[1]]
            if not over:
                hits.append(hit)
            elif all(hits[i][2] == hit[2] for i in over):  # one notice by several templates
                same = [hit, *(hits[i] for i in over)]
                best = max(same, key=lambda h: (h[4], h[3]))
                hits = [h for i, h in enumerate(hits) if i not in over]
                hits.append((min(h[0] for h in same), max(h[1] for h in same), *best[2:]))
        return sorted(hits)

    def scan(self, text: str) -> tuple[int, list[tuple[int, int, float, float, int]]]:
        """Number of lines that are not blank, and (first line, family, probability, coverage, last line).

        Notices are looked for in runs of lines without a blank one between them, as they may be wrapped.
        """
        count, hits, run = 0, [], []
        for line in [*text.split("\n"), ""]:
            if line.strip():
                run.append(line)
                continue
            if run:
                hits += self._run(run, count)
                count += len(run)
                run = []
        return count, hits

    def _run(self, lines: list[str], first: int) -> list[tuple[int, int, float, float, int]]:
        split = [words_of(line) for line in lines]
        words = [w for own in split for w in own]
        found = grams_of(words, self.model.grams)
        if not any(sum(g in found for g in grams) >= self.coverage * len(grams) for _, grams in self.templates):
            return []
        line_of = [i for i, own in enumerate(split) for _ in own]
        hits = [(line_of[s], f, p, c, line_of[e - 1]) for s, e, f, p, c in self.stretch(words)]
        for i, line in enumerate(lines):  # a notice with much text put in between
            hit = self.paragraph(line)
            if hit and not any(h[0] <= i <= h[4] and h[1] == hit[0] for h in hits):
                hits.append((i, *hit, i))
        return [(first + a, f, p, c, first + z) for a, f, p, c, z in sorted(hits, key=lambda h: h[0])]


def sample_paragraphs(docs: DataFrame, key: str, text: str) -> list[str]:
    """At most ``SAMPLE`` paragraphs: the first of the documents that come first in hash order."""
    first = F.substring_index(F.col(quoted(text)), "\n", 1)
    rows = docs.select(F.col(quoted(key)).alias("key"), first.alias("p"))
    rows = rows.filter(F.octet_length("p").between(1, SAMPLE_BYTES))
    chosen = first_by_hash(rows, F.xxhash64(F.lit("sample"), "key"), SAMPLE, docs.count())
    return [r["p"] for r in chosen.collect()]


def scan_licences(docs: DataFrame, key: str = "doc_id", text: str = "text", model: LicenceModel | None = None) -> DataFrame:
    """One row per row: key, ``n_paragraphs``, ``hits``.

    Paragraphs are lines that are not blank, counted from 0; a hit tells the first and the last of its notice. A null text has none. Every whole text is
    scanned; only training uses a sample. Rows may repeat or lack a key.
    """
    model = model or train(sample_paragraphs(docs, key, text))
    source = docs.select(F.col(quoted(key)).alias("_key"), text_of(quoted(text)).alias("_text"))
    hit_type = T.StructType([
        T.StructField("paragraph", T.IntegerType()), T.StructField("family", T.StringType()),
        T.StructField("probability", T.DoubleType()), T.StructField("coverage", T.DoubleType()),
        T.StructField("last", T.IntegerType()),
    ])
    schema = T.StructType([
        source.schema[0], T.StructField("n_paragraphs", T.IntegerType()), T.StructField("hits", T.ArrayType(hit_type)),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target, scanner = to_arrow_schema(schema), Scanner(model)
        for batch in batches:
            counts, hits = [], []
            for body in batch.column(1).to_pylist():
                count, found = scanner.scan(body)
                counts.append(count)
                hits.append([
                    {"paragraph": p, "family": FAMILIES[f], "probability": q, "coverage": c, "last": z} for p, f, q, c, z in found
                ])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int32()), pa.array(hits, target.field("hits").type)], schema=target
            )

    return source.mapInArrow(run, schema).withColumnRenamed("_key", key)
