"""Personal data, and the terms that give it away.

Patterns find e-mail addresses, IP addresses, card and phone numbers: the entities to protect. How strongly
a term gives an entity away is estimated from how they occur together in the corpus. Of the N
words of a corpus, n_c stand near a mention of entity c (at most ``NEAR`` words away), n_t are the term t, and
n_tc are both:

    information of the entity  IC(c) = log2(N / n_c)
    what the term tells of it  PMI(t; c) = log2(n_tc N / (n_t n_c))
    disclosure                 PMI(t; c) / IC(c), one where t never occurs but near c

A term whose disclosure reaches the threshold for any entity is generalised, to the longest of its
beginnings that stays below the threshold itself, counted over all terms that begin so; where none
does, it is removed. It is treated so wherever it occurs, since it gives the entity away without the mention too.

An occurrence is known by the word itself, the one before and the one after, and each is counted once, so
copies of a text add nothing. Near copies do, and so mentions are put into families: pairs of neighbouring words some
way before and behind a mention are its links; the commonest links of an entity's mentions, and what shares a link with mentions
that have them, are one family, and so on with the rest. An entity needs ``support`` families of mentions, and a
term must stand near it in as many.

Only terms rare enough to reach the threshold are counted to the end: n_t may be n_tc (N / n_c)^(1 - threshold) at most,
and a task that alone sees more occurrences of a term says just that.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

import prefmill.shipping  # noqa: F401
from prefmill.llm.common import ASCII_LOWER, ASCII_UPPER, BLANKS, WORD, quoted, text_of
from prefmill.llm.pieces import groups
from prefmill.session import materialise

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
NEAR = 10
#: The words whose pairs tell copies of a mention: so many words away, from and to.
FAR = (6, 9)
SUPPORT = 3
THRESHOLD = 0.95
#: Beginnings of terms that may stand for them.
SHORTEST, LONGEST = 3, 8
#: Terms that are broadcast at once; more take further passes.
MAX_TERMS = 1 << 17
#: Occurrences that a task gathers before it hands them on.
HELD = 1 << 20

WORDS = re.compile(WORD)
LOWER = str.maketrans(ASCII_UPPER, ASCII_LOWER)
LOWER_BYTES = bytes.maketrans(ASCII_UPPER.encode(), ASCII_LOWER.encode())
BLANK_BYTES = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
# No part of these can match again from a later start inside itself, so each is tried once a place.
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
ADDRESS = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
NOT_DIGITS = re.compile("[^0-9]+")

Span = tuple[str, int, int]


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: each @ with a domain, and all that may stand before it."""
    done = 0
    for domain in DOMAIN.finditer(text):
        begin = domain.start()
        while begin > done and text[begin - 1] in LOCAL:
            begin -= 1
        if begin < domain.start():
            done = domain.end()
            yield begin, done


def is_address(number: str) -> bool:
    parts = [p.lstrip("0") for p in number.split(".")]
    return all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)


def is_card(number: str) -> bool:
    digits = NOT_DIGITS.sub("", number)
    if not 13 <= len(digits) <= 19:
        return False
    doubled = [2 * int(d) for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 * (d > 9) for d in doubled)) % 10 == 0


def is_phone(number: str) -> bool:
    return 9 <= len(NOT_DIGITS.sub("", number)) <= 15


def base_spans(text: str) -> list[Span]:
    """Kind, start and end of personal data, in the order of ``KINDS``, then by place."""
    found = [("email", *s) for s in emails(text)] if "@" in text else []
    if not DIGIT.search(text):
        return found
    for kind, pattern, right in (("ip", ADDRESS, is_address), ("card", CARD, is_card), ("phone", PHONE, is_phone)):
        if kind == "phone" and "+" not in text:
            continue
        found += [(kind, *m.span()) for m in pattern.finditer(text) if right(m[0])]
    return found


def entity(text: str, span: Span) -> str:
    kind, start, end = span
    value = text[start:end]
    value = NOT_DIGITS.sub("", value) if kind in ("card", "phone") else value.translate(LOWER)
    return f"{kind}:{value}"


def term_of(word: str) -> str:
    """The word in small letters without punctuation around it; empty if too short for a term."""
    term = word.translate(LOWER).strip(string.punctuation)
    return term if len(term) >= SHORTEST else ""


def context(before: str, word: str, after: str) -> int:
    """Stands for an occurrence of a word between two others."""
    joined = "\0".join((before, word, after)).translate(LOWER).encode("utf-8", "replace")
    return xxhash.xxh3_64_intdigest(joined) - (1 << 63)


def count_words(text: str) -> int:
    """Blanks are single bytes in UTF-8, so a word begins at each other byte behind a blank."""
    if not text:
        return 0
    blank = BLANK_BYTES[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)]
    return int(not blank[0]) + int(np.count_nonzero(blank[:-1] & ~blank[1:]))


@dataclass
class Words:
    """The words of a text: places, spelling, and the terms of those outside personal data."""

    places: list[tuple[int, int]]
    words: list[str]
    free: np.ndarray

    @classmethod
    def of(cls, text: str, spans: list[Span]) -> Words:
        places = [m.span() for m in WORDS.finditer(text)]
        words = [text[a:b] for a, b in places]
        free = np.ones(len(places), dtype=bool)
        if spans and places:
            starts, ends = np.array(places).T
            for _, a, b in spans:
                free[np.searchsorted(ends, a, side="right") : np.searchsorted(starts, b)] = False
        return cls(places, words, free)

    def occurrence(self, i: int, word: str) -> int:
        before = self.words[i - 1] if i else ""
        return context(before, word, self.words[i + 1] if i + 1 < len(self.words) else "")


# -- what the corpus tells ---------------------------------------------------------------

MENTIONS = "entity string, words bigint, links array<bigint>, terms array<string>, contexts array<bigint>"


def mentions(df: DataFrame, text: str) -> DataFrame:
    """A row for each mention of an entity: its links, and the terms near it with their contexts.

    Rows without an entity hold numbers of words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([
            ("entity", pa.string()), ("words", pa.int64()), ("links", pa.list_(pa.int64())), ("terms", pa.list_(pa.string())),
            ("contexts", pa.list_(pa.int64())),
        ])
        for batch in batches:
            for part in groups(t.as_py() for t in batch.column(0)):
                rows, count = {}, 0
                for own in part:
                    spans = base_spans(own)
                    if not spans:
                        count += count_words(own)
                        continue
                    words = Words.of(own, spans)
                    count += len(words.words)
                    starts, ends = np.array(words.places).T
                    for span in spans:
                        first = int(np.searchsorted(ends, span[1], side="right"))
                        last = int(np.searchsorted(starts, span[2]))
                        around = [i for i in range(max(0, first - NEAR), min(len(starts), last + NEAR)) if words.free[i]]
                        terms = [(t, words.occurrence(i, t)) for i in around if (t := term_of(words.words[i]))]
                        rows[entity(own, span), tuple(links(words.words, first, last)), tuple(terms)] = None
                columns = [
                    [*[e for e, _, _ in rows], None], [*[None] * len(rows), count], [*[k for _, k, _ in rows], []],
                    [*[[t for t, _ in near] for _, _, near in rows], []], [*[[c for _, c in near] for _, _, near in rows], []],
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds)], schema=kinds)

    return df.select(text_of(quoted(text))).mapInArrow(run, MENTIONS)


def links(words: list[str], first: int, last: int) -> list[int]:
    """Pairs of neighbours some words before and behind a mention; 0 beyond the text.

    The words next to it do not count: a name that always stands there is what is looked for.
    """
    before = [words[i] if i >= 0 else "" for i in range(first - FAR[1], first - FAR[0] + 1)]
    behind = [words[i] if i < len(words) else "" for i in range(last + FAR[0] - 1, last + FAR[1])]
    pairs = [*zip(before[:-1], before[1:]), *zip(behind[:-1], behind[1:])]
    return [context(f"{i}", a, b) if a or b else 0 for i, (a, b) in enumerate(pairs)]


def families(real: DataFrame, support: int) -> DataFrame:
    """(entity, links, family) of the entities whose mentions fall into ``support`` families at least.

    A family is found in two joins: the commonest link at each place, then what shares a link with a mention
    that has one of these. What remains after ``support - 1`` families is not looked into: each of its mentions
    is a family.
    """
    left = materialise(real.select("entity", "links").distinct(), "mention-links")
    left = left.join(left.groupBy("entity").count().filter(F.col("count") >= support).select("entity"), "entity")
    told = None
    for number in range(support - 1):
        placed = left.select("entity", "links", F.posexplode("links").alias("place", "link")).filter("link <> 0")
        counted = placed.groupBy("entity", "place", "link").count()
        common = counted.groupBy("entity", "place").agg(F.max_by("link", F.struct("count", "link")).alias("link"))
        core = placed.join(common, ["entity", "place", "link"]).select("entity", "links").distinct()
        reached = placed.join(core, ["entity", "links"], "left_semi").select("entity", "place", "link").distinct()
        own = placed.join(reached, ["entity", "place", "link"]).select("entity", "links").distinct()
        own = materialise(own.withColumn("family", F.lit(f"{number}")), "mention-family")
        left = materialise(left.join(own, ["entity", "links"], "left_anti"), "other-mentions")
        told = own if told is None else told.unionByName(own)
    rest = left.withColumn("family", F.concat_ws(":", F.lit("own"), F.xxhash64("links")))
    every = rest if told is None else told.unionByName(rest)
    return every.join(left.select("entity").distinct(), "entity")


def beginnings(term: Column) -> Column:
    """What may stand for a term, shortest first: ``int*`` for instance."""
    lengths = F.filter(F.sequence(F.lit(SHORTEST), F.lit(LONGEST)), lambda k: k < F.length(term))
    return F.transform(lengths, lambda k: F.concat(F.substring(term, F.lit(1), k), F.lit("*")))


class Keys:
    """Terms or their beginnings (``int*``), looked up for many words at once.

    An automaton tells texts that hold none of them in one pass over their bytes.
    """

    def __init__(self, keys: list[str], gone: set[int] = frozenset()):
        self.keys, self.sets = keys, {}
        for i, k in enumerate(keys):
            if i not in gone:
                self.sets.setdefault(len(k) - 1 if k.endswith("*") else None, []).append(i)
        self.values = {n: pa.array([keys[i].rstrip("*") for i in own], pa.large_string()) for n, own in self.sets.items()}
        self.automaton = ahocorasick.Automaton()
        for own in self.values.values():
            for key in own.to_pylist():
                self.automaton.add_word(key.encode().decode("latin-1"), True)
        if self.sets:
            self.automaton.make_automaton()

    def without(self, gone: set[int]) -> Keys:
        """Without the keys at some places; the others keep theirs."""
        return Keys(self.keys, gone)

    def may_hold(self, text: str) -> bool:
        """Whether a key occurs anywhere in the text, inside a word too."""
        plain = text.encode("utf-8", "replace").translate(LOWER_BYTES).decode("latin-1")
        return next(self.automaton.iter(plain), None) is not None

    def find(self, terms: pa.Array) -> list[np.ndarray]:
        """For each kind of key the place of each term's key, or -1."""
        found = []
        for length, own in self.sets.items():
            asked = terms if length is None else pc.utf8_slice_codeunits(terms, 0, length)
            at = pc.fill_null(pc.index_in(asked, value_set=self.values[length]), -1).to_numpy(zero_copy_only=False)
            if length is not None:
                at = np.where(pc.utf8_length(terms).to_numpy(zero_copy_only=False) > length, at, -1)
            found.append(np.where(at >= 0, np.array([*own, -1])[at], -1))
        return found


def matches(texts: list[str], keys: Keys) -> Iterator[tuple[int, Words, list[tuple[int, int]]]]:
    """Texts with hits: number, words, and for each hit the word's number and its key's place in the list."""
    chosen = [i for i, t in enumerate(texts) if keys.may_hold(t)] if keys.sets else []
    if not chosen:
        return
    asked = pa.array([texts[i].encode("utf-8", "replace").decode() for i in chosen], pa.large_string())
    split = pc.split_pattern_regex(asked, BLANKS)
    coded = split.flatten().dictionary_encode()
    terms = pc.utf8_trim(pc.ascii_lower(coded.dictionary), string.punctuation)
    long = pc.greater_equal(pc.utf8_length(terms), SHORTEST).to_numpy(zero_copy_only=False)
    places = [np.where(long, at, -1) for at in keys.find(terms)]
    hot = np.zeros(len(coded.dictionary), dtype=bool)
    for at in places:
        hot |= at >= 0
    if not hot.any():
        return
    codes, edges = coded.indices.to_numpy(), split.offsets.to_numpy()
    empty = pc.equal(pc.binary_length(coded.dictionary), 0).to_numpy(zero_copy_only=False)
    for at_ in np.unique(np.searchsorted(edges, np.flatnonzero(hot[codes]), side="right") - 1):
        text = texts[chosen[at_]]
        words = Words.of(text, base_spans(text))
        own = codes[edges[at_] : edges[at_ + 1]]
        own = own[~empty[own]]  # blanks at either end leave an empty word
        hits = [
            (int(i), int(at[own[i]])) for i in np.flatnonzero(hot[own] & words.free) for at in places if at[own[i]] >= 0
        ]
        if hits:
            yield chosen[at_], words, hits


def in_parts(keys: DataFrame, column: str, max_terms: int) -> Iterator[list]:
    """Rows of ``keys`` in lists of about ``max_terms``, by hash."""
    number = max(1, -(-keys.count() // max_terms))
    for part in range(number):
        rows = keys.filter(F.pmod(F.xxhash64(column), F.lit(number)) == part).collect()
        if rows:
            yield rows


def occurrences(df: DataFrame, text: str, keys: DataFrame, max_terms: int) -> DataFrame:
    """How many occurrences a key has in the corpus, where these are ``cap`` at most: (key, n).

    A task that finds more of a key says so and gathers no further ones, so a frequent word is one row a task.
    """
    spark, counted = df.sparkSession, None
    for rows in in_parts(keys, "key", max_terms):
        sent = spark.sparkContext.broadcast([(r["key"], r["cap"]) for r in rows])

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            caps = [cap for _, cap in sent.value]
            known = Keys([key for key, _ in sent.value])
            seen: dict[int, set[int]] = {}
            held, gone = 0, set()

            def out(rows: list[tuple[int, int | None]]) -> pa.RecordBatch:
                columns = [pa.array([known.keys[k] for k, _ in rows], pa.string()), pa.array([c for _, c in rows], pa.int64())]
                return pa.RecordBatch.from_arrays(columns, names=["key", "context"])

            for batch in batches:
                for part in groups(t.as_py() for t in batch.column(0)):
                    over = set()
                    for _, words, hits in matches(part, known):
                        for i, place in hits:
                            if place in over:
                                continue
                            own = seen.setdefault(place, set())
                            before = len(own)
                            own.add(words.occurrence(i, term_of(words.words[i])))
                            held += len(own) - before
                            if len(own) > caps[place]:
                                over.add(place)
                                held -= len(seen.pop(place))
                    if over:
                        gone |= over
                        known = known.without(gone)
                        yield out([(k, None) for k in over])
                    if held > HELD:
                        yield out([(k, c) for k, own in seen.items() for c in own])
                        seen, held = {}, 0
            if held:
                yield out([(k, c) for k, own in seen.items() for c in own])

        found = df.select(text_of(quoted(text))).mapInArrow(run, "key string, context bigint").distinct()
        own = found.groupBy("key").agg(F.count("context").alias("n"), F.count_if(F.col("context").isNull()).alias("over"))
        own = materialise(own.filter("over = 0").select("key", "n"), "key-counts")
        counted = own if counted is None else counted.unionByName(own)
    return spark.createDataFrame([], "key string, n bigint") if counted is None else counted


def disclosure(together: Column, of_key: Column, of_entity: Column, words: int) -> Column:
    """PMI over IC; an entity that is near every word has no information to disclose."""
    pmi = F.log2(together * F.lit(float(words)) / (of_key.cast("double") * of_entity))
    information = F.log2(F.lit(float(words)) / of_entity)
    return F.when(information > 0, pmi / information).otherwise(0.0)


@dataclass
class Model:
    """``terms``: term, what stands for it (null: removed), the entity it discloses most and how much."""

    words: int
    terms: DataFrame


def fit(
    df: DataFrame, text: str = "text", threshold: float = THRESHOLD, support: int = SUPPORT, max_terms: int = MAX_TERMS,
) -> Model:
    """Find the terms that disclose personal data, from all rows and whole texts.

    Null and empty texts, and so empty tables, add nothing. Counts are of distinct occurrences, so repeated
    rows add nothing either. What is shuffled are the words near mentions, and occurrences of terms that
    stand near one entity ``support`` times; a hot entity or term is spread by its occurrences.
    """
    spark = df.sparkSession
    found = materialise(mentions(df, text), "mentions")
    words = found.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    none = Model(words, spark.createDataFrame([], "term string, general string, entity string, disclosure double"))
    real = found.filter("entity IS NOT NULL")
    shared = families(real, support)
    pairs = F.explode(F.arrays_zip("terms", "contexts")).alias("o")
    near = materialise(
        real.join(shared, ["entity", "links"]).select("entity", "family", pairs)
        .select("entity", "family", F.col("o.terms").alias("key"), F.col("o.contexts").alias("context")).distinct(),
        "near-terms",
    )
    sizes = near.groupBy("entity").agg(F.count_distinct("key", "context").alias("of_entity"))

    def together(near: DataFrame, least: int) -> DataFrame:
        """Keys near entities, and up to how many occurrences in all they reach the threshold."""
        counted = near.groupBy("entity", "key").agg(
            F.count_distinct("context").alias("together"), F.count_distinct("family").alias("families")
        )
        rarity = F.pow(F.lit(float(words)) / F.col("of_entity"), F.lit(1 - threshold))
        return counted.filter(F.col("families") >= least).join(sizes, "entity").withColumn(
            "cap", F.ceil(F.col("together") * rarity * (1 + 1e-9))
        )

    terms = materialise(together(near, support), "near-pairs")
    options = materialise(
        terms.select(F.col("key").alias("term")).distinct().select("term", F.explode(beginnings(F.col("term"))).alias("key")),
        "beginnings",
    )
    begun = near.select("entity", "family", F.explode(beginnings(F.col("key"))).alias("key"), "context")
    begun = together(begun.join(options.select("key").distinct(), "key").distinct(), 1)
    pairs = materialise(terms.unionByName(begun), "key-pairs")
    keys = materialise(pairs.groupBy("key").agg(F.max("cap").alias("cap")), "candidate-keys")
    if keys.isEmpty():
        return none
    value = disclosure(F.col("together"), F.col("n"), F.col("of_entity"), words)
    strong = materialise(
        pairs.join(occurrences(df, text, keys, max_terms), "key").withColumn("disclosure", value)
        .filter(F.col("disclosure") >= threshold).select("key", "entity", "disclosure"),
        "disclosing-keys",
    )
    top = F.struct("disclosure", "entity")
    worst = strong.filter(~F.col("key").endswith("*")).groupBy("key").agg(F.max_by(top, top).alias("w"))
    worst = worst.select(F.col("key").alias("term"), "w.entity", "w.disclosure")
    safe = options.join(strong.select("key").distinct(), "key", "left_anti")
    general = safe.groupBy("term").agg(F.max_by("key", F.length("key")).alias("general"))
    return Model(words, materialise(worst.join(general, "term", "left").select("term", "general", "entity", "disclosure"), "disclosing-terms"))


# -- spans -------------------------------------------------------------------------------

SPANS = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
    T.StructField("replacement", T.StringType()),
]))
REMOVED = "[removed]"


def rewrite(text: str, spans: list[tuple[str, int, int, str]]) -> str:
    """The text with each span replaced; of spans that overlap the one that begins first, then the longest."""
    out, at = [], 0
    for _, start, end, replacement in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], replacement]
        at = max(at, end)
    return "".join([*out, text[at:]])


def sanitise(
    df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, rewritten: bool = True,
    max_terms: int = MAX_TERMS,
) -> DataFrame:
    """Columns ``keep`` (all by default), ``spans`` (kind, start, end in code points, replacement; by kind as in
    ``KINDS``, terms last, then by place) and, if asked for, ``sanitised``.

    Personal data is replaced by its kind in brackets, a disclosing term by what stands for it. A term that
    overlaps personal data is left to it. A null or empty text has no spans. Rows of one key stay apart, and a
    null key is carried along; an input column that bears a result's name is replaced. Row by row, without a
    shuffle; further terms than ``max_terms`` take further passes over the rows.
    """
    spark = df.sparkSession
    results = [T.StructField("spans", SPANS), *([T.StructField("sanitised", T.StringType())] if rewritten else [])]
    taken = {f.name for f in results}
    kept = [c for c in (df.columns if keep is None else keep) if c not in taken]
    names = [f"c{i}" for i in range(len(kept))]
    columns = [F.col(quoted(c)).alias(n) for n, c in zip(names, kept)]  # whatever they are called
    rows = df.select(*columns, text_of(quoted(text)).alias("text"), F.lit(None).cast(SPANS).alias("spans"))
    parts = list(in_parts(model.terms.select("term", "general"), "term", max_terms)) or [[]]
    for part in parts:
        rows = _add_terms(rows, names, [(r["term"], r["general"] or REMOVED) for r in part])
    if rewritten:
        rows = _add_text(rows)
    return rows.select(*[F.col(n).alias(c) for n, c in zip(names, kept)], *[f.name for f in results])


def _add_terms(rows: DataFrame, names: list[str], terms: list[tuple[str, str]]) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(terms)
    schema, own = rows.schema, len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target, known = to_arrow_schema(schema), Keys([t for t, _ in sent.value])
        stands = [g for _, g in sent.value]
        for batch in batches:
            at = 0
            for part in groups(t.as_py() for t in batch.column(own)):
                given = batch.slice(at, len(part))
                spans = [
                    [{"kind": k, "start": a, "end": b, "replacement": f"[{k}]"} for k, a, b in base_spans(t)]
                    if before is None else before
                    for t, before in zip(part, given.column(own + 1).to_pylist())
                ]
                if stands:
                    for number, words, hits in matches(part, known):
                        for i, place in hits:
                            key = known.keys[place]
                            begin = words.places[i][0] + words.words[i].translate(LOWER).find(key)
                            spans[number].append(
                                {"kind": TERM, "start": begin, "end": begin + len(key), "replacement": stands[place]}
                            )
                    order = {k: i for i, k in enumerate((*KINDS, TERM))}
                    spans = [sorted(s, key=lambda x: (order[x["kind"]], x["start"])) for s in spans]
                values = [*[given.column(i) for i in range(own + 1)], pa.array(spans, target[own + 1].type)]
                yield pa.RecordBatch.from_arrays([v.cast(f.type) for v, f in zip(values, target)], schema=target)
                at += len(part)

    return rows.mapInArrow(run, schema)


def _add_text(rows: DataFrame) -> DataFrame:
    @F.arrow_udf(T.StringType())
    def rewritten(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([
            rewrite(t.as_py(), [(s["kind"], s["start"], s["end"], s["replacement"]) for s in own.as_py()])
            for t, own in zip(texts, spans)
        ], pa.string())

    return rows.withColumn("sanitised", rewritten("text", "spans"))
