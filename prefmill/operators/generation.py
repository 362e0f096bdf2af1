"""Batched text generation behind a pluggable backend."""

from __future__ import annotations

import hashlib
import time
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from prefmill import shipping  # noqa: F401
from prefmill.operators.lookup import skew_safe_join

Request = tuple[object, int, str]  # key, sample index, prompt


@dataclass(frozen=True)
class SamplingOptions:
    """What a backend is told about sampling."""

    temperature: float = 1.0
    top_p: float = 1.0
    max_tokens: int = 1024
    context_length: int = 2048
    stop: tuple[str, ...] = ()
    seed: int = 42


Backend = Callable[[list[Request]], list[str]]
BackendFactory = Callable[[SamplingOptions], Backend]


def micro_batches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Re-cut a stream of Arrow batches into ``size`` rows each, the last one short."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= size:
            table = pa.Table.from_batches(held)
            whole = rows - rows % size
            for start in range(0, whole, size):
                yield table.slice(start, size)
            held = table.slice(whole).to_batches() if rows > whole else []
            rows -= whole
    if rows:
        yield pa.Table.from_batches(held)


def generate(
    df: DataFrame, factory: BackendFactory, options: SamplingOptions = SamplingOptions(),
    key: str = "instance_id", prompts: str = "prompts", out: str = "texts",
    batch_size: int = 8, partitions: int | None = None,
) -> DataFrame:
    """One text per prompt of the row's ``prompts`` array, as the array ``out``.

    All samples of a row are asked for and put back inside one task, so N samples per
    prompt cost no explode, shuffle or regroup. The backend is built once per task and
    called with the requests of ``batch_size`` rows at a time. ``partitions`` is the
    number of generators working side by side. The prompts are not carried on.

    Each request names key and sample index: a backend that seeds by these and
    ``options.seed`` gives the same text when a lost task is run again. Write the
    result (``session.materialise``) before using it twice if the backend does not.
    """
    if partitions:
        df = df.repartition(partitions)
    kept = [f for f in df.schema.fields if f.name != prompts]
    schema = T.StructType([*kept, T.StructField(out, T.ArrayType(T.StringType()))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        backend = None
        for table in micro_batches(batches, batch_size):
            if backend is None:
                backend = factory(options)
            keys = table.column(key).to_pylist()
            asked = [texts or [] for texts in table.column(prompts).to_pylist()]
            answers = iter(
                backend([(k, i, p) for k, ps in zip(keys, asked) for i, p in enumerate(ps)])
            )
            texts = pa.array([[next(answers) for _ in ps] for ps in asked], pa.list_(pa.string()))
            columns = [table.column(f.name) for f in kept]
            done = pa.table([*columns, texts], names=[f.name for f in schema])
            yield from done.cast(arrow).to_batches()

    return df.mapInArrow(run, schema)


@dataclass(frozen=True)
class SampleRequest:
    """One prompt, and the places in its row's array that ask for a sample of it."""

    key: object
    prompt: str
    samples: tuple[int, ...]


SampleBackend = Callable[[SampleRequest], list[str]]
SampleBackendFactory = Callable[[SamplingOptions], SampleBackend]


@dataclass(frozen=True)
class Patience:
    """How a request is tried again: ``attempts`` in all, with a pause of ``wait`` seconds that doubles."""

    attempts: int = 3
    wait: float = 0.5


def _tried(backend: SampleBackend, request: SampleRequest, patience: Patience) -> tuple[list[str], int]:
    """The samples, and how often it failed before."""
    for failed in range(patience.attempts):
        try:
            texts = backend(request)
            if len(texts) != len(request.samples):
                raise ValueError(f"{len(texts)} texts for {len(request.samples)} samples")
            return texts, failed
        except Exception:
            if failed + 1 == patience.attempts:
                raise
            time.sleep(patience.wait * 2**failed)
    raise ValueError("at least one attempt is needed")


def generate_in_flight(
    df: DataFrame, factory: SampleBackendFactory, options: SamplingOptions = SamplingOptions(),
    key: str = "instance_id", prompts: str = "prompts", out: str = "texts", in_flight: int = 16,
    patience: Patience = Patience(), retries: str | None = None, missing: str = "error",
    partitions: int | None = None,
) -> DataFrame:
    """As ``generate``, for a backend that answers over a network: many requests are under way at once.

    Each task keeps up to ``in_flight`` requests running and hands its rows on in order; at most twice as many
    requests wait for rows before them, so memory stays bounded. All samples of a prompt are one
    request. A request that fails is tried again by itself; when ``patience`` is at its end the job stops, or with
    ``missing="null"`` its texts are NULL. ``retries`` names a column for the number of failed attempts of a
    row. The backend is built once per task and called from several threads.
    """
    if missing not in ("error", "null"):
        raise ValueError("missing is 'error' or 'null'")
    if partitions:
        df = df.repartition(partitions)
    kept = [f for f in df.schema.fields if f.name != prompts]
    counted = [T.StructField(retries, T.IntegerType())] if retries else []
    schema = T.StructType([*kept, T.StructField(out, T.ArrayType(T.StringType())), *counted])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, backend = to_arrow_schema(schema), None
        waiting: deque[tuple[pa.RecordBatch, int, list[tuple[SampleRequest, Future]]]] = deque()
        pending = 0

        def finish() -> pa.RecordBatch:
            nonlocal pending
            row, size, asked = waiting.popleft()
            pending -= len(asked)
            texts, failures = [None] * size, 0
            for request, future in asked:
                try:
                    samples, failed = future.result()
                except Exception:
                    if missing == "error":
                        raise
                    samples, failed = [None] * len(request.samples), patience.attempts
                failures += failed
                for place, text in zip(request.samples, samples):
                    texts[place] = text
            columns = [row.column(f.name) for f in kept]
            columns += [pa.array([texts], pa.list_(pa.string())), *([pa.array([failures], pa.int32())] if retries else [])]
            return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

        pool = ThreadPoolExecutor(in_flight)
        try:
            for batch in batches:
                for at in range(batch.num_rows):
                    backend = backend or factory(options)
                    row = batch.slice(at, 1)
                    asked = row.column(prompts)[0].as_py() or []
                    places: dict[str, list[int]] = {}
                    for place, prompt in enumerate(asked):
                        places.setdefault(prompt, []).append(place)
                    own = row.column(key)[0].as_py()
                    requests = [SampleRequest(own, p, tuple(at)) for p, at in places.items()]
                    waiting.append((row, len(asked), [(r, pool.submit(_tried, backend, r, patience)) for r in requests]))
                    pending += len(requests)
                    while pending > 2 * in_flight:
                        yield finish()
            while waiting:
                yield finish()
        finally:
            pool.shutdown(wait=False, cancel_futures=True)

    return df.mapInArrow(run, schema)


def flaky(factory: BackendFactory, fails: Callable[[SampleRequest], bool], wait: float = 0.0) -> SampleBackendFactory:
    """A batch backend as a slow remote one, whose first attempt at some requests fails: for trials and tests."""

    def build(options: SamplingOptions) -> SampleBackend:
        backend, seen = factory(options), set()

        def answer(request: SampleRequest) -> list[str]:
            time.sleep(wait)
            if request not in seen and fails(request):
                seen.add(request)
                raise ConnectionError("try again")
            return backend([(request.key, sample, request.prompt) for sample in request.samples])

        return answer

    return build


def template_backend(pattern: str) -> BackendFactory:
    """Deterministic backend: ``pattern`` with ``{n}`` drawn from 10..99.

    The draw is the md5 integer of seed, key, sample index and prompt.
    """

    def factory(options: SamplingOptions) -> Backend:
        def answer(request: Request) -> str:
            key, sample, prompt = request
            digest = hashlib.md5(f"{options.seed}:{key}:{sample}:{prompt}".encode())
            return pattern.replace("{n}", str(int(digest.hexdigest()[:15], 16) % 90 + 10))

        return lambda requests: [answer(r) for r in requests]

    return factory


def replay(
    prompts: DataFrame, recorded: DataFrame, spread: str, prompt: str = "prompt",
    hot_rows: int = 1_000_000, missing: str = "error",
) -> DataFrame:
    """Backend over recorded generations, as an equi-join on (md5 of prompt, sample_idx).

    ``recorded`` has (prompt_md5, sample_idx, text), unique on the first two. Many rows
    may share one prompt; ``skew_safe_join`` spreads them by ``spread``. Every prompt
    stays: one that was not recorded stops the job, or with ``missing="null"`` has a NULL text.
    """
    if missing not in ("error", "null"):
        raise ValueError("missing is 'error' or 'null'")
    keyed = prompts.withColumn("prompt_md5", F.md5(prompt))
    found = skew_safe_join(
        keyed, recorded.withColumn("_recorded", F.lit(True)), ["prompt_md5", "sample_idx"], spread,
        hot_rows=hot_rows, how="left",
    )
    if missing == "error":
        report = F.concat(F.lit("not recorded: prompt "), "prompt_md5", F.lit(", sample "), "sample_idx")
        found = found.withColumn("text", F.when(F.col("_recorded"), F.col("text")).otherwise(F.raise_error(report)))
    return found.drop("_recorded")
