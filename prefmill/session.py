"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

#: What a Python worker holds at once, twice, and the objects it makes of it, whatever the size of a partition.
BATCH_BYTES = {"spark.sql.execution.arrow.maxBytesPerBatch": "8m"}
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Wide rows (verifiers and completions sit in arrays): bound an Arrow batch by
    # bytes as well as by rows, or one batch of long texts fills a Python worker.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    **BATCH_BYTES,
}


#: Folder under the scratch root that the run in progress writes to.
_run: ContextVar[str | None] = ContextVar("run", default=None)


def build_session(
    master: str | None = None, scratch: str | None = None, **conf: str
) -> SparkSession:
    """Session with the defaults above; shuffle partitions stay the cluster's choice.

    ``scratch`` is a folder that driver and executors share. It can only be named before
    the session starts.
    """
    builder = SparkSession.builder.appName("prefmill")
    if master:
        builder = builder.master(master)
    if scratch:
        conf = {"spark.checkpoint.dir": scratch, **conf}
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def bound_batches(spark: SparkSession) -> None:
    """Bound the bytes of Arrow batches in a session that was built elsewhere and names no bound of its own."""
    for key, value in BATCH_BYTES.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``."""
    try:
        root = spark.conf.get("spark.checkpoint.dir")
    except PySparkException:
        root = None
    if not root:
        raise ValueError(
            "no scratch folder: start the session with build_session(scratch=...) or with "
            "spark.checkpoint.dir set to a folder all executors share, or pass a path"
        )
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the scratch folder that no other run uses."""
    folder = _run.get() or f"{scratch_root(spark)}/prefmill"
    return f"{folder}/{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch_run(spark: SparkSession) -> Iterator[str]:
    """What is written to scratch inside goes to one folder, removed at the end.

    Write results that are still needed elsewhere before leaving: frames read from scratch
    cannot be evaluated afterwards.
    """
    folder = f"{scratch_root(spark)}/prefmill/run-{uuid.uuid4().hex}"
    token = _run.set(folder)
    try:
        yield folder
    finally:
        _run.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet and read it back.

    Cuts lineage in a way that survives lost executors. Use it after anything that
    may differ when recomputed, such as sampled generation.
    """
    spark = df.sparkSession
    target = path or scratch_path(spark, name)
    df.write.mode("overwrite").parquet(target)
    return spark.read.schema(df.schema).parquet(target)


def with_stable_row_id(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Add ``row_id``, unique and stable, to rows that came without a key.

    The rows are written once; the id is file name and position in that file, so a
    recomputed task sees the same ids (``monotonically_increasing_id`` would not
    promise that).
    """
    written = materialise(df, name, path)
    return written.selectExpr(
        "*", "concat(_metadata.file_name, ':', _metadata.row_index) AS row_id"
    )
