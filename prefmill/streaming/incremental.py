"""Incremental, resumable runs of a row-local stage.

The filter and scoring stages decide each instance inside its row, so they run
unchanged on a stream of new files: finished rows are on disk after every trigger, and
a restarted run goes on behind the last committed one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from prefmill.sources.jsonl import LONGEST_STRING, has_maps, parse_lines

RETAINED = "spark.sql.streaming.numRecentProgressUpdates"
POLL_SECONDS = 0.5


def run_incrementally(
    spark: SparkSession, source: str, schema: str, stage: Callable[[DataFrame], DataFrame],
    target: str, checkpoint: str, files_per_trigger: int = 1000,
) -> int:
    """Process the JSON-lines files under ``source`` that no earlier run has seen.

    ``target`` receives Parquet; ``checkpoint`` is a shared folder that belongs to this
    stage and target. Returns the number of input rows read by this run.

    Spark keeps the reports of the last triggers only, so they are gathered while the run
    goes on; a gap in their batch numbers is an error rather than a wrong count.
    """
    kept = spark.conf.get(RETAINED)
    spark.conf.set(RETAINED, max(1000, int(kept)))
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_trigger)
    if has_maps(T.StructType.fromDDL(schema)):
        stream = parse_lines(reader.text(source), schema)
    else:
        stream = reader.schema(schema).options(mode="FAILFAST", maxStringLen=LONGEST_STRING).json(source)
    try:
        query = (
            stage(stream)
            .writeStream.format("parquet")
            .option("path", target)
            .option("checkpointLocation", checkpoint)
            .outputMode("append")
            .trigger(availableNow=True)
            .start()
        )
        rows: dict[int, int] = {}
        ended = False
        while not ended:
            ended = query.awaitTermination(POLL_SECONDS)
            for report in query.recentProgress:
                rows[report["batchId"]] = max(rows.get(report["batchId"], 0), report["numInputRows"])
    finally:
        spark.conf.set(RETAINED, kept)
    if rows and len(rows) != max(rows) - min(rows) + 1:
        raise RuntimeError("reports of some triggers were lost; the data is complete, its count is not")
    return sum(rows.values())
