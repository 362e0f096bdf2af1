"""Verifier stages that end in time, with totals gathered by the job that writes the rows.

A stage with a time limit runs in rounds. Each round is one job with a deadline that all its tasks
share: instances judged by then are written for good, the others are written back as they came and are
the next round's input, spread anew. So a lost executor or a retried task costs a part of a round and never
what earlier rounds have finished, and stragglers are not bound to the task they started in. An instance that takes
long is put off, so that it does not hold up those behind it; how long it may take doubles with every round. Without a
limit, or when all is done at once, there is one round. What is left when the time is up is dropped and counted.

Totals are Spark observations on the rows as they go into the file: they need no second pass, and only attempts
that Spark commits are counted.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from prefmill.operators.verification import FINISHED, OVER_OWN_LIMIT, OVER_STAGE_LIMIT, Budget, Clock
from prefmill.session import materialise

#: A round ends after half of the time that is left, the last one with the stage. An instance is put off after
#: this share of the first round; that time doubles with every round.
TRIES = 64
SHORTEST_TRY, SHORTEST_ROUND = 0.5, 4.0  # seconds: a child, and a job, have to start first
MARK = "verdicts_state"


@dataclass(frozen=True)
class StageRun:
    """``rows``: finished instances, as written. ``totals``: what was asked for, over these, and the
    numbers of instances ``finished``, ``timed_out`` (over a limit of their own) and ``unfinished``
    (the stage's time was up). ``rounds``: jobs that were run.
    """

    rows: DataFrame
    totals: dict[str, int]
    rounds: int


def observed(
    df: DataFrame, name: str, totals: dict[str, Column], kept: Callable[[DataFrame], DataFrame] = lambda rows: rows,
) -> tuple[DataFrame, dict[str, int]]:
    """Write what is ``kept`` of ``df`` and gather ``totals`` over all its rows in the same job."""
    watch = Observation(f"{name}-{uuid.uuid4().hex}")
    written = materialise(kept(df.observe(watch, *[total.alias(k) for k, total in totals.items()])), name)
    return written, watch.get


def run_stage(
    df: DataFrame, judge: Callable[[DataFrame, Clock | None], DataFrame], outputs: list[str],
    totals: dict[str, Column], budget: Budget, name: str,
) -> StageRun:
    """Run a verifier stage over ``df`` and write its ``outputs``.

    ``judge`` takes instances and a clock (None: there is no limit) and adds ``verdicts``, time-outs kept, and the
    outputs. ``totals`` are sums over the outputs of finished rows; those of other rows are null.
    """
    seconds, spread = budget.stage_seconds, None
    deadline = None if seconds is None else time.time() + seconds
    state = F.col(MARK)
    states = (FINISHED, OVER_OWN_LIMIT, OVER_STAGE_LIMIT)
    counts = {s: F.count(F.when(state == s, 1)) for s in states}
    summed = dict.fromkeys([*totals, FINISHED, OVER_OWN_LIMIT], 0)
    done, pending, used, clock = None, df, 0, None

    def finished(rows: DataFrame) -> DataFrame:
        return rows.filter(state == FINISHED).select(*outputs)

    while True:
        if deadline:
            patience, part = max(SHORTEST_TRY, seconds / TRIES) * 2**used, (deadline - time.time()) / 2
            clock = Clock(deadline if part < SHORTEST_ROUND else time.time() + part, patience)
        used += 1
        judged = judge(pending, clock)
        # Null unless finished: nothing is known of the others, and totals pass over nulls.
        columns = [F.when(state == FINISHED, F.col(c)).alias(c) for c in outputs]
        again = F.when(state == OVER_STAGE_LIMIT, F.struct(*df.columns)).alias("_again")
        marked = judged.select(*columns, MARK, *([again] if deadline else []))
        # Without a limit nothing is put off: only finished rows are written, and no mark.
        written, found = observed(marked, name, totals | counts, *([] if deadline else [finished]))
        for key in summed:
            summed[key] += found.get(key) or 0
        rows = finished(written) if deadline else written
        done = rows if done is None else done.unionByName(rows)
        late = found.get(OVER_STAGE_LIMIT) or 0
        if not late or time.time() >= deadline:
            return StageRun(done, summed | {OVER_STAGE_LIMIT: late}, used)
        spread = spread or max(written.rdd.getNumPartitions(), df.sparkSession.sparkContext.defaultParallelism)
        pending = written.filter(state == OVER_STAGE_LIMIT).select("_again.*").repartition(spread)
