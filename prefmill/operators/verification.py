"""Verdicts of verifier functions over texts, as a column.

The (verifiers x texts) matrix of an instance is worked out inside the instance's
row: no explode, no shuffle, and both stages that need verdicts read them with array
functions. The only data that crosses into Python are the two input arrays.
"""

from __future__ import annotations

import fcntl
import inspect
import marshal
import os
import select
import signal
import struct
import subprocess
import sys
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefmill import shipping  # noqa: F401
from prefmill.operators import verifier_child as child
from prefmill.session import bound_batches

EQ_TRUE, EQ_FALSE, TRUTHY = child.EQ_TRUE, child.EQ_FALSE, child.TRUTHY
ERROR, TIMEOUT = child.ERROR, child.TIMEOUT
FINISHED, OVER_OWN_LIMIT, OVER_STAGE_LIMIT = "finished", "timed_out", "unfinished"
PIPE_BYTES = 1 << 20
# The child runs from its source text, so that it needs no package on the executor.
CHILD_SOURCE = inspect.getsource(child)

VERDICTS = T.StructType(
    [
        T.StructField("timed_out", T.BooleanType()),
        T.StructField("late", T.BooleanType()),
        T.StructField(
            "matrix",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("compiled", T.BooleanType()),
                        T.StructField("codes", T.ArrayType(T.IntegerType())),
                    ]
                )
            ),
        ),
    ]
)
_ARROW_VERDICTS = pa.struct(
    [
        ("timed_out", pa.bool_()),
        ("late", pa.bool_()),
        (
            "matrix",
            pa.list_(pa.struct([("compiled", pa.bool_()), ("codes", pa.list_(pa.int32()))])),
        ),
    ]
)


@dataclass(frozen=True)
class Budget:
    """Limits of a verifier run.

    ``seconds`` bounds each single call (and each compile), ``instance_seconds`` all those
    of an instance together (None: no bound), ``memory_bytes`` what the
    verifiers may take on top of their input. With ``timeout_as_false``
    a call over the limit counts as a failed verdict, and when the instance's time is up so do its remaining
    calls, while verifiers not reached by then count as not compiled; otherwise the instance is marked
    ``timed_out`` at once and its remaining calls are skipped, so an endless loop costs
    one limit per instance.

    ``stage_seconds`` bounds a whole stage (``operators.staging.run_stage``): the instances finished by then count,
    the others are dropped and told apart as unfinished.
    """

    seconds: float = 10.0
    instance_seconds: float | None = 60.0
    stage_seconds: float | None = None
    memory_bytes: int = 1 << 30
    timeout_as_false: bool = False


@dataclass(frozen=True)
class Clock:
    """When a round of a stage ends, in seconds since 1970, the same for all its tasks, and
    how long one instance may hold up the others before it is put off."""

    deadline: float
    patience: float = float("inf")

    def until(self) -> float:
        """When the next instance has to be done, on the monotonic clock."""
        return time.monotonic() + min(self.patience, self.deadline - time.time())


class VerifierProcess:
    """The child process of one task, restarted after a time-out or its death."""

    def __init__(self, budget: Budget):
        self._budget = budget
        self._process = None

    def _start(self) -> None:
        env = {
            "PYTHONHASHSEED": "0",
            "PATH": os.environ.get("PATH", ""),
            "LC_ALL": "C.UTF-8",
        }
        self._process = subprocess.Popen(
            [
                sys.executable, "-S", "-c", CHILD_SOURCE,
                str(self._budget.memory_bytes), *[p for p in sys.path if p],
            ],
            stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL,
            bufsize=0, env=env, cwd="/", start_new_session=True,
        )
        try:
            fcntl.fcntl(self._process.stdin, fcntl.F_SETPIPE_SZ, PIPE_BYTES)
        except OSError:
            pass  # over the system's limit: long texts take more switches
        self._poll = select.poll()
        self._poll.register(self._process.stdout, select.POLLIN)

    def close(self) -> None:
        if self._process is None:
            return
        try:
            os.killpg(self._process.pid, signal.SIGKILL)
        except ProcessLookupError:
            pass
        self._process.stdin.close()
        self._process.stdout.close()
        self._process.wait()
        self._process = None

    def _send(self, request: tuple) -> None:
        payload = marshal.dumps(request)
        if self._process is not None:
            try:
                self._write(payload)
                return
            except BrokenPipeError:
                self.close()
        self._start()
        self._write(payload)

    def _write(self, payload: bytes) -> None:
        data = memoryview(struct.pack("<Q", len(payload)) + payload)
        while data:
            data = data[os.write(self._process.stdin.fileno(), data):]

    def _receive(self, seconds: float) -> bytes | None:
        """Next reply bytes; ``b''`` when the child is gone, None when time is up."""
        deadline = time.monotonic() + seconds
        while True:
            left = deadline - time.monotonic()
            if left <= 0:
                return None
            if self._poll.poll(left * 1000):
                return os.read(self._process.stdout.fileno(), 65536)

    def judge(self, sources: list[str], inputs: list[str], until: float | None = None) -> dict:
        """Verdicts of all sources over all inputs, in order.

        ``until`` is when the stage's time is up, on the monotonic clock. An instance not finished by then
        is late, whatever it waits for: nothing is known of it, and its child is stopped.
        """
        late = {"timed_out": False, "late": True, "matrix": None}
        limit = self._budget.seconds
        matrix: list[dict] = []
        call = -1  # -1: the compile step of the next verifier

        def unfinished() -> bool:
            return call >= 0 or len(matrix) < len(sources)

        whole = self._budget.instance_seconds
        deadline = None if whole is None else time.monotonic() + whole + 5
        careful = False
        while unfinished():
            if until is not None and time.monotonic() >= until:
                self.close()
                return late
            if deadline is not None and time.monotonic() >= deadline:
                self.close()
                if not self._budget.timeout_as_false:
                    return {"timed_out": True, "late": False, "matrix": None}
                while call >= 0:
                    call = self._advance(matrix, inputs, call, TIMEOUT)
                missing = len(sources) - len(matrix)
                matrix += [{"compiled": False, "codes": None} for _ in range(missing)]
                break
            verifier = len(matrix) if call < 0 else len(matrix) - 1
            self._send((sources, inputs, verifier, call, limit, careful))
            allowed = limit + 5  # the first reply also waits for the start of the process
            ended = timed_out = False
            while not ended and not timed_out:
                for end in (deadline, until):
                    if end is not None:
                        allowed = min(allowed, max(0.0, end - time.monotonic()))
                reply = self._receive(allowed)
                allowed = limit + child.FLUSH_SECONDS
                timed_out, ended = reply is None, reply == b""
                for code in reply or b"":
                    if code == child.DONE:
                        ended = True
                    else:
                        call = self._advance(matrix, inputs, call, code)
                if not reply:
                    self.close()
            if until is not None and time.monotonic() >= until and unfinished():
                continue  # the stage's time is up, not that of a call
            if timed_out and not self._budget.timeout_as_false:
                return {"timed_out": True, "late": False, "matrix": None}
            if unfinished() and (deadline is None or time.monotonic() < deadline):
                # Stopped early. Replies may still have been held back then, so the
                # step at fault is only known in careful mode: go on in that mode.
                if careful:
                    call = self._advance(matrix, inputs, call, TIMEOUT if timed_out else ERROR)
                careful = True
        return {"timed_out": False, "late": False, "matrix": matrix}

    @staticmethod
    def _advance(matrix: list[dict], inputs: list[str], call: int, code: int) -> int:
        """Record one finished step; returns the call that comes next."""
        if call < 0:
            compiled = code == child.COMPILED
            matrix.append({"compiled": compiled, "codes": [] if compiled else None})
            return 0 if compiled and inputs else -1
        matrix[-1]["codes"].append(code)
        return call + 1 if call + 1 < len(inputs) else -1


def verdicts(sources: Column, inputs: Column, budget: Budget = Budget(), clock: Clock | None = None) -> Column:
    """Struct (timed_out, late, matrix[verifier].(compiled, codes[input])) for one row.

    Rows that ``clock`` does not let finish are late. A code is a bit set: 1 result == True, 2 result == False, 4 result is truthy,
    8 error, 16 over the time limit. A verifier that did not compile has NULL codes.
    """

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        process = VerifierProcess(budget)
        try:
            for source_lists, input_lists in batches:
                rows = [
                    process.judge(source_list.as_py() or [], input_list.as_py() or [], clock and clock.until())
                    for source_list, input_list in zip(source_lists, input_lists)
                ]
                yield pa.array(rows, type=_ARROW_VERDICTS)
        finally:
            process.close()

    run.__annotations__ = {
        "batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array],
    }
    # Marked non-deterministic so that the optimizer never evaluates it twice.
    return F.arrow_udf(run, returnType=VERDICTS).asNondeterministic()(sources, inputs)


def run_verifiers(
    df: DataFrame, sources: Column, inputs: Column, out: str = "verdicts",
    budget: Budget = Budget(), allow_execution: bool = False, partitions: int | None = None,
    keep_timed_out: bool = False, clock: Clock | None = None,
) -> DataFrame:
    """Add the verdict struct; instances over a time limit are dropped, unless they are
    to be kept, with ``timed_out`` or ``late`` set and no matrix. A column ``{out}_state`` then tells the
    three kinds apart, so that later steps need not look into the struct.

    The sources are generated code. ``allow_execution=True`` confirms that the
    executors are sandboxed. The work is CPU-bound: where input splits are too few or
    uneven for it, ``partitions`` spreads the rows evenly first.
    """
    if not allow_execution:
        raise PermissionError(
            "verifiers are generated code; pass allow_execution=True in a sandboxed cluster"
        )
    bound_batches(df.sparkSession)
    if partitions:
        df = df.repartition(partitions)
    df = df.withColumn(out, verdicts(sources, inputs, budget, clock))
    timed_out, late = F.col(f"{out}.timed_out"), F.col(f"{out}.late")
    if not keep_timed_out:
        return df.filter(~timed_out & ~late)
    state = F.when(late, OVER_STAGE_LIMIT).when(timed_out, OVER_OWN_LIMIT).otherwise(FINISHED)
    return df.withColumn(f"{out}_state", state)


def verdict_rows(df: DataFrame, key: str, verdict: str = "verdicts") -> DataFrame:
    """The matrix as rows: key, verifier_pos, compiled, input_pos, and the verdict flags.

    A verifier that did not compile, or had no input, is one row with NULL input_pos.
    """
    per_verifier = df.select(key, F.posexplode(f"{verdict}.matrix").alias("verifier_pos", "v"))
    per_call = per_verifier.select(
        key, "verifier_pos", F.col("v.compiled").alias("compiled"),
        F.posexplode_outer("v.codes").alias("input_pos", "code"),
    )

    def flag(bit: int) -> Column:
        return F.col("code").bitwiseAND(F.lit(bit)) != 0

    return per_call.select(
        key, "verifier_pos", "compiled", "input_pos",
        flag(EQ_TRUE).alias("eq_true"), flag(EQ_FALSE).alias("eq_false"),
        flag(TRUTHY).alias("truthy"), flag(ERROR).alias("error"), flag(TIMEOUT).alias("timeout"),
    )
