"""JSON-lines scans and sinks with explicit schemas, and the shard merge."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefmill import shipping  # noqa: F401
from prefmill.functions.slices import sliced
from prefmill.session import bound_batches

INSTRUCTIONS = "instance_id BIGINT, query STRING, instruction STRING"
ARTIFACTS = f"{INSTRUCTIONS}, verifiers ARRAY<STRING>, testcases ARRAY<STRING>"
# The counters of the filter stage, in the order of its steps.
COUNTERS = (
    "verifier_count", "testcase_str_count", "compiled_verifiers", "test_cases_parse",
    "test_cases_pass_gte1", "verifiers_pass_80pct", "total_passes", "unique_instances",
)
# On disk a test case is the list [response, result], which only reads back as text.
FILTERED = (
    f"{INSTRUCTIONS}, verifiers ARRAY<STRING>, test_cases ARRAY<ARRAY<STRING>>, "
    + ", ".join(f"{c} INT" for c in COUNTERS)
)
COMPLETIONS = f"{FILTERED}, completions ARRAY<STRING>"
SCORED = (
    f"{INSTRUCTIONS}, verifiers ARRAY<STRING>, chosen ARRAY<STRING>, rejected ARRAY<STRING>, "
    "scores MAP<STRING,DOUBLE>"
)


# Spark's own reader takes strings of any length when told so, but no field name above 50,000
# characters, and there is no option for that.
LONGEST_STRING = (1 << 31) - 1


def has_maps(kind: T.DataType) -> bool:
    """Whether an object's field names are data."""
    if isinstance(kind, T.StructType):
        return any(has_maps(f.dataType) for f in kind)
    return isinstance(kind, T.MapType) or isinstance(kind, T.ArrayType) and has_maps(kind.elementType)


def _text(value: Any) -> str:
    """Text as it is, any other value as JSON; half a surrogate pair has no place in a Spark string."""
    text = value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    try:
        text.encode()
    except UnicodeEncodeError:
        text = text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")
    return text


def value_reader(kind: T.DataType) -> Callable[[Any], Any]:
    """A function from parsed JSON to a value of the type; a value of another type is an error."""
    exact = {
        T.StringType: ((object,), _text), T.BooleanType: ((bool,), bool), T.LongType: ((int,), int),
        T.IntegerType: ((int,), int), T.DoubleType: ((int, float), float),
    }
    if type(kind) in exact:
        allowed, make = exact[type(kind)]
    elif isinstance(kind, T.ArrayType):
        item, allowed = value_reader(kind.elementType), (list,)
        make = lambda value: [item(v) for v in value]
    elif isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        item, allowed = value_reader(kind.valueType), (dict,)
        # The first of equal names has the place and the last the value.
        make = lambda value: [(_text(k), item(v)) for k, v in value.items()]
    elif isinstance(kind, T.StructType):
        fields, allowed = [(f.name, value_reader(f.dataType)) for f in kind], (dict,)
        make = lambda value: {name: read(value.get(name)) for name, read in fields}
    else:
        raise TypeError(f"no JSON reader for {kind.simpleString()}")

    def read(value: Any) -> Any:
        if value is None:
            return None
        if not isinstance(value, allowed) or isinstance(value, bool) and bool not in allowed and object not in allowed:
            raise ValueError(f"{str(value)[:80]!r} is no {kind.simpleString()}")
        return make(value)

    return read


def parse_lines(lines: DataFrame, schema: str | T.StructType) -> DataFrame:
    """Rows of ``schema`` from the column ``value``, one JSON object each, whatever the lengths of names and values.

    Objects read as maps keep the order of their names. Blank lines have no row; a line that
    is no object of the schema stops the job.
    """
    schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target, read = to_arrow_schema(schema), value_reader(schema)
        # Parsed values take many times the room of their lines: they are made a few lines at a time.
        for lines in (part for batch in batches for part in sliced(batch.column(0))):
            rows = []
            for line in lines:
                line = line.as_py()
                if line is None or not line.strip():
                    continue
                try:
                    rows.append(read(json.loads(line)) or {})
                except ValueError as error:
                    raise ValueError(f"malformed line {line[:200]!r}: {error}") from None
            yield pa.RecordBatch.from_arrays(
                [pa.array([r.get(f.name) for r in rows], f.type) for f in target], schema=target
            )

    bound_batches(lines.sparkSession)
    return lines.select("value").mapInArrow(run, schema)


def read_jsonl(spark: SparkSession, path, schema: str | T.StructType) -> DataFrame:
    """One JSON object per line; a malformed line stops the job.

    Schemas are never inferred: inference costs a pass over the data and turns the
    score object into one column per distinct completion. Where field names are data,
    as in that object, lines are split by Spark and parsed in Arrow batches.
    """
    schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    if has_maps(schema):
        df = parse_lines(spark.read.text(path), schema)
    else:
        df = spark.read.schema(schema).options(mode="FAILFAST", maxStringLen=LONGEST_STRING).json(path)
    if "test_cases" in df.columns:
        df = df.withColumn(
            "test_cases",
            F.transform(
                "test_cases",
                lambda c: F.struct(
                    F.get(c, 0).alias("response"), (F.get(c, 1) == "true").alias("result")
                ),
            ),
        )
    if "scores" in df.columns:
        df = df.withColumn(
            "scores",
            F.transform(
                F.map_entries("scores"),
                lambda e: F.struct(e["key"].alias("completion"), e["value"].alias("score")),
            ),
        )
    return df


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object per line, replacing what was there.

    Scores are written as an object and test cases as ``[response, result]`` lists,
    as downstream readers of the format expect.
    """
    if "scores" in df.columns:
        df = df.withColumn("scores", F.map_from_entries("scores"))
    if "test_cases" not in df.columns:
        df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
        return
    # A list of mixed types has no Spark type: write the objects as text lines.
    cases = F.concat(
        F.lit("["),
        F.array_join(
            F.transform(
                "test_cases",
                lambda c: F.concat(
                    F.lit("["), _json_string(c["response"]), F.lit(","),
                    c["result"].cast("string"), F.lit("]"),
                ),
            ),
            ",",
        ),
        F.lit("]"),
    )
    others = [c for c in df.columns if c != "test_cases"]
    end = F.lit("}")
    if others:
        rest = F.to_json(F.struct(*others), {"ignoreNullFields": "false"})
        end = F.concat(F.lit(","), F.substr(rest, F.lit(2)))
    line = F.concat(F.lit('{"test_cases":'), F.coalesce(cases, F.lit("null")), end)
    df.select(line.alias("value")).write.mode("overwrite").text(path)


def _json_string(text):
    """A string as a JSON literal: the inside of a one-element JSON list."""
    listed = F.to_json(F.array(text))
    return F.substr(listed, F.lit(2), F.length(listed) - 2)


def shard_files(fs, spark: SparkSession, pattern: str) -> list:
    """Statuses of the files that a pattern names, in order; a folder stands for the data files in it."""
    found = []
    for entry in sorted(fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(pattern)) or [], key=lambda s: s.getPath().toString()):
        inside = fs.listStatus(entry.getPath()) if entry.isDirectory() else [entry]
        files = [s for s in inside if s.isFile() and s.getPath().getName()[0] not in "._" or s is entry]
        found += sorted(files, key=lambda s: s.getPath().toString())
    return found


def merge_shards(spark: SparkSession, prefix: str, suffix: str = ".jsonl", sign: str = "-") -> str:
    """Concatenate the shards ``{prefix}{sign}*{suffix}``, in order of name, into one file ``{prefix}{suffix}``.

    A shard is a file or a folder of part files. Bytes are copied as they are, by the file system's own streams; a
    shard that does not end its last line gets a line break, so no record fuses with the next one. The file is written
    under another name and takes the place of an older target only when it is whole. One file means one writer: to
    read many large shards, read the pattern.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    target = path(f"{prefix}{suffix}")
    fs = target.getFileSystem(conf)
    whole, fresh = fs.makeQualified(target), path(target.getParent(), f".{target.getName()}.{uuid.uuid4().hex}")
    shards = [s for s in shard_files(fs, spark, f"{prefix}{sign}*{suffix}") if s.getPath() != whole]
    if not shards:
        raise FileNotFoundError(f"no shards {prefix}{sign}*{suffix}")
    try:
        out = fs.create(fresh, False)
        try:
            for shard in shards:
                if not shard.getLen():
                    continue
                source = fs.open(shard.getPath())
                try:
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 20, False)
                    source.seek(shard.getLen() - 1)
                    if source.read() != ord("\n"):
                        out.write(ord("\n"))
                finally:
                    source.close()
        finally:
            out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf)
        if fs.exists(target) and fs.getFileStatus(target).isDirectory():
            raise FileExistsError(f"{target} is a folder")
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        options = spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context.rename(fs.makeQualified(fresh), whole, options)
    finally:
        if fs.exists(fresh):
            fs.delete(fresh, False)
    return target.toString()
