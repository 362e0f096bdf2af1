"""A table of verdicts by content: each distinct pair of verifier and text is judged once.

Generated verifiers and completions repeat, within a stage and from one stage or run to the next. Pairs are
known by the SHA-256 of the source and of the text. What the table lacks is judged in cells of one verifier and some
texts of one instance, cut by cost, and appended; every matrix is then a join with the table. Only keys are matched: a
text moves once, with its instance, however many verifiers it meets.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prefmill.operators.cells import CALL_BYTES, CELL_COST, written_with
from prefmill.operators.staging import observed
from prefmill.operators.verification import TIMEOUT, Budget, run_verifiers

VERDICTS = "verifier_key string, text_key string, compiled boolean, code int"
#: Stands for no text: whether a verifier compiles is known without one.
NO_TEXT = ""
#: Names a part of an instance's matrix.
PART = ("row_id", "text_part", "verifier_part")


def filled(items: Column) -> Column:
    return F.coalesce(F.transform(items, lambda x: F.coalesce(x, F.lit(""))), F.array().cast("array<string>"))


def cut(rows: DataFrame, cell_cost: int) -> DataFrame:
    """Add into how many parts an instance is cut by its cost: ``text_parts``, and ``verifier_parts`` where that is not enough."""
    n_texts, n_verifiers = F.greatest(F.size("texts"), F.lit(1)), F.greatest(F.size("sources"), F.lit(1))
    bytes_ = F.aggregate("texts", F.lit(0).cast("bigint"), lambda a, t: a + F.octet_length(t) + CALL_BYTES)
    asked = F.ceil(bytes_ * n_verifiers / cell_cost)
    rows = rows.withColumn("text_parts", F.least(F.greatest(asked, F.lit(1)), n_texts).cast("int"))
    rest = F.ceil(asked / F.col("text_parts"))
    return rows.withColumn("verifier_parts", F.least(F.greatest(rest, F.lit(1)), n_verifiers).cast("int"))


@dataclass(frozen=True)
class Reuse:
    """``cells`` of all matrices, ``distinct`` pairs among them, and those ``judged`` now, as the others were known."""

    cells: int
    distinct: int
    judged: int


class VerdictTable:
    """Verdicts kept as Parquet under ``path``, a folder that driver and executors share.

    One run at a time may add to a table. Verdicts must not depend on earlier calls: a verifier that keeps
    something between calls belongs to ``run_verifiers``.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def rows(self) -> DataFrame:
        """Everything known so far."""
        try:
            return self.spark.read.schema(VERDICTS).parquet(self.path)
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], VERDICTS)

    def judge(
        self, df: DataFrame, sources: Column, inputs: Column, out: str = "verdicts", budget: Budget = Budget(),
        allow_execution: bool = False, partitions: int | None = None, cell_cost: int = CELL_COST,
        keep_timed_out: bool = False,
    ) -> tuple[DataFrame, Reuse]:
        """As ``run_verifiers``, from the table; adds to the table what it lacks.

        A call over the time limit is kept as such, and so are those that a cell did not reach in ``instance_seconds``.
        Null sources or texts count as empty ones, null arrays as arrays without items.
        """
        if not allow_execution:
            raise PermissionError(
                "verifiers are generated code; pass allow_execution=True in a sandboxed cluster"
            )

        named, own = written_with(df, {"_sources": sources, "_inputs": inputs}, "table-rows")
        rows = cut(named.select("row_id", filled(own["_sources"]).alias("sources"), filled(own["_inputs"]).alias("texts")), cell_cost)
        keyed = rows.select("row_id", "text_parts", "verifier_parts", "sources", F.transform("texts", lambda t: F.sha2(t, 256)).alias("keys"))
        verifiers = keyed.select("*", F.posexplode("sources").alias("verifier_pos", "source"))
        cells = verifiers.select(
            "row_id", "text_parts", "verifier_parts", "verifier_pos", F.sha2("source", 256).alias("verifier_key"),
            F.posexplode_outer("keys").alias("input_pos", "text_key"),
        ).fillna(NO_TEXT, "text_key")
        # A pair is judged in one of the instances that hold it.
        at = F.struct(
            "row_id", F.coalesce(F.col("input_pos") % F.col("text_parts"), F.lit(0)).alias("text_part"),
            (F.col("verifier_pos") % F.col("verifier_parts")).alias("verifier_part"), "verifier_pos", "input_pos",
        )
        needed, found = observed(
            cells.groupBy("verifier_key", "text_key").agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("at")), "needed-pairs",
            {"cells": F.sum("n"), "distinct": F.count("n")},
        )
        missing = needed.join(self.rows(), ["verifier_key", "text_key"], "left_anti").select("at.*")
        judged = self._add(rows, missing, budget, partitions)
        known = cells.join(self.rows(), ["verifier_key", "text_key"])
        per_verifier = known.groupBy("row_id", "verifier_pos").agg(
            F.bool_and("compiled").alias("compiled"),
            F.array_sort(F.collect_list(F.when(F.col("input_pos").isNotNull(), F.struct("input_pos", "code")))).alias("calls"),
        )
        codes = F.when(F.col("compiled"), F.transform("calls", lambda c: c["code"]))
        over = F.exists(codes, lambda c: c.bitwiseAND(F.lit(TIMEOUT)) != 0)
        whole = per_verifier.select(
            "row_id", F.struct("verifier_pos", "compiled", codes.alias("codes")).alias("v"), F.coalesce(over, F.lit(False)).alias("over")
        ).groupBy("row_id").agg(F.array_sort(F.collect_list("v")).alias("vs"), F.bool_or("over").alias("over"))
        joined = named.select("row_id", *[named[c] for c in df.columns]).join(whole, "row_id", "left")
        timed_out = F.lit(False) if budget.timeout_as_false else F.coalesce("over", F.lit(False))
        matrix = F.coalesce(
            F.transform("vs", lambda v: F.struct(v["compiled"].alias("compiled"), v["codes"].alias("codes"))),
            F.array().cast("array<struct<compiled:boolean,codes:array<int>>>"),
        )
        verdict = F.struct(
            timed_out.alias("timed_out"), F.lit(False).alias("late"), F.when(~timed_out, matrix).alias("matrix")
        )
        result = joined.withColumn(out, verdict).drop("row_id", "vs", "over")
        reuse = Reuse(found.get("cells") or 0, found.get("distinct") or 0, judged)
        return result if keep_timed_out else result.filter(~F.col(f"{out}.timed_out")), reuse

    def _add(self, rows: DataFrame, missing: DataFrame, budget: Budget, partitions: int | None) -> int:
        """Judge the missing pairs, each where ``missing`` places it, and append them; returns their number.

        Instances are dealt by hash in the parts that their cost asks for, so that neither a large one nor a verifier or
        text that many share is one task's work. Verifiers come one by one, as they have a limit each.
        """
        def dealt(df: DataFrame) -> DataFrame:
            return df.repartition(partitions, *PART) if partitions else df.repartition(*PART)

        wanted = dealt(missing).groupBy(*PART, "verifier_pos").agg(F.array_sort(F.collect_list("input_pos")).alias("positions"))

        def part_of(items: str, parts: str, part: str) -> Column:
            own = F.filter(items, lambda _, i: i % F.col(parts) == F.col(part))
            return F.when(F.col(parts) == 1, F.col(items)).otherwise(own).alias(items)

        def numbers(parts: str) -> Column:
            return F.explode(F.sequence(F.lit(0), F.col(parts) - 1))

        parts = rows.withColumn("text_part", numbers("text_parts")).withColumn("verifier_part", numbers("verifier_parts")).select(
            *PART, "text_parts", "verifier_parts", part_of("sources", "verifier_parts", "verifier_part"),
            part_of("texts", "text_parts", "text_part"),
        )
        placed = wanted.join(dealt(parts), list(PART))
        source = F.get("sources", F.expr("int(verifier_pos div verifier_parts)"))
        own = F.transform("positions", lambda i: F.get("texts", F.floor(i / F.col("text_parts")).cast("int")))
        cells = placed.select(source.alias("source"), own.alias("texts")).select(
            F.sha2("source", 256).alias("verifier_key"), "source",
            F.transform("texts", lambda t: F.struct(F.sha2(t, 256).alias("text_key"), t.alias("text"))).alias("texts"),
        )
        judged = run_verifiers(
            cells, F.array("source"), F.col("texts.text"), budget=replace(budget, timeout_as_false=True, stage_seconds=None),
            allow_execution=True, keep_timed_out=True,
        )
        verdict = F.get("verdicts.matrix", 0)
        each = F.transform(
            "texts", lambda t, i: F.struct(t["text_key"].alias("text_key"), F.get(verdict["codes"], i).alias("code"))
        )
        alone = F.array(F.struct(F.lit(NO_TEXT).alias("text_key"), F.lit(None).cast("int").alias("code")))
        rows = judged.select("verifier_key", verdict["compiled"].alias("compiled"), F.explode(F.concat(each, alone)).alias("p"))
        rows = rows.select("verifier_key", "p.text_key", "compiled", "p.code")
        # The line for no text comes from every cell of a verifier; one of them is enough.
        new = rows.dropDuplicates(["verifier_key", "text_key"]).join(self.rows(), ["verifier_key", "text_key"], "left_anti")
        written, found = observed(
            new.select("verifier_key", "text_key", "compiled", "code"), "new-verdicts",
            {"texts": F.count(F.when(F.col("text_key") != NO_TEXT, 1))},
        )
        written.write.mode("append").parquet(self.path)
        return found.get("texts") or 0
