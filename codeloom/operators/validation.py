"""Validators in order over many patches at once; a patch that fails one isn't shown to the next."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ValidationError
from .graph import cut_lineage, kept_until_failure
from .patching import syntax_problem

#: edits (patch_id, path, content, is_deletion) to (patch_id, verdict, summary); a patch without a row passes.
Validator = Callable[[DataFrame], DataFrame]


def syntax(edits: DataFrame) -> DataFrame:
    """FAIL with all problems in order of paths, if a Python file that isn't deleted doesn't parse or has no content."""
    python = F.lower("path").rlike(r"\.pyi?$") & ~F.col("is_deletion")
    problem = F.when(F.col("content").isNull(), F.lit("unreadable")).otherwise(syntax_problem("path", "content"))
    looked = edits.withColumn("python", python).withColumn("problem", F.when(python, problem))
    told = F.when(F.col("problem").isNotNull(), F.struct("path", F.concat_ws(": ", "path", "problem").alias("text")))
    rows = looked.groupBy("patch_id").agg(F.array_sort(F.collect_list(told)).alias("problems"), F.count_if("python").alias("checked"))
    bad = F.size("problems") > 0
    summary = F.when(bad, F.array_join("problems.text", "\n")).otherwise(F.format_string("%d files parse", "checked"))
    return rows.select("patch_id", F.when(bad, "FAIL").otherwise("PASS").alias("verdict"), summary.alias("summary"))


def validated(edits: DataFrame, validators: Sequence[tuple[str, Validator]]) -> tuple[DataFrame, DataFrame]:
    """(results, reports): results (patch_id, ordinal, validator, verdict, summary), reports (patch_id, overall).

    The first FAIL or ERROR ends a patch's run and fails it; a validator that crashes is an ERROR of all it was shown;
    WARN lets the run go on.  A patch with no validators passes.
    """
    alive = cut_lineage(edits.select("patch_id").distinct())
    every, results = alive, edits.sparkSession.createDataFrame([], f"patch_id {edits.schema['patch_id'].dataType.simpleString()}, ordinal int, validator string, verdict string, summary string")
    for ordinal, (name, validator) in enumerate(validators):
        try:
            told = validator(edits.join(alive, "patch_id", "left_semi"))
            if missing := {"patch_id", "verdict", "summary"} - set(told.columns):
                raise ValidationError(f"{name} gives no {', '.join(sorted(missing))}")
            told = told.select("patch_id", "verdict", "summary")
            rows = alive.join(told, "patch_id", "left").select("patch_id", F.coalesce("verdict", F.lit("PASS")).alias("verdict"), "summary")
            rows = cut_lineage(rows)
        except Exception as e:  # noqa: BLE001
            rows = cut_lineage(alive.select("patch_id", F.lit("ERROR").alias("verdict"), F.lit(f"validator crashed: {e}").alias("summary")))
        results = results.unionByName(rows.select("patch_id", F.lit(ordinal).alias("ordinal"), F.lit(name).alias("validator"), "verdict", "summary"))
        alive = cut_lineage(rows.where(~F.col("verdict").isin("FAIL", "ERROR")).select("patch_id"))
    reports = every.join(rollup(results), "patch_id", "left").select("patch_id", F.coalesce("overall", F.lit("PASS")).alias("overall"))
    return results, reports


def rollup(results: DataFrame, group: str = "patch_id", order: Sequence[str] = ("ordinal",)) -> DataFrame:
    """(group, kept, overall) of results already known: those up to the first FAIL or ERROR count, and the worst rules.

    One shuffle, by group; for results that come from elsewhere and may go on after a failure.
    """
    kept = kept_until_failure(results, group, list(order))
    worst = F.when(F.bool_or(F.col("verdict").isin("FAIL", "ERROR")), "FAIL").when(F.bool_or(F.col("verdict") == "WARN"), "WARN").otherwise("PASS")
    return kept.groupBy(group).agg(F.count("*").alias("kept"), worst.alias("overall"))
