"""Checks of result files: every rule as one row, with its severity, count and first offenders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.sources.cache import exists
from linkloom.sources.directories import lines_of

EXAMPLES = 5
_FINDING = "file string, rule string, severity string, n long, examples string"


def _finding(offenders: DataFrame, file: str, rule: str, severity: str = "error") -> DataFrame:
    """offenders(id): one row, the first of them by code point."""
    ids = offenders.select(F.col("id").cast("string").alias("id")).distinct()
    first = ids.orderBy("id").limit(EXAMPLES).agg(F.array_join(F.array_sort(F.collect_list("id")), ", ").alias("examples"))
    return ids.agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(first)).select(F.lit(file).alias("file"), F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), "n", "examples")


def _fatal(spark: SparkSession, file: str, rule: str, severity: str = "error") -> DataFrame:
    return spark.createDataFrame([(file, rule, severity, 1, "")], _FINDING)


def _test(c: Column, pattern: str) -> Column:
    return c.rlike(pattern)


def check_lists(spark: SparkSession, path: str, header: tuple[str, str], required: DataFrame, targets: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Findings of one file, and its rows (s1_id, other_id; a null other_id for an empty list), or None if it cannot be read.

    required(entity_id): entities that need a row each; targets(entity_id): ids that may be named, if that is checked.
    """
    file = header[1]
    if not exists(spark, path):
        return _fatal(spark, file, "file missing"), None
    lines = lines_of(spark, path)
    first = lines.filter("line = 1").select("value").first()
    if first is None:
        return _fatal(spark, file, "file empty"), None
    if "\t" not in first["value"] and "," in first["value"]:
        return _fatal(spark, file, "separated by commas"), None
    if tuple(c.strip().lower() for c in first["value"].split("\t")) != header:
        return _fatal(spark, file, "wrong header"), None
    rows = lines.filter("line > 1")
    tab = F.contains("value", F.lit("\t"))
    parts = F.split("value", "\t", 2)
    listed = rows.filter(tab).select(parts[0].alias("s1_id"), parts[1].alias("rest"))
    ids = F.when(F.trim("rest") == "", F.array().cast("array<string>")).otherwise(F.split("rest", ","))
    listed = listed.select("s1_id", ids.alias("ids"))
    named = listed.select("s1_id", F.explode_outer(F.array_distinct("ids")).alias("other_id"))
    others = named.filter("other_id IS NOT NULL").select(F.col("other_id").alias("id"))
    seen = listed.select(F.col("s1_id").alias("id")).distinct()
    needed = required.select(F.col("entity_id").alias("id")).distinct()
    findings = [
        _finding(rows.filter("NOT valid").select(F.col("line").alias("id")), file, "not UTF-8"),
        _finding(rows.filter(~tab & (F.trim("value") != "")).select(F.col("line").alias("id")), file, "row without a tab"),
        _finding(listed.groupBy("s1_id").count().filter("count > 1").select(F.col("s1_id").alias("id")), file, "repeated entity"),
        _finding(listed.filter(F.size("ids") != F.size(F.array_distinct("ids"))).select(F.col("s1_id").alias("id")), file, "repeated id in a list"),
        _finding(others.filter(_test(F.col("id"), "^S1-")), file, "source 1 id in a list"),
        _finding(others.filter(~_test(F.col("id"), "^S[123]-")), file, "id without a prefix"),
        _finding(needed.join(seen, "id", "left_anti"), file, "required entity missing"),
        _finding(seen.join(needed, "id", "left_anti"), file, "entity not required"),
    ]
    if targets is not None:
        known = targets.select(F.col("entity_id").alias("id"))
        findings.append(_finding(others.filter(_test(F.col("id"), "^S[23]-")).join(known, "id", "left_anti"), file, "unknown id"))
    out = findings[0]
    for f in findings[1:]:
        out = out.union(f)
    return out, named


def validate(spark: SparkSession, matching: str, candidates: str | None, required: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """file, rule, severity, n, examples of both result files; a rule without offenders has n 0."""
    findings, matched = check_lists(spark, matching, ("source1_entity_id", "matched_entity_ids"), required, targets)
    if targets is None:
        findings = findings.union(_fatal(spark, "matched_entity_ids", "ids not checked against the files", "warning"))
    if candidates is None:
        return findings
    if not exists(spark, candidates):
        return findings.union(_fatal(spark, "candidate_entity_ids", "file missing", "warning"))
    more, named = check_lists(spark, candidates, ("source1_entity_id", "candidate_entity_ids"), required, targets)
    findings = findings.union(more)
    if matched is not None and named is not None:
        pairs = lambda df: df.filter("other_id IS NOT NULL").select("s1_id", "other_id")
        stray = pairs(matched).join(pairs(named), ["s1_id", "other_id"], "left_anti")
        findings = findings.union(_finding(stray.select(F.col("s1_id").alias("id")), "matched_entity_ids", "match that is no candidate", "warning"))
    return findings


def passed(findings: DataFrame) -> bool:
    """Whether no error has offenders (the file may be handed in)."""
    return not findings.filter("severity = 'error' AND n > 0").limit(1).count()
