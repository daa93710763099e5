"""Findings as SARIF 2.1.0, as JSON, as text lines; and the guard that keeps exports from overwriting other files."""

from __future__ import annotations

import json
import os
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.functions import taxonomy
from siftstone.operators import reporting

# Levels and scores of severities.
LEVEL = {"critical": "error", "high": "error", "medium": "warning", "low": "note"}
SCORE = {"critical": "9.5", "high": "8.0", "medium": "5.5", "low": "3.0"}
ORDER = ("path", "start_line", "start_column", "rule_id", "id")


def uri(path: Column) -> Column:
    """Percent-encoded, slashes kept."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else quote(x, safe="/-_.~"))

    return run(path)


def sarif_results(found: DataFrame, with_suppressed: bool = True) -> DataFrame:
    """(result): one JSON text a finding, with the index of its rule; suppressed ones carry their reason."""
    f = found if with_suppressed else found.filter("status <> 'suppressed'")
    index = reporting.rule_index(f.select("rule_id"), "rule_id")
    region = F.struct(F.col("start_line").alias("startLine"), F.col("start_column").alias("startColumn"), F.col("end_line").alias("endLine"), F.col("end_column").alias("endColumn"))
    place = F.struct(F.struct(uri(F.col("path")).alias("uri"), F.lit("SRCROOT").alias("uriBaseId")).alias("artifactLocation"), region.alias("region"))
    kind = F.when(F.startswith("suppression", F.lit("inline:")), "inSource").otherwise("external")
    body = F.struct(
        F.col("rule_id").alias("ruleId"), F.col("rule_index").alias("ruleIndex"), taxonomy.lookup(LEVEL, F.col("severity")).alias("level"),
        F.struct(F.concat_ws(" ", "message", F.nullif("note", F.lit(""))).alias("text")).alias("message"), F.array(F.struct(place.alias("physicalLocation"))).alias("locations"),
        F.struct(F.col("id").alias("findingId/v1")).alias("partialFingerprints"), F.struct("confidence", "status", "vuln_class", "sources", "cwe").alias("properties"),
        F.when(F.col("status") == "suppressed", F.array(F.struct(kind.alias("kind"), F.col("suppression").alias("justification")))).alias("suppressions"),
    )
    return f.join(F.broadcast(index), "rule_id").select(*ORDER, F.to_json(body).alias("result"))


def sarif_rules(found: DataFrame) -> DataFrame:
    """(rule_id, rule): descriptors in the order of their index, each after its first finding."""
    first = reporting.sample_of_rule(found, "rule_id", F.struct(*[c for c in ORDER if c != "rule_id"]), ["severity", "message", "cwe"])
    body = F.struct(F.col("rule_id").alias("id"), F.struct(F.substring("message", 1, 200).alias("text")).alias("shortDescription"), F.struct(taxonomy.lookup(LEVEL, F.col("severity")).alias("level")).alias("defaultConfiguration"), F.struct(taxonomy.lookup(SCORE, F.col("severity")).alias("security-severity"), F.col("cwe").alias("tags")).alias("properties"))
    return first.select("rule_id", F.to_json(body).alias("rule"))


def export_sarif(found: DataFrame, errors: DataFrame, path: str, with_suppressed: bool = True, version: str = "0") -> None:
    """One SARIF file. Results stream to the driver partition by partition; the file format is one document."""
    guard(path, b'"$schema"')
    f = found if with_suppressed else found.filter("status <> 'suppressed'")
    notes = [{"level": "error", "message": {"text": f"{r.path}: {r.message}"}} for r in errors.select("path", "message").orderBy("path", "message").toLocalIterator()]
    head = {"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0"}
    driver = {"name": "siftstone", "version": version, "rules": [json.loads(r.rule) for r in sarif_rules(f).orderBy("rule_id").toLocalIterator()]}
    with open(path, "w", encoding="utf-8") as out:
        out.write(json.dumps(head)[:-1] + ', "runs": [{"tool": ' + json.dumps({"driver": driver}) + ', "invocations": ' + json.dumps([{"executionSuccessful": not notes, "toolExecutionNotifications": notes}]) + ', "results": [')
        for i, r in enumerate(sarif_results(f).orderBy(*ORDER).toLocalIterator()):
            out.write((",\n" if i else "\n") + r.result)
        out.write("\n]}]}\n")


def export_json(found: DataFrame, errors: DataFrame, path: str, root: str = ".") -> None:
    guard(path, b'"tool": "siftstone"')
    stats = reporting.counts(found, "status", taxonomy.STATUSES).first().asDict()
    with open(path, "w", encoding="utf-8") as out:
        out.write(json.dumps({"tool": "siftstone", "root": root, "stats": {"by_status": stats}, "errors": [r.asDict() for r in errors.orderBy("path", "message").toLocalIterator()]})[:-1] + ', "findings": [')
        for i, r in enumerate(found.orderBy(*ORDER).select(F.to_json(F.struct(*sorted(found.columns)), {"ignoreNullFields": "false"}).alias("x")).toLocalIterator()):
            out.write((",\n" if i else "\n") + r.x)
        out.write("\n]}\n")


def text_lines(found: DataFrame) -> DataFrame:
    """(line) in display order: severity, confirmed first, confidence, place."""
    rank = taxonomy.rank(F.col("severity"), taxonomy.SEVERITIES)
    shown = F.format_string("%s %s %s:%d:%d %s [%s, %d] %s", F.upper("severity"), F.col("rule_id"), F.col("path"), F.col("start_line"), F.col("start_column"), F.col("message"), F.col("status"), F.col("confidence"), F.coalesce("note", F.lit("")))
    return found.orderBy(F.desc(rank), F.desc((F.col("status") == "confirmed").cast("int")), F.desc("confidence"), "path", "start_line", "start_column", "id").select(F.rtrim(shown).alias("line"))


def guard(path: str, mark: bytes) -> None:
    """Refuses sources, folders, and files that are no earlier export."""
    if path.endswith((".py", ".pyw", ".pyi")) or os.path.isdir(path):
        raise ValueError(f"{path}: not a place for a report")
    if os.path.exists(path) and os.path.getsize(path):
        with open(path, "rb") as f:
            if mark not in f.read(4096):
                raise ValueError(f"{path}: exists and is no earlier report")
