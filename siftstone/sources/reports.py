"""Reports of other scanners as rows: SARIF 2.1.0 and the JSON of a secret scanner."""

from __future__ import annotations

import posixpath
import re
from urllib.parse import unquote, urlsplit

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.functions import taxonomy
from siftstone.operators.regions import normalize_region

# Driver names, default confidences, levels.
DRIVERS = {"semgrep": "semgrep", "semgrep oss": "semgrep", "semgrep pro": "semgrep", "bandit": "bandit", "codeql": "codeql"}
CONFIDENCE = {"semgrep": "60", "bandit": "60", "codeql": "75"}
LEVELS = {"error": "high", "warning": "medium", "note": "low", "none": "low"}


def local_path(uri: str | None, base: str | None, root: str) -> str | None:
    """POSIX path relative to root; null outside it, for other hosts and for other schemes."""
    if not uri:
        return None
    if base and not re.match(r"^[a-zA-Z][a-zA-Z0-9+.-]+:|^/", uri):
        uri = base.rstrip("/") + "/" + uri
    parts = urlsplit(uri.replace("\\", "/"))
    if parts.scheme == "file":
        if parts.netloc not in ("", "localhost"):
            return None
        path = unquote(parts.path)
    elif len(parts.scheme) > 1:
        return None
    else:
        path = unquote(uri.replace("\\", "/"))
    whole = posixpath.normpath(posixpath.join(root, path))
    inside = posixpath.relpath(whole, root)
    return None if inside == ".." or inside.startswith("../") else inside


def path_column(uri: Column, base: Column, root: str) -> Column:
    @F.pandas_udf("string")
    def run(u: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([local_path(x, y, root) for x, y in zip(u, b)], dtype=object)

    return run(uri, base)


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^﻿", "").alias("value"))


def sarif(reports: DataFrame, root: str = "/", label: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(findings, warnings) of a column `value` of SARIF texts. A bad result is a warning; bad run metadata counts as absent; a text without a list of runs gives one warning."""
    get = lambda v, p, t="string": F.try_variant_get(v, p, t)
    logs = reports.select(F.try_parse_json("value").alias("log"))
    runs = logs.select(F.expr("try_variant_get(log, '$.runs', 'array<variant>')").alias("runs"))
    bad_logs = runs.filter("runs IS NULL").select(F.lit("not a SARIF log: no list of runs").alias("message"))
    run = runs.select(F.explode("runs").alias("run"))
    driver = F.lower(F.coalesce(get("run", "$.tool.driver.name"), F.lit("")))
    run = run.select(
        F.coalesce(F.lit(label), taxonomy.lookup(DRIVERS, driver), F.lit("sarif")).alias("source"),
        F.expr("try_variant_get(run, '$.tool.driver.rules', 'array<variant>')").alias("rules"),
        F.expr("try_variant_get(run, '$.originalUriBaseIds', 'map<string, variant>')").alias("bases"),
        F.expr("try_variant_get(run, '$.results', 'array<variant>')").alias("results"), "run",
    )
    bad_runs = run.filter("results IS NULL AND try_variant_get(run, '$.results', 'variant') IS NOT NULL").select(F.concat(F.col("source"), F.lit(": results is not a list")).alias("message"))
    r = run.select("source", "rules", "bases", F.posexplode("results").alias("index", "r"))
    r = r.withColumn("rule", F.try_element_at(F.filter("rules", lambda x: get(x, "$.id") == get(F.col("r"), "$.ruleId")), F.lit(1)))
    at = "$.locations[0].physicalLocation"
    base = get(F.try_element_at("bases", get("r", f"{at}.artifactLocation.uriBaseId")), "$.uri")
    number = lambda f: get("r", f"{at}.region.{f}", "int")
    strings = lambda v, p: F.coalesce(F.expr(f"try_variant_get({v}, '{p}', 'array<string>')"), F.array().cast("array<string>"))
    score = F.coalesce(F.expr("try_variant_get(r, '$.properties[\"security-severity\"]', 'double')"), F.expr("try_variant_get(rule, '$.properties[\"security-severity\"]', 'double')"))
    level = F.coalesce(get("r", "$.level"), get("rule", "$.defaultConfiguration.level"), F.lit("warning"))
    issue = F.upper(get("r", "$.properties.issue_severity"))
    sure = F.upper(get("r", "$.properties.issue_confidence"))
    rule_id = F.concat("source", F.lit(":"), get("r", "$.ruleId"))
    cwes = F.concat(strings("rule", "$.properties.tags"), strings("r", "$.properties.tags"), strings("rule", "$.properties.cwe"), strings("r", "$.properties.cwe"))
    rows = r.select(
        "source", "index", rule_id.alias("rule_id"), path_column(get("r", f"{at}.artifactLocation.uri"), base, root).alias("path"),
        F.coalesce(get("r", "$.message.text"), get("rule", "$.shortDescription.text"), get("r", "$.ruleId")).alias("message"),
        taxonomy.normalize_cwes(cwes).alias("cwe"), taxonomy.classify(rule_id, cwes).alias("vuln_class"),
        F.coalesce(F.when(issue.isin("HIGH", "MEDIUM", "LOW"), F.lower(issue)), F.when(score.isNotNull(), taxonomy.severity_from_score(score)), taxonomy.lookup(LEVELS, level), F.lit("medium")).alias("severity"),
        F.when(sure == "HIGH", 80).when(sure == "MEDIUM", 60).when(sure == "LOW", 40).otherwise(F.coalesce(taxonomy.lookup(CONFIDENCE, F.col("source")), F.lit("50")).cast("int")).alias("confidence"),
        normalize_region(number("startLine"), number("startColumn"), number("endLine"), number("endColumn")).alias("region"),
    )
    good = F.col("rule_id").isNotNull() & F.col("path").isNotNull()
    bad = rows.filter(~good).select(F.concat(F.col("source"), F.lit(": result "), F.col("index").cast("string"), F.lit(" has no rule or no place inside the root")).alias("message"))
    return rows.filter(good).drop("index"), bad_logs.unionByName(bad_runs).unionByName(bad)


LEAK = "array<struct<Description:string,StartLine:int,EndLine:int,StartColumn:int,EndColumn:int,Match:string,Secret:string,File:string,RuleID:string>>"


def leaks(reports: DataFrame, root: str = "/") -> tuple[DataFrame, DataFrame]:
    """(findings, warnings) of a secret scanner's JSON lists in column `value`; an empty text is an empty list. Secrets are taken out of all texts; end columns are inclusive there."""
    items = reports.select(F.posexplode(F.coalesce(F.from_json(F.when(F.trim("value") == "", "[]").otherwise(F.col("value")), LEAK), F.array().cast(LEAK))).alias("index", "x"))
    clean = lambda c: F.when(F.length("x.Secret") > 0, F.replace(c, F.col("x.Secret"), F.lit("<REDACTED>"))).otherwise(c)
    rule = F.concat(F.lit("gitleaks:"), F.coalesce("x.RuleID", F.lit("unknown")))
    rows = items.select(
        "index", F.lit("gitleaks").alias("source"), rule.alias("rule_id"), path_column(F.col("x.File"), F.lit(None).cast("string"), root).alias("path"), clean(F.coalesce("x.Description", "x.RuleID")).alias("message"),
        F.array(F.lit("CWE-798")).alias("cwe"), F.lit("secret").alias("vuln_class"), F.lit("high").alias("severity"), F.lit(70).alias("confidence"),
        normalize_region(F.col("x.StartLine"), F.col("x.StartColumn"), F.col("x.EndLine"), F.col("x.EndColumn") + 1).alias("region"),
    )
    bad = rows.filter("path IS NULL").select(F.concat(F.lit("gitleaks: item "), F.col("index").cast("string"), F.lit(" has no file inside the root")).alias("message"))
    return rows.filter("path IS NOT NULL").withColumn("sink", F.concat("rule_id", F.lit("@"), "path", F.lit("@L"), F.col("region.start_line").cast("string"))).drop("index"), bad


def leaked(reports: DataFrame) -> DataFrame:
    """(value): the secrets themselves, to be kept out of every other text."""
    items = reports.select(F.explode(F.coalesce(F.from_json(F.when(F.trim("value") == "", "[]").otherwise(F.col("value")), LEAK), F.array().cast(LEAK))).alias("x"))
    return items.select(F.col("x.Secret").alias("value")).filter("value <> ''").distinct()


def collected(spark: SparkSession, imports: list[tuple[str, str]], root: str = "/") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(findings, messages, secrets) of reports (format, path): all findings as one table, what could not be read or was left out (report, error, message), and the secrets (value) that other texts must not show.

    Formats: sarif, gitleaks, or a tool's name, which is then the source of its SARIF. A report that cannot be read is an error row; the others are taken in all the same.
    """
    found = spark.createDataFrame([], "source string, rule_id string, path string, message string, cwe array<string>, vuln_class string, severity string, confidence int, region struct<start_line:int,start_column:int,end_line:int,end_column:int>, sink string")
    said = spark.createDataFrame([], "report string, error boolean, message string")
    secrets = spark.createDataFrame([], "value string")
    for kind, path in imports:
        report = F.lit(f"{kind}={path}")
        try:
            texts = whole_files(spark, path)
        except AnalysisException as e:
            said = said.unionByName(spark.range(1).select(report.alias("report"), F.lit(True).alias("error"), F.lit(str(e).split("\n")[0]).alias("message")))
            continue
        rows, warnings = leaks(texts, root) if kind == "gitleaks" else sarif(texts, root, None if kind == "sarif" else kind)
        found = found.unionByName(rows, allowMissingColumns=True)
        said = said.unionByName(warnings.select(report.alias("report"), F.startswith("message", F.lit("not a SARIF log")).alias("error"), "message"))
        if kind == "gitleaks":
            secrets = secrets.unionByName(leaked(texts))
    return found, said, secrets.distinct()
