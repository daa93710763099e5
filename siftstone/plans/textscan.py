"""Text rules over tables of texts: matches, report-wide secrets, findings with ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.functions import taxonomy, text
from siftstone.operators import dictionary, identity

#: Rules of the text scan: id, pattern (in the syntax that Java and RE2 share), CWE, severity, confidence.
TEXT_RULES = [
    ("text:email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "CWE-359: personal data", "medium", 60),
    ("text:ipv4", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "cwe_200", "low", 40),
    ("text:phone", r"\+[0-9][0-9 ()-]{7,}[0-9]", "CWE-359", "medium", 50),
    ("text:number", r"[0-9]{13,19}", "CWE-0359", "medium", 40),
    ("gitleaks:token", r"[A-Za-z_]+ *= *\"[^\"]+\"", "CWE-798", "high", 70),
]
#: The rule whose matches hold a secret, between quotes.
SECRET_RULE = "gitleaks:token"


def _hits(column: str, rule: str, pattern: str, cwe: str, severity: str, confidence: int) -> Column:
    def one(match, i):
        return F.struct(F.lit(rule).alias("rule"), F.lit(cwe).alias("cwe"), F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence"), match.alias("match"), i.alias("n"))

    return F.transform(F.regexp_extract_all(column, F.lit(f"({pattern})"), 1), one)


def matches(rows: DataFrame, keep: list[str], column: str = "text", rules: list[tuple] = TEXT_RULES) -> DataFrame:
    """(keep..., rule, cwe, severity, confidence, match, n): every match of every rule in one pass; n counts a rule's matches in a text."""
    rows = rows.select(*keep, F.coalesce(F.col(column), F.lit("")).alias("_text"))
    return rows.select(*keep, F.explode(F.flatten(F.array(*[_hits("_text", *rule) for rule in rules]))).alias("h")).select(*keep, "h.*")


def findings(found: DataFrame, path: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep..., id, path, rule, vuln_class, severity, confidence, sink, occurrence) of matches: classified, redacted, numbered and named."""
    found = found.select(
        *keep, path.alias("path"), "rule", taxonomy.classify(F.col("rule"), F.array("cwe")).alias("vuln_class"),
        "severity", "confidence", F.when(F.col("rule") == SECRET_RULE, text.redact_literals(F.col("match"))).otherwise(F.col("match")).alias("sink"), "n",
    )
    named = identity.with_ids(found, F.col("vuln_class"), F.col("path"), F.lit(None).cast("string"), F.col("sink"), [F.col("rule"), F.col("n")])
    return named.select(*keep, "id", "path", "rule", "vuln_class", "severity", "confidence", "sink", "occurrence")


def secrets(rows: DataFrame, column: str = "text") -> DataFrame:
    """(value): the report-wide secrets that the texts give to names."""
    rule = [r for r in TEXT_RULES if r[0] == SECRET_RULE]
    inner = F.regexp_extract("match", "\"([^\"]+)\"", 1)
    return dictionary.collected(matches(rows, [], column, rule), inner)
