"""Weakness ids, vulnerability classes and severities as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# CWE ids, exact tool rules and own rule prefixes that name a class.
CWE_CLASS = {
    "CWE-89": "sqli", "CWE-564": "sqli", "CWE-77": "cmdi", "CWE-78": "cmdi", "CWE-88": "cmdi", "CWE-94": "codei", "CWE-95": "codei",
    "CWE-327": "weak_crypto", "CWE-328": "weak_crypto", "CWE-916": "weak_crypto", "CWE-259": "secret", "CWE-321": "secret", "CWE-798": "secret",
}
RULE_CLASS = {
    "bandit:B608": "sqli", "bandit:B602": "cmdi", "bandit:B604": "cmdi", "bandit:B605": "cmdi", "bandit:B609": "cmdi", "bandit:B102": "codei",
    "bandit:B307": "codei", "bandit:B303": "weak_crypto", "bandit:B324": "weak_crypto", "bandit:B105": "secret", "bandit:B106": "secret", "bandit:B107": "secret",
    "semgrep:python.flask.security.injection.tainted-sql-string.tainted-sql-string": "sqli",
}
PREFIX_CLASS = {"HS-SQLI-": "sqli", "HS-CMDI-": "cmdi", "HS-CODEI-": "codei", "HS-CRYPTO-": "weak_crypto"}
KNOWN_CLASSES = ("sqli", "cmdi", "codei", "weak_crypto", "secret")
SEVERITIES = ("low", "medium", "high", "critical")
STATUSES = ("suppressed", "candidate", "confirmed")


def rank(value: Column, order: tuple[str, ...]) -> Column:
    """Position of value in order; null for anything else."""
    return F.when(value.isin(*order), F.array_position(F.array(*map(F.lit, order)), value) - 1).cast("int")


def lookup(table: dict[str, str], key: Column) -> Column:
    """table[key], null where it is missing."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def cwe_number(raw: Column) -> Column:
    return F.nullif(F.regexp_extract(raw, "(?i)CWE[-_ ]?([0-9]+)", 1), F.lit("")).cast("bigint")


def normalize_cwe(raw: Column) -> Column:
    """'cwe-089: text' gives 'CWE-89'; null without a number."""
    n = cwe_number(raw)
    return F.when(n.isNotNull(), F.concat(F.lit("CWE-"), n.cast("string")))


def normalize_cwes(raws: Column) -> Column:
    """Distinct ids of an array, in numeric order."""
    numbers = F.array_sort(F.array_distinct(F.filter(F.transform(raws, cwe_number), lambda n: n.isNotNull())))
    return F.transform(numbers, lambda n: F.concat(F.lit("CWE-"), n.cast("string")))


def classify(rule: Column, cwes: Column) -> Column:
    """Class of a finding: own prefix, exact rule, secret scanner, first mapped CWE in numeric order, lowest CWE, rule."""
    ids = normalize_cwes(cwes)
    own = reduce(lambda rest, kv: F.when(F.startswith(rule, F.lit(kv[0])), F.lit(kv[1])).otherwise(rest), reversed(list(PREFIX_CLASS.items())), F.lit(None).cast("string"))
    mapped = F.filter(F.transform(ids, lambda c: lookup(CWE_CLASS, c)), lambda c: c.isNotNull())
    return F.coalesce(
        own,
        lookup(RULE_CLASS, rule),
        F.when(F.startswith(rule, F.lit("gitleaks:")), F.lit("secret")),
        F.try_element_at(mapped, F.lit(1)),
        F.concat(F.lit("other:"), F.try_element_at(ids, F.lit(1))),
        F.concat(F.lit("other:"), rule),
    )


def mergeable(vuln_class: Column, cwes: Column) -> Column:
    return vuln_class.isin(*KNOWN_CLASSES) | (F.size(normalize_cwes(cwes)) > 0)


def severity_from_score(score: Column) -> Column:
    return F.when(score >= 9, "critical").when(score >= 7, "high").when(score >= 4, "medium").otherwise("low")


def confirmation_basis(status: Column, evidence: Column) -> Column:
    """How a verdict stands: a modelled flow if confirmed, an assumed one if a candidate's evidence says so."""
    assumed = F.exists(evidence, lambda e: (e["kind"] == "taint_verdict") & F.contains(e["message"], F.lit("assum")))
    return F.when(status == "confirmed", "modelled-flow").when((status == "candidate") & assumed, "assumed-flow")
