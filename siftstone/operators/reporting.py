"""Filters, orders, counts and scores over findings or any rows of that shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def visible(severity_rank: Column, confidence: Column, suppressed: Column, least_rank: int, least_confidence: int, with_suppressed: bool) -> Column:
    shown = (severity_rank >= least_rank) & (confidence >= least_confidence)
    return shown if with_suppressed else shown & ~suppressed


def failing(severity_rank: Column, confidence: Column, suppressed: Column, least_rank: int, least_confidence: int) -> Column:
    return ~suppressed & (severity_rank >= least_rank) & (confidence >= least_confidence)


def exit_code(n_failing: int, incomplete: bool) -> int:
    """2 for an incomplete scan, else 1 if anything fails it, else 0."""
    return 2 if incomplete else int(n_failing > 0)


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first k rows of a total order: each task keeps k, no full sort."""
    return df.orderBy(*order).limit(k)


def counts(df: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    """One row with a count for every value, zeros included."""
    return df.agg(*[F.count_if(F.col(column) == v).alias(v) for v in values])


def crosstab(df: DataFrame, rows: str, columns: str, values: tuple[str, ...]) -> DataFrame:
    """Counts of rows by columns; the values are given, so no pass looks for them."""
    return df.groupBy(rows).pivot(columns, list(values)).count().na.fill(0)


def rule_index(df: DataFrame, rule: str) -> DataFrame:
    """(rule, rule_index): position among the sorted distinct rules. The distinct rules are few; only they meet in one task."""
    return df.select(rule).distinct().withColumn("rule_index", (F.dense_rank().over(Window.orderBy(rule)) - 1).cast("int"))


def sample_of_rule(df: DataFrame, rule: str, order: Column, columns: list[str]) -> DataFrame:
    """The first row of each rule in a total order, by partial minima."""
    return df.groupBy(rule).agg(*[F.min_by(F.col(c), order).alias(c) for c in columns])


def scores(keys: DataFrame, group: str, predicted: str, actual: str) -> DataFrame:
    """(group or 'all', tp, fp, fn, precision, recall, f1) of one row a key; null where a denominator is 0."""
    p, a = F.col(predicted), F.col(actual)
    out = keys.rollup(group).agg(F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & a).alias("fn"), F.grouping(group).alias("_all"))
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    ratio = lambda x, y: F.round(F.try_divide(x.cast("double"), y), 6)
    return out.select(
        F.when(F.col("_all") == 1, "all").otherwise(F.col(group)).alias(group), "tp", "fp", "fn",
        ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def relative_recall(reports: DataFrame, tool: str, key: str) -> DataFrame:
    """(tool, found, total, recall): distinct keys of each tool over those of all tools."""
    total = reports.agg(F.countDistinct(key).alias("total"))
    found = reports.groupBy(tool).agg(F.countDistinct(key).alias("found"))
    return found.crossJoin(F.broadcast(total)).select(tool, "found", "total", F.round(F.try_divide(F.col("found").cast("double"), F.col("total")), 6).alias("recall"))


def benchmark(labels: DataFrame, reports: DataFrame, keys: list[str], group: str, vulnerable: str) -> DataFrame:
    """(group or 'all', tp, fp, fn, trap_hits) over distinct keys: a report on a key without a vulnerable label is false, and a trap hit if the key has a safe one."""
    truth = labels.groupBy(*keys, group).agg(F.bool_or(vulnerable).alias("_bad"))
    both = truth.join(reports.select(*keys, group).distinct().withColumn("_hit", F.lit(True)), [*keys, group], "full")
    hit, bad, labelled = F.col("_hit").isNotNull(), F.coalesce("_bad", F.lit(False)), F.col("_bad").isNotNull()
    out = both.rollup(group).agg(F.count_if(hit & bad).alias("tp"), F.count_if(hit & ~bad).alias("fp"), F.count_if(~hit & bad).alias("fn"), F.count_if(hit & ~bad & labelled).alias("trap_hits"), F.grouping(group).alias("_all"))
    return out.select(F.when(F.col("_all") == 1, "all").otherwise(F.col(group)).alias(group), "tp", "fp", "fn", "trap_hits")


def markdown(rows: DataFrame, group: str) -> str:
    """A table of benchmark() rows, 'all' first; the groups are few."""
    ratio = lambda a, b: f"{100 * a / b:.0f} %" if b else "-"
    lines = [f"| {group} | TP / FP / FN | trap hits | precision | recall |", "|---|---|---|---|---|"]
    for r in sorted(rows.collect(), key=lambda r: (r[group] != "all", r[group])):
        lines.append(f"| {r[group]} | {r.tp} / {r.fp} / {r.fn} | {r.trap_hits} | {ratio(r.tp, r.tp + r.fp)} | {ratio(r.tp, r.tp + r.fn)} |")
    return "\n".join(lines)
