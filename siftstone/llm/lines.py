"""Line dedup by site-relative frequency, with DataFrame functions only.

A line is boilerplate on a host if the share of the host's pages that hold it exceeds `ratio`, and by more than chance makes
of it: n of N pages, n > ratio * N + DEVIATIONS * sqrt(ratio * (1 - ratio) * N), n at least 2. That is one rule for
hosts of every size: on seven pages three must hold the line, on a thousand seventy-one. Pages are distinct texts: copies of one
page are one page, so an article that is there many times keeps its lines in every copy.
Each page's distinct line hashes are taken once a text, then counted by (host, line); sums are made before the shuffles, so
a host with a third of all pages, or a page with a third of all copies, sends a row per task and line. A host has at most
(mean distinct lines a page) / ratio boilerplate lines, which bounds the list that goes with it. The lists are joined to the
pages by broadcast if their measured size is within `broadcast_bytes`; beyond it both sides are salted.

Defined results: a null text stays null with no lines, and counts as an empty page; blank lines (of white space only) are never boilerplate; a null host
is a host of its own; a line is counted once a page however often it is repeated there, and all its copies go; texts are read
whole, of any length; other columns pass through, whatever their names, but for those of the names in `counts`, which are
replaced; an empty table gives an empty result. Near copies are pages of their own: lines that many of them share can go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tables, cut

RATIO = 0.05
#: Standard deviations of chance by which a line's pages must exceed the ratio.
DEVIATIONS = 3.0
#: White space of which a blank line consists.
BLANKS = " \t\x0b\x0c\r"
BROADCAST_BYTES = 4 << 20
SALTS = 64


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def blank(line: Column) -> Column:
    return F.length(F.trim(line, F.lit(BLANKS))) == 0


def boilerplate(pages: DataFrame, host: str, text: str, tables: Tables, ratio: float = RATIO) -> DataFrame:
    """(host, lines): hashes of each host's boilerplate lines."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(split_lines(whole), lambda x: ~blank(x))
    hashes = F.transform(F.array_distinct(lines), lambda x: F.xxhash64(x))
    base = pages.select(F.col(host).alias("_host"), F.xxhash64(whole).alias("_a"), F.xxhash64(whole, F.lit(1)).alias("_b"), hashes.alias("_lines"))
    base = base.groupBy("_host", "_a", "_b").agg(F.any_value("_lines").alias("_lines"))
    # One pass: the page itself is counted under a null line.
    counted = base.select("_host", F.explode(F.concat(F.array(F.lit(None).cast("bigint")), "_lines")).alias("_line")).groupBy("_host", "_line").agg(F.count(F.lit(1)).alias("_n"))
    counted = tables.cut(counted.filter("_n >= 2 OR _line IS NULL"))
    totals = counted.filter("_line IS NULL").select(F.col("_host").alias("_h"), F.col("_n").alias("_pages"))
    most = F.lit(ratio) * F.col("_pages") + F.lit(DEVIATIONS) * F.sqrt(F.lit(ratio) * F.lit(1 - ratio) * F.col("_pages"))
    common = counted.filter("_line IS NOT NULL").join(totals, F.col("_host").eqNullSafe(F.col("_h"))).filter(F.col("_n") > most)
    return common.groupBy("_host").agg(F.collect_list("_line").alias("_bad"))


def without_boilerplate(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, broadcast_bytes: int = BROADCAST_BYTES, counts: tuple[str, ...] = ("n_lines", "n_dropped")) -> DataFrame:
    """pages with `text` rid of boilerplate lines, and columns of counts (which replace such columns of pages; without names there are none)."""
    columns = [c for c in pages.columns if c.lower() not in {n.lower() for n in counts}]
    tables = Tables(pages.sparkSession)
    bad = cut(boilerplate(pages, host, text, tables, ratio))
    tables.drop()
    size = bad.agg(F.sum(8 * F.size("_bad") + 64 + F.coalesce(F.octet_length("_host"), F.lit(0)))).first()[0] or 0
    # The other columns ride in one struct, so that no name of theirs can clash.
    page = pages.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), F.col(text).alias("_text"), F.col(host).alias("_key"))
    if size <= broadcast_bytes:
        joined = page.join(F.broadcast(bad), F.col("_key").eqNullSafe(F.col("_host")), "left")
    else:
        page = page.withColumn("_salt", F.pmod(F.xxhash64("_text"), F.lit(SALTS)))
        bad = bad.withColumn("_s", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
        joined = page.join(bad, F.col("_key").eqNullSafe(F.col("_host")) & (F.col("_salt") == F.col("_s")), "left")
    lines = split_lines(F.col("_text"))
    left = F.when(F.col("_bad").isNull(), lines).otherwise(F.filter(lines, lambda x: blank(x) | ~F.array_contains("_bad", F.xxhash64(x))))
    joined = joined.withColumn("_left", left)
    clean = F.when(F.size("_left") == F.size(lines), F.col("_text")).otherwise(F.array_join("_left", "\n"))
    return joined.select(
        *[clean.alias(c) if c == text else F.col("_row")[c].alias(c) for c in columns],
        *[F.coalesce(n, F.lit(0)).cast("bigint").alias(c) for c, n in zip(counts, (F.size(lines), F.size(lines) - F.size("_left")))],
    )
