"""Regions of text as intervals: normalising, overlap joins, innermost lookups, unions, islands, offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def normalize_region(start_line: Column, start_column: Column, end_line: Column, end_column: Column) -> Column:
    """A valid region of any reported numbers: lines and columns from 1, end not before start, no start column means whole lines, a missing end column on the start line a point."""
    sl = F.greatest(F.coalesce(start_line, F.lit(1)), F.lit(1))
    el = F.greatest(F.coalesce(end_line, sl), sl)
    sc = F.when(start_column.isNotNull(), F.greatest(start_column, F.lit(1)))
    ec = F.when(sc.isNull(), F.lit(None)).when(end_column.isNull(), F.when(el == sl, sc)).when(el == sl, F.greatest(end_column, sc)).otherwise(F.greatest(end_column, F.lit(1)))
    return F.struct(sl.cast("int").alias("start_line"), F.coalesce(sc, F.lit(1)).cast("int").alias("start_column"), el.cast("int").alias("end_line"), ec.cast("int").alias("end_column"))


def region_end(region: Column) -> Column:
    """Exclusive end as (line, column): a point counts as one character, an open end as infinity."""
    point = (region["end_line"] == region["start_line"]) & (region["end_column"] <= region["start_column"])
    column = F.when(region["end_column"].isNull(), F.lit(float("inf"))).when(point, region["start_column"] + 1.0).otherwise(region["end_column"].cast("double"))
    return F.struct(region["end_line"].alias("line"), column.alias("column"))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], start: str, end: str, width: int) -> DataFrame:
    """Pairs with equal keys whose half-open intervals [start, end) intersect; columns of left as l_, of right as r_.

    Both sides are dealt to bins of `width`, so that a key with very many intervals is joined bin by bin; a pair that meets
    in several bins is kept in the first. Intervals with a null bound or no extent meet nothing.
    """

    def dealt(df: DataFrame, side: str) -> DataFrame:
        df = df.filter(F.col(start) < F.col(end)).select(*[F.col(c).alias(f"{side}_{c}") for c in df.columns])
        first, last = F.floor(F.col(f"{side}_{start}") / width), F.floor((F.col(f"{side}_{end}") - 1) / width)
        return df.withColumn(f"{side}__first", first).withColumn(f"{side}__bin", F.explode(F.sequence(first, F.greatest(first, last))))

    a, b = dealt(left, "l"), dealt(right, "r")
    on = [F.col(f"l_{k}") == F.col(f"r_{k}") for k in keys] + [F.col("l__bin") == F.col("r__bin")]
    hit = (F.col(f"l_{start}") < F.col(f"r_{end}")) & (F.col(f"r_{start}") < F.col(f"l_{end}"))
    once = F.col("l__bin") == F.greatest("l__first", "r__first")
    found = a.join(b, on).filter(hit & once)
    return found.drop("l__bin", "r__bin", "l__first", "r__first")


def innermost(points: DataFrame, spans: DataFrame, keys: list[str], at: str, start: str, end: str, name: str, default: str | None) -> DataFrame:
    """points with `name` of the span that starts last among those that hold the point (start <= at <= end; of these the one that ends first, then the greatest name), else default.

    Spans lie in levels of width: one of up to 2 ** n places goes to the bins of that width that it touches, two at most; a
    point looks into one bin a level. So the key of the join is (key, level, bin): a key with very many spans is dealt over
    many tasks, nothing holds all spans of a key, and a long span costs no more than a short one.
    """
    held = spans.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(start).cast("bigint").alias("_s"), F.col(end).cast("bigint").alias("_e"), F.col(name).alias("_name")).filter("_s <= _e")
    level = F.ceil(F.log2((F.col("_e") - F.col("_s") + 1).cast("double"))).cast("int")
    held = held.withColumn("_level", level).withColumn("_w", F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("_level")))
    bin_of = lambda place: F.expr(f"({place} - pmod({place}, _w)) div _w")
    held = held.withColumn("_bin", F.explode(F.sequence(bin_of("_s"), bin_of("_e"))))
    levels = sorted(r[0] for r in held.select("_level").distinct().collect())  # as many as a number has bits, at most
    on = [f"_k{i}" for i in range(len(keys))]
    asked = points.select(*[F.col(k).alias(c) for k, c in zip(keys, on)], F.col(at).cast("bigint").alias("_place")).dropna().distinct()
    asked = asked.withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("_w", F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("_level")))
    hit = asked.withColumn("_bin", bin_of("_place")).drop("_w").join(held.drop("_w"), [*on, "_level", "_bin"]).filter("_s <= _place AND _place <= _e")
    best = hit.groupBy(*on, "_place").agg(F.max(F.struct("_s", (-F.col("_e")).alias("_e"), "_name"))["_name"].alias("_best"))
    same = [F.col(k) == F.col(c) for k, c in zip(keys, on)] + [F.col(at).cast("bigint") == F.col("_place")]
    return points.join(best, same, "left").withColumn(name, F.coalesce("_best", F.lit(default))).drop(*on, "_place", "_best")


def union_of(df: DataFrame, keys: list[str], start: Column, end: Column) -> DataFrame:
    """The region from the first start to the last end of each group."""
    return df.groupBy(*keys).agg(F.min(start).alias("start"), F.max(end).alias("end"))


def islands(df: DataFrame, keys: list[str], order: list[str], start: Column, end: Column) -> DataFrame:
    """df with the number of its island: rows whose span begins after all earlier ends begin a new one."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(before.isNull() | (start > before), 1).otherwise(0)
    return df.withColumn("_fresh", fresh).withColumn("island", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_fresh")


def line_offsets(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """(keep..., line, n_chars, offset): where each line starts, counted in characters with its newline. Row by row: no shuffle, whatever the number of lines."""
    lines = df.select(*keep, F.split(text, "\n", -1).alias("_lines"))
    sums = F.aggregate("_lines", F.array(F.lit(0).cast("bigint")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(x) + 1)))
    return lines.withColumn("_sums", sums).select(*keep, F.posexplode(F.arrays_zip(F.col("_lines"), F.slice("_sums", 1, F.size("_lines")))).alias("_i", "_x")).select(
        *keep, (F.col("_i") + 1).alias("line"), F.length(F.col("_x")["_lines"]).alias("n_chars"), F.col("_x")["1"].alias("offset")
    )


def strictly_contains(outer_start: Column, outer_end: Column, start: Column, end: Column) -> Column:
    return (outer_start <= start) & (end <= outer_end) & ~((outer_start == start) & (outer_end == end))
