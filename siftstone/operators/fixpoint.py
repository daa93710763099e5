"""Least fixpoints by semi-naive iteration."""

from __future__ import annotations

import functools
import itertools
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share, from spark.checkpoint.dir. Where none is named, a master on one machine (as in tests) uses its warehouse; a cluster is told to name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"


def stored(df: DataFrame) -> DataFrame:
    """df from a table in the shared folder, so that a round's lineage ends there."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    path = f"{folder.rstrip('/')}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fixpoint(seed: DataFrame, step: Callable[[DataFrame], DataFrame], rounds: int | None = None) -> tuple[DataFrame, bool]:
    """(all facts, whether they are complete): step derives facts from the last round's new ones only; the loop ends when nothing new comes (facts are finitely many), or after `rounds`, and says whether it was the first.

    Each round writes its new facts only; all facts are the tables of the rounds together.
    """
    known = delta = stored(seed.distinct())
    for _ in itertools.count() if rounds is None else range(rounds):
        delta = stored(step(delta).select(*known.columns).distinct().join(known, known.columns, "left_anti"))
        if delta.isEmpty():
            return known, True
        known = known.unionByName(delta)
    return known, False


def witnessed(seed: DataFrame, step: Callable[[DataFrame], DataFrame], keys: list[str]) -> DataFrame:
    """All facts, each with one witness: columns of seed and step that are not keys say how a fact came about. A fact keeps the witness of the round that found it first, and of that round's the least, so following witnesses back ends, and is the same at every run."""
    rest = [c for c in seed.columns if c not in keys]

    def least(df: DataFrame) -> DataFrame:
        return df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_w")).select(*keys, *[F.col("_w")[c].alias(c) for c in rest])

    known = delta = stored(least(seed))
    while True:
        delta = stored(least(step(delta).select(*keys, *rest)).join(known.select(*keys), keys, "left_anti"))
        if delta.isEmpty():
            return known
        known = known.unionByName(delta)


def traced(wanted: DataFrame, facts: DataFrame, keys: list[str], before: list[str], label: Column, steps: int) -> DataFrame:
    """wanted with `trace`: labels of the facts that led to its fact (keys), nearest first, `steps` at most. before: columns of facts that name the fact before; null at a beginning.

    Each step is one join of the facts that are still followed; nothing is followed beyond `steps`.
    """
    held = facts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[F.col(b).alias(f"_b{i}") for i, b in enumerate(before)], label.alias("_label"))
    n = range(len(keys))
    now = wanted.withColumns({f"_n{i}": F.col(k) for i, k in enumerate(keys)} | {"trace": F.array().cast("array<string>")})
    for k in range(steps):
        on = [F.col(f"_n{i}") == F.col(f"_k{i}") for i in n]
        now = now.join(held, on, "left")
        grown = F.when(F.col("_label").isNotNull(), F.concat("trace", F.array("_label"))).otherwise(F.col("trace"))
        now = now.withColumns({"trace": grown} | {f"_n{i}": F.col(f"_b{i}") for i in n}).drop("_label", *[f"_k{i}" for i in n], *[f"_b{i}" for i in n])
        if k % 2:  # two joins a table: the plan stays small
            now = stored(now)
    return now.drop(*[f"_n{i}" for i in n])


#: Edges of a group that one call closes, at most.
FEW = 512


def closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """nodes with the pairs (a, b) of places joined by a path, from the edges (a, b) between places of nodes. Sets of places are bits of a number.

    The place after the last is the null node, which no path goes on from.
    """
    for part in batches:
        pairs = []
        for ends, null in zip(part.column("edges").to_pylist(), part.column("nodes").value_lengths().to_pylist()):
            next_, reached = {}, {}
            for e in ends:
                next_[e["a"]] = next_.get(e["a"], 0) | 1 << e["b"]
            for a, first in next_.items():
                seen, new = first, first
                while new:
                    b = new.bit_length() - 1
                    # A place that is done brings all it reaches.
                    more = reached.get(b, next_.get(b, 0)) if b != null else 0
                    new = (new ^ 1 << b) | (more & ~seen)
                    seen |= more
                reached[a] = seen
            pairs.append([(a, b) for a, seen in reached.items() for b in range(seen.bit_length()) if seen >> b & 1])
        flat = list(itertools.chain.from_iterable(pairs))
        both = pa.StructArray.from_arrays([pa.array([a for a, _ in flat], pa.int32()), pa.array([b for _, b in flat], pa.int32())], ["a", "b"])
        at = pa.array(itertools.accumulate(map(len, pairs), initial=0), pa.int32())
        yield pa.record_batch([part.column("nodes"), pa.ListArray.from_arrays(at, both)], ["nodes", "pairs"])


def closed_groups(edges: DataFrame, within: list[str], source: str, target: str) -> DataFrame:
    """All pairs (source, target) joined by a path, of groups with few edges: each group is one row, and many rows are one call."""
    one = edges.groupBy(*within).agg(F.collect_list(F.struct(F.col(source).alias("a"), F.col(target).alias("b"))).alias("_e"))
    one = one.select("_e", F.array_distinct(F.concat(F.col("_e.a"), F.col("_e.b"))).alias("nodes"))
    place = lambda v: F.coalesce(F.array_position("nodes", v).cast("int") - 1, F.size("nodes"))
    one = one.select("nodes", F.transform("_e", lambda e: F.struct(place(e["a"]).alias("a"), place(e["b"]).alias("b"))).alias("edges"))
    schema = f"nodes {one.schema['nodes'].dataType.simpleString()}, pairs array<struct<a:int,b:int>>"
    done = one.mapInArrow(closed, schema).select("nodes", F.explode("pairs").alias("p"))
    return done.select(F.get("nodes", F.col("p.a")).alias(source), F.get("nodes", F.col("p.b")).alias(target))


def reach(edges: DataFrame, source: str, target: str, rounds: int | None = None, within: list[str] | None = None) -> DataFrame:
    """All pairs (source, target) joined by a path; cycles are fine. If rounds are given and do not suffice, it raises.

    within: columns of edges that name groups which no path leaves, equal in all edges of a path. Groups of up to FEW edges are
    then closed each in one step, without rounds; only the others are joined.
    """
    if within:
        own = [F.col(c).alias(f"_g{i}") for i, c in enumerate(within)]
        groups = [f"_g{i}" for i in range(len(within))]
        edges = stored(edges.select(*own, F.col(source).alias(source), F.col(target).alias(target)))
        large = stored(edges.groupBy(*groups).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > FEW).select(*groups))
        if large.isEmpty():
            return closed_groups(edges, groups, source, target)
        in_large = functools.reduce(lambda a, b: a & b, [edges[c].eqNullSafe(large[c]) for c in groups])
        few = closed_groups(edges.join(large, in_large, "left_anti"), groups, source, target)
        return few.unionByName(reach(edges.join(large, in_large, "left_semi"), source, target, rounds))
    edges = edges.select(source, target).distinct()
    onward = edges.select(edges[source].alias("_via"), edges[target].alias("_next"))

    def step(delta: DataFrame) -> DataFrame:
        return delta.join(onward, delta[target] == onward["_via"]).select(delta[source], onward["_next"].alias(target))

    pairs, complete = fixpoint(edges, step, rounds)
    if not complete:
        raise RuntimeError(f"paths of more than {rounds + 1} edges")
    return pairs
