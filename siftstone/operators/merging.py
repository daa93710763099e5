"""Clustering of reports of one weakness and merging of a cluster into one row."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftstone.functions.arrow import arrow_schema, ddl_of
from siftstone.operators import regions


def anchor_clusters(rows: list[dict], order: Callable, compatible: Callable) -> list[int]:
    """Cluster number of each row: in the given order a row joins the first cluster all of whose members it goes with, else it begins one. Not transitive: a row never bridges two others."""
    numbers, clusters = [0] * len(rows), []
    for i in sorted(range(len(rows)), key=lambda i: order(rows[i])):
        home = next((k for k, members in enumerate(clusters) if all(compatible(rows[m], rows[i]) for m in members)), len(clusters))
        if home == len(clusters):
            clusters.append([])
        clusters[home].append(i)
        numbers[i] = home
    return numbers


class Anchors:
    """The clusters of one island, for its rows in order: rows go together if they overlap and, where they share a source, their content is equal.

    Intervals that overlap pairwise have a place in common, so a cluster is known by its last start, its first end and one
    content a source; a row is held against clusters, of many clusters against many at once, never against rows.
    """

    #: Clusters that are held against a row one by one; more are so on arrays.
    FEW = 32

    def __init__(self) -> None:
        self.last, self.first, self.held = [], [], []

    def home(self, s: int, e: int, source, content) -> int:
        """The number of the row's cluster, which now holds it too."""
        last, first, held = self.last, self.first, self.held
        n = len(held)
        if n == self.FEW:
            self.last, self.first = (np.array(x, np.int64) for x in (last, first))
            last, first = self.last, self.first
        if n < self.FEW:
            home = next((k for k in range(n) if last[k] < e and first[k] > s and held[k].get(source, content) == content), n)
        else:
            home = n
            for b in range(0, n, 4096):
                to = min(b + 4096, n)
                near = np.flatnonzero((last[b:to] < e) & (first[b:to] > s))
                home = next((b + c for c in near.tolist() if held[b + c].get(source, content) == content), n)
                if home < n:
                    break
        if home < n:
            last[home], first[home] = max(last[home], s), min(first[home], e)
            held[home][source] = content
            return home
        held.append({source: content})
        if n < self.FEW:
            last.append(s)
            first.append(e)
        else:
            if n == len(last):  # room for as many again
                self.last, self.first = (np.concatenate([x, np.zeros(n, np.int64)]) for x in (last, first))
            self.last[n], self.first[n] = s, e
        return n


def anchored(starts: np.ndarray, ends: np.ndarray, sources: list, contents: list, order: list[int]) -> np.ndarray:
    """Cluster number of each interval of one island, taken in the given order."""
    numbers, island = np.zeros(len(order), np.int64), Anchors()
    for i in order:
        numbers[i] = island.home(starts[i], ends[i], sources[i], contents[i])
    return numbers


def cluster(df: DataFrame, keys: list[str], order: list[str], start: str, end: str, source: str, content: str) -> DataFrame:
    """df with `cluster`, a number within keys. Rows go together if their intervals [start, end) overlap and, where they share a source, their content is equal.

    Keys are cut into islands first, where no interval goes on: rows of different islands never go together. So islands are
    dealt over the tasks, whatever a key holds, and a task reads their rows in order, many islands a batch: it keeps the
    clusters of one island, and no rows.
    """
    island = regions.islands(df.withColumn("_end", F.col(end) - 1), keys, [start, end, *order], F.col(start), F.col("_end")).drop("_end")
    names, schema = df.columns, ddl_of(df.schema, "cluster bigint")
    arrow = arrow_schema(schema)
    dealt = island.repartition(*keys, "island")
    begins = F.row_number().over(Window.partitionBy(*keys, "island").orderBy(*order)) == 1
    dealt = dealt.withColumn("_begins", begins).sortWithinPartitions(*keys, "island", *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = Anchors()
        for part in batches:
            numbers = []
            for begins, *row in zip(*(part.column(c).to_pylist() for c in ("_begins", start, end, source, content))):
                if begins:
                    now = Anchors()
                numbers.append(now.home(*row))
            number = (part.column("island").to_numpy().astype(np.int64) << 32) | np.array(numbers, np.int64)
            table = pa.Table.from_batches([part]).select(names).append_column("cluster", pa.array(number)).cast(arrow)
            yield from table.to_batches()

    return dealt.mapInArrow(run, schema)


def merged(df: DataFrame, keys: list[str], precedence: Column, first: list[str], largest: list[str], sets: list[str]) -> DataFrame:
    """One row a group: `first` columns of the row with the least precedence (a total order), the largest of others, sorted distinct unions of the sets' values. Only partial sums are shuffled."""
    out = [F.min_by(F.col(c), precedence).alias(c) for c in first]
    out += [F.max(c).alias(c) for c in largest]
    out += [F.array_sort(F.collect_set(c)).alias(c) for c in sets]
    return df.groupBy(*keys).agg(*out, F.count(F.lit(1)).alias("n_merged"))


def then(earlier: Column, later: Column) -> Column:
    """Marks of a path: what the later part drops leaves the earlier marks, the rest is joined."""
    dropped = F.transform(F.filter(later, lambda m: F.startswith(m, F.lit("~drop:"))), lambda m: F.substring(m, 7, 1000))
    return join_marks(F.array_except(earlier, dropped), later)


def join_marks(a: Column, b: Column) -> Column:
    """Sorted union of two mark sets; of assumed marks only the least stays."""
    union = F.array_union(a, b)
    assumed = F.filter(union, lambda m: F.startswith(m, F.lit("~assumed")))
    plain = F.filter(union, lambda m: ~F.startswith(m, F.lit("~assumed")))
    return F.array_sort(F.concat(plain, F.slice(F.array_sort(assumed), 1, 1)))
