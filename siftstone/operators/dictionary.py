"""Known values in texts: a dictionary that grows with the report, looked for in every text and replaced there.

Which values stand in which text is worked out exactly, in one of two ways. A dictionary whose measured size is within
`broadcast_bytes` goes to every task as an automaton that reads each text once. A larger one is never sent anywhere: each
value is known by one gram of its bytes (of its rarest grams in the dictionary); tasks look for grams that a bitmap of fixed size
allows, these few are joined to the values by a shuffle, and the values are compared with the texts themselves.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.functions import text as texts_
from siftstone.operators.fixpoint import stored

BROADCAST_BYTES = 8 << 20
#: Bytes of a gram, the longest first: a value is known by the first of these that it is as long as.
WIDTHS = (8, 4, 2, 1)
#: Bits of the bitmap of grams.
BITS = 24
#: Report-wide values: length at least, and length from which letters alone will do.
SHORTEST_WIDE, LONG = 8, 16


def wide(value: Column) -> Column:
    """Whether a secret of one file is looked for in all others: long, or of some length and not of letters alone."""
    return (F.length(value) >= SHORTEST_WIDE) & ((F.length(value) >= LONG) | ~value.rlike(r"^\p{L}+$"))


def collected(rows: DataFrame, value: Column) -> DataFrame:
    """(value): the distinct report-wide values among those of rows. Sets are made before the shuffle."""
    return rows.select(value.alias("value")).filter(wide(F.col("value"))).distinct()


@functools.lru_cache(maxsize=2)
def _automaton(values: tuple[bytes, ...]):
    import ahocorasick

    machine = ahocorasick.Automaton()
    for v in values:
        machine.add_word(v.decode(), v.decode())
    machine.make_automaton()
    return machine


def _by_automaton(columns: list[Column], values: DataFrame) -> Column:
    """Sorted distinct values that stand in the columns. The automaton is built once a worker process."""
    known = tuple(sorted(r.value.encode() for r in values.collect()))
    held = values.sparkSession.sparkContext.broadcast(known)

    def find(*parts: pa.Array) -> pa.Array:
        machine = _automaton(held.value)
        out = []
        for row in zip(*(p.to_pylist() for p in parts)):
            out.append(sorted({v for t in row if t for _, v in machine.iter(t)}) if len(machine) else [])
        return pa.array(out, pa.list_(pa.string()))

    return F.arrow_udf(find, "array<string>")(*columns)


def grams(data: bytes, width: int) -> np.ndarray:
    """The grams of the bytes, in order, as numbers: a view of the bytes from every place."""
    n = len(data) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    return np.ndarray(n, f">u{width}", data, 0, (1,)).astype(np.uint64)


def places(found: np.ndarray, width: int) -> np.ndarray:
    """Where grams stand in the bitmap."""
    return ((found + np.uint64(width)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)


def _gram_rows(batches: Iterator[pa.RecordBatch], widths: tuple[int, ...], first_only: bool, bitmap: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """(row, width, gram, place) of each row's distinct grams; first_only: of the first width that fits. Only grams that the bitmap has are sorted; those of many rows make one batch."""
    for batch in batches:
        of, found, held = [], [], 0
        for i, data in enumerate(batch.column(1).to_pylist()):
            data = (data or "").encode()
            for width in widths:
                if len(data) < width:
                    continue
                got = grams(data, width)
                if bitmap is not None:
                    at = places(got, width)
                    got = got[(bitmap[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1]
                if len(got):
                    got = np.unique(got)
                    of.append((i, width, len(got)))
                    found.append(got)
                    held += len(got)
                if first_only:
                    break
            if held > 100_000:
                yield _gram_batch(batch.column(0), of, found)
                of, found, held = [], [], 0
        if held:
            yield _gram_batch(batch.column(0), of, found)


def _gram_batch(keys: pa.Array, of: list[tuple[int, int, int]], found: list[np.ndarray]) -> pa.RecordBatch:
    row, width, n = (np.array(c, np.int64) for c in zip(*of))
    at = np.concatenate([places(g, w) for g, w in zip(found, width)]).astype(np.int64)
    return pa.record_batch([keys.take(pa.array(np.repeat(row, n))), pa.array(np.repeat(width, n).astype(np.int32)), pa.array(np.concatenate(found).view(np.int64)), pa.array(at)], ["row", "width", "gram", "place"])


_GRAM = "row string, width int, gram bigint, place bigint"


def anchors(values: DataFrame) -> DataFrame:
    """(value, width, gram, place): one gram of each value, of which the dictionary has the fewest."""
    every = values.select("value", "value").toDF("row", "data").mapInArrow(lambda b: _gram_rows(b, WIDTHS, True, None), _GRAM)
    shared = every.groupBy("width", "gram").agg(F.count(F.lit(1)).alias("n"))
    rare = every.join(shared, ["width", "gram"]).groupBy("row").agg(F.min_by(F.struct("width", "gram", "place"), F.struct("n", "gram")).alias("a"))
    return rare.select(F.col("row").alias("value"), "a.*")


def _by_grams(texts: DataFrame, key: Column, columns: list[Column], values: DataFrame) -> DataFrame:
    """(row, found): by key, the values that may stand in a text's columns, since their grams do."""
    known = stored(anchors(values))
    words = known.groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("place", F.lit(64)).cast("int"))).alias("bits")).collect()
    bitmap = np.zeros(1 << (BITS - 6), np.int64)
    for r in words:  # at most as many rows as the bitmap has words
        bitmap[r.word] = r.bits
    held = texts.sparkSession.sparkContext.broadcast(bitmap.view(np.uint64))
    used = tuple(sorted((r.width for r in known.select("width").distinct().collect()), reverse=True))
    seen = None
    for c in columns:
        one = texts.select(key.alias("row"), c.alias("data")).mapInArrow(lambda b: _gram_rows(b, used, False, held.value), _GRAM).select("row", "width", "gram")
        seen = one if seen is None else seen.unionByName(one)
    return seen.join(known, ["width", "gram"]).groupBy("row").agg(F.collect_set("value").alias("found"))


def with_found(texts: DataFrame, columns: list[str], values: DataFrame, name: str = "found", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """texts with an array of the distinct values (value) that stand in their columns, in order. Null texts hold nothing. With a large dictionary, rows of equal texts are looked up as one."""
    # What gives the values may be a search of all texts: it is done once, not each time that they are read.
    values = stored(values.filter("value <> ''").select("value").distinct())
    size = values.agg(F.sum(F.octet_length("value") + 64)).first()[0] or 0
    cols = [F.col(c) for c in columns]
    if size <= broadcast_bytes:
        return texts.withColumn(name, _by_automaton(cols, values))
    key = F.sha2(F.concat_ws("\x00", *[F.coalesce(c, F.lit("")) for c in cols]), 256)
    near = _by_grams(texts, key, cols, values).select(F.col("row").alias("_row"), F.col("found").alias("_near"))
    joined = texts.withColumn("_key", key).join(near, F.col("_key") == F.col("_row"), "left").drop("_row", "_key")
    stands = lambda v: functools.reduce(lambda a, b: a | b, [F.contains(F.coalesce(c, F.lit("")), v) for c in cols])
    return joined.withColumn(name, F.array_sort(F.filter(F.coalesce("_near", F.array().cast("array<string>")), stands))).drop("_near")


def redacted(texts: DataFrame, columns: list[str], values: DataFrame, scope: str | None = None, scoped: DataFrame | None = None, tool: DataFrame | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """texts with every known value in columns replaced, the longest first.

    values: (value), looked for everywhere; tool: (value) of other tools, of any length; scoped: (scope, value), looked for in
    rows of their scope only: the secrets of one file, which are few.
    """
    out = with_found(texts, columns, values, "_wide", broadcast_bytes)
    none = F.array().cast("array<string>")
    known = F.col("_wide")
    if scoped is not None:
        own = scoped.groupBy(F.col(scope).alias("_scope")).agg(F.collect_set("value").alias("_own"))
        out = out.join(own, F.col(scope) == F.col("_scope"), "left").drop("_scope")
        known = F.array_union(known, F.coalesce("_own", none))
    if tool is not None:
        out = with_found(out, columns, tool, "_tool", broadcast_bytes)
    given = F.col("_tool") if tool is not None else None
    return out.withColumns({c: texts_.redact(F.col(c), known, tool_secrets=given) for c in columns}).drop("_wide", "_own", "_tool")


def leaking(rows: DataFrame, key: str, columns: list[str], values: DataFrame, scope: str | None = None, scoped: DataFrame | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(key): rows with a known value in any of the columns."""
    found = with_found(rows, columns, values, "_wide", broadcast_bytes)
    hit = F.size("_wide") > 0
    if scoped is not None:
        own = scoped.groupBy(F.col(scope).alias("_scope")).agg(F.collect_set("value").alias("_own"))
        found = found.join(own, F.col(scope) == F.col("_scope"), "left")
        held = F.coalesce("_own", F.array().cast("array<string>"))
        near = F.exists(held, lambda v: functools.reduce(lambda a, b: a | b, [F.contains(F.coalesce(F.col(c), F.lit("")), v) for c in columns]))
        hit = hit | near
    return found.filter(hit).select(key).distinct()
