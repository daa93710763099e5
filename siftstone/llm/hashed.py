"""Hashed-text features for the linear models, and the bounded sample of labelled rows that they are fitted on."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Hash buckets of a model.
BUCKETS = 1 << 20
#: Labelled rows that a model is fitted on, at most: those whose doc_id has the least hashes.
LABELLED_ROWS = 8000


def bucket(feature: str) -> int:
    return zlib.crc32(feature.encode()) & (BUCKETS - 1)


def shape(word: str) -> str:
    """Runs of capitals, small letters and digits as A, a and 0; other characters stand, runs once; eight at most."""
    out = ""
    for c in word[:64]:
        c = ("A" if c.isupper() else "a") if c.isalpha() else "0" if c.isdigit() else c
        if not out or out[-1] != c:
            out += c
            if len(out) == 8:
                break
    return out


class Cache(dict):
    """Remembers f(word); forgotten by whoever holds it when it has grown."""

    def __init__(self, f: Callable):
        super().__init__()
        self.f = f

    def __missing__(self, word):
        value = self[word] = self.f(word)
        return value

    def trim(self, most: int = 400_000) -> None:
        if len(self) > most:
            self.clear()


def labelled(docs: DataFrame, labels: DataFrame, label: Column, keep: Column | None = None, rows: int = LABELLED_ROWS) -> DataFrame:
    """(doc_id, text, y) of at most `rows` labelled rows: a row of a doc_id that is labelled twice counts once, by its least label; rows without a label are left out."""
    y = labels.filter(F.col("doc_id").isNotNull()).select("doc_id", label.cast("int").alias("y")).filter("y IS NOT NULL").groupBy("doc_id").agg(F.min("y").alias("y"))
    if keep is not None:
        y = y.filter(keep)
    chosen = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def features(sample: DataFrame, words: Callable[[str], list[tuple[int, float]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, value, y) of a sample that labelled() has bounded; whole texts are read on the executors and only buckets leave them."""

    def run(batches):
        for part in slices(batches, 4_000_000):
            found = [words(t or "") for t in part.column(1).to_pylist()]
            yield pa.record_batch(
                [part.column(0), part.column(2), pa.array([np.fromiter((b for b, _ in f), np.int32, len(f)).tobytes() for f in found], pa.binary()), pa.array([np.fromiter((v for _, v in f), np.float32, len(f)).tobytes() for f in found], pa.binary())],
                ["doc_id", "y", "b", "v"],
            )

    got = sorted(sample.select("doc_id", "text", "y").mapInArrow(run, "doc_id bigint, y int, b binary, v binary").collect(), key=lambda r: (r.doc_id, bytes(r.b)))
    sizes = [len(r.b) // 4 for r in got]
    join = lambda parts, kind: np.frombuffer(b"".join(map(bytes, parts)), kind)
    return np.repeat(np.arange(len(got)), sizes), join([r.b for r in got], np.int32), join([r.v for r in got], np.float32), np.array([r.y for r in got], np.int64)
