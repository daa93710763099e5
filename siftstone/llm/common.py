"""Helpers shared by the corpus operators: shared-folder tables, Arrow batches, hashing."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.operators.fixpoint import shared_folder

MASK64 = (1 << 64) - 1


#: While a table is written: its shuffle files go at once, and Arrow batches of wide rows stay small.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}


@contextlib.contextmanager
def writing(spark: SparkSession) -> Iterator[None]:
    before = {k: spark.conf.get(k) for k in _WRITING}
    for k, v in _WRITING.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v.removesuffix("b"))


def cut(df: DataFrame) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: lineage ends there, and a lost executor costs nothing before it. The shuffle files that it took go at once."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    with writing(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Tables:
    """Tables of one operator's steps, dropped together when nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.names = spark, [], []

    def cut(self, df: DataFrame) -> DataFrame:
        out = cut(df)
        self.paths += out.inputFiles()[:1]
        return out

    def bucketed(self, df: DataFrame, key: str) -> DataFrame:
        """A table dealt by key, so that joins on it move the other side only."""
        n, name = int(self.spark.conf.get("spark.sql.shuffle.partitions")), f"table_{uuid.uuid4().hex}"
        path = f"{shared_folder(self.spark).rstrip('/')}/{name}"
        with writing(self.spark):
            df.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("path", path).saveAsTable(name)
        self.names.append(name)
        self.paths.append(f"{path}/_")
        return self.spark.table(name)

    def drop(self) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.names = []
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for file in self.paths:
            folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
            folder.getFileSystem(conf).delete(folder, True)
        self.paths = []


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fresh(name: str, columns: list[str]) -> str:
    """A column name that no column has, whatever its case."""
    there = {c.lower() for c in columns}
    while name.lower() in there:
        name += "_"
    return name


def tidy(spark: SparkSession) -> None:
    """Let the driver drop plans, generated code and broadcast blocks that no one holds any more; an operator of many steps would gather them."""
    gc.collect()
    release()
    spark._jvm.System.gc()


def give_back(spark: SparkSession) -> None:
    """Have the executors return heap that they no longer use, before a stage whose Python workers need the room beside them.

    A heap that has grown stays grown until a full collection; each task asks its JVM for one.
    """
    tidy(spark)
    n = 2 * spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.reflect(F.lit("java.lang.System"), F.lit("gc")).alias("x")).write.format("noop").mode("overwrite").save()


def arrow_map(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(f, schema)


_HELD: dict = {}


def held(key, make: Callable):
    """make(), kept by this worker process for its next tasks. One object at a time: whatever else asks, and release(), lets it go."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def release() -> None:
    """Let go of what another operator has this worker hold, and give freed memory back to the system."""
    _HELD.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], chars: int, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about chars bytes of text (a longer single text stays whole)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        sizes = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes) // chars
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        for a, b in zip(starts, np.r_[starts[1:], len(group)]):
            yield batch.slice(int(a), int(b - a))


def mix64(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads every input bit over the whole word (splitmix64 constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def scaled_partitions(spark: SparkSession, rows_per_task: int, rows: int) -> int:
    """As many partitions as the rows need, never fewer than the session asks for."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_per_task))


def packed(name: str) -> F.Column:
    return F.col(name).cast("binary").alias(name)
