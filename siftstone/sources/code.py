"""Python files as rows. Spark's own file sources pass over names that begin with _ or ., so this source lists the tree itself."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from siftstone.functions.text import IGNORED, glob_regex

SCHEMA = "path string, content binary"
CHUNK = 64


def is_ignored(relative: str, patterns: tuple[str, ...], directory: bool) -> bool:
    """The ignore rules for one path, as functions.text.ignored has them for columns."""
    parts = relative.split("/")
    if any(re.match(glob_regex(d), p) for d in IGNORED for p in (parts if directory else parts[:-1])):
        return True
    for raw in patterns:
        p = raw.strip().rstrip("/")
        whole = [p, p + "/*"] + ([p[3:], p[3:] + "/*"] if p.startswith("**/") else [])
        if p and (any(re.match(glob_regex(w), relative) for w in whole) or "/" not in p and any(re.match(glob_regex(p), x) for x in parts)):
            return True
    return False


def listed(root: str, patterns: tuple[str, ...] = ()) -> list[str]:
    """Sorted paths of .py and .pyw files below root; ignored directories are not entered. A file stands for itself."""
    if os.path.isfile(root):
        return [] if is_ignored(os.path.basename(root), patterns, False) else [os.path.basename(root)]
    found = []
    for folder, folders, files in os.walk(root):
        rel = os.path.relpath(folder, root).replace(os.sep, "/")
        join = lambda x, rel=rel: x if rel == "." else f"{rel}/{x}"
        folders[:] = sorted(d for d in folders if not is_ignored(join(d), patterns, True))
        found += [join(f) for f in files if f.endswith((".py", ".pyw")) and not is_ignored(join(f), patterns, False)]
    return sorted(found)


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.patterns = tuple(filter(None, options.get("ignore", "").split("\n")))

    def partitions(self):
        paths = listed(self.root, self.patterns)
        return [Files(paths[i : i + CHUNK]) for i in range(0, len(paths), CHUNK)] or [Files([])]

    def read(self, partition):
        for p in partition.paths:
            at = self.root if os.path.isfile(self.root) else os.path.join(self.root, p)
            try:
                with open(at, "rb") as f:
                    yield p, f.read()
            except OSError:
                yield p, None


class PythonFiles(DataSource):
    """spark.read.format("python_files").option("ignore", "pattern\\npattern").load(root); the root must be visible to the executors."""

    @classmethod
    def name(cls):
        return "python_files"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return Reader(self.options)


def python_files(spark: SparkSession, root: str, ignore: tuple[str, ...] = ()) -> DataFrame:
    spark.dataSource.register(PythonFiles)
    return spark.read.format("python_files").option("ignore", "\n".join(ignore)).load(root)
