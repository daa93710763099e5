"""Settings of a job: defaults, then its TOML file, read through Spark so that it may lie anywhere."""

from __future__ import annotations

import logging
import tomllib

from pyspark.sql import SparkSession

LOG = logging.getLogger("siftstone.jobs")


def read(spark: SparkSession, path: str, defaults: dict) -> dict:
    """The settings of a file over the defaults; unknown keys are an error."""
    lines = spark.read.text(path, wholetext=True).collect()
    found = tomllib.loads("".join(r[0] for r in lines))
    if unknown := set(found) - set(defaults):
        raise ValueError(f"{path}: unknown settings {sorted(unknown)}")
    return defaults | found


def session(name: str) -> SparkSession:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(message)s")
    return SparkSession.builder.appName(name).getOrCreate()
