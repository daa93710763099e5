"""An extension: scans and event counts that follow their input. No reference behaviour constrains it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changed_files(files: DataFrame, seen: DataFrame) -> DataFrame:
    """Files (path, content) whose path and content hash are not in seen (path, sha256)."""
    return files.withColumn("sha256", F.sha2("content", 256)).join(seen.select("path", "sha256"), ["path", "sha256"], "left_anti")


def event_counts(events: DataFrame, lateness: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total) of tumbling windows; events later than the watermark are left out when streaming."""
    w = events.withWatermark("ts", lateness).groupBy(F.window("ts", size), "event_type")
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def once_by_id(findings: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Each finding id once within the watermark of its time of sight."""
    return findings.withWatermark("seen_at", lateness).dropDuplicatesWithinWatermark(["id"])
