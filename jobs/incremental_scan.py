"""Job: scan texts as they arrive, and keep a report of what stands now.

    python -m jobs.incremental_scan --source PATH_OR_GLOB --output DIR --checkpoint DIR [--config FILE]

Each run takes the Parquet files that came since the last one (a file stream with a checkpoint), in batches, and ends. A
batch is scanned once; the log keeps what it gave:

    OUTPUT/seen/batch=...       key, sha256 of each text scanned
    OUTPUT/findings/batch=...   id, key, path, rule, vuln_class, severity, confidence, sink, occurrence

A batch that is tried again replaces its own partitions. A text that comes again replaces its earlier findings: those that
it no longer has are withdrawn. The report is made from the log, never from the texts:

    OUTPUT/report/severity=...  the findings of each key's last batch, with first_batch, in which the id was first seen

It is written at every run, so a run that was broken off is made good by the next, and a run without new files changes nothing.
Rows of one key in one batch are one text's findings together; a null key is a key of its own.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import settings
from siftstone.functions import taxonomy
from siftstone.operators import reporting
from siftstone.plans import textscan

DEFAULTS = {"key": "doc_id", "text": "text", "max_files": 1000, "least_severity": "low", "least_confidence": 0}
SEEN = "key string, sha256 string, batch bigint"
FINDINGS = "id string, key string, path string, rule string, vuln_class string, severity string, confidence int, sink string, occurrence int, batch bigint"


def scanned(rows: DataFrame) -> DataFrame:
    """Findings of texts (key, text)."""
    found = textscan.findings(textscan.matches(rows, ["key"]), F.concat(F.lit("doc/"), F.coalesce("key", F.lit(""))), ("key",))
    return found.select("id", "key", "path", "rule", "vuln_class", "severity", "confidence", "sink", "occurrence")


def log_batch(rows: DataFrame, batch: int, output: str) -> None:
    """Scan a batch and write its partitions of the log, or write them again."""

    def write(df: DataFrame, name: str) -> None:
        df.withColumn("batch", F.lit(batch).cast("bigint")).write.partitionBy("batch").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{output}/{name}")

    # A batch tried again may have less to write than at first; what counts are the keys in `seen`, which is written last.
    write(scanned(rows), "findings")
    write(rows.select("key", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256")), "seen")


def standing(seen: DataFrame, found: DataFrame) -> DataFrame:
    """The findings of each key's last batch, with the batch in which an id was first seen."""
    last = seen.groupBy("key").agg(F.max("batch").alias("batch")).withColumnsRenamed({"key": "_key", "batch": "_batch"})
    first = found.groupBy("id").agg(F.min("batch").alias("first_batch"))
    now = found.join(last, F.col("key").eqNullSafe(F.col("_key")) & (F.col("batch") == F.col("_batch")), "left_semi")
    return now.join(first, "id").drop("batch")


def report(spark: SparkSession, output: str, options: dict) -> DataFrame:
    seen, found = spark.read.schema(SEEN).parquet(f"{output}/seen"), spark.read.schema(FINDINGS).parquet(f"{output}/findings")
    now = standing(seen, found).withColumn("_rank", taxonomy.rank(F.col("severity"), taxonomy.SEVERITIES))
    shown = reporting.visible(F.col("_rank"), F.col("confidence"), F.lit(False), taxonomy.SEVERITIES.index(options["least_severity"]), options["least_confidence"], True)
    now.filter(shown).drop("_rank").write.partitionBy("severity").mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{output}/report")
    return read_report(spark, output)


def read_report(spark: SparkSession, output: str) -> DataFrame:
    columns = [c for c in FINDINGS.split(", ") if not c.startswith("batch ")]
    return spark.read.schema(", ".join(columns) + ", first_batch bigint").parquet(f"{output}/report")


def run(spark: SparkSession, source: str, output: str, checkpoint: str, options: dict | None = None) -> dict[str, int]:
    """Take what is new at `source`, then write the report; counts of what was read and written."""
    options = DEFAULTS | (options or {})
    rows = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", options["max_files"]).parquet(source)
    rows = rows.select(F.col(options["key"]).cast("string").alias("key"), F.col(options["text"]).alias("text"))
    stream = rows.writeStream.foreachBatch(lambda df, batch: log_batch(df, batch, output)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    stream.awaitTermination()
    # (A batch is read once for each table of the log, so progress counts its rows more than once.)
    new = {p.batchId for p in stream.recentProgress if p.numInputRows}
    counts = {"batches": len(new), "rows read": spark.read.schema(SEEN).parquet(f"{output}/seen").filter(F.col("batch").isin(new)).count() if new else 0}
    counts["findings reported"] = report(spark, output, options).count()
    for what, n in counts.items():
        settings.LOG.info("%s: %d", what, n)
    settings.LOG.info("read %s; wrote %s/seen, %s/findings and %s/report", source, output, output, output)
    return counts


def main() -> None:
    args = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    for name in ("--source", "--output", "--checkpoint"):
        args.add_argument(name, required=True)
    args.add_argument("--config")
    a = args.parse_args()
    spark = settings.session("incremental scan")
    try:
        run(spark, a.source, a.output, a.checkpoint, settings.read(spark, a.config, DEFAULTS) if a.config else None)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
