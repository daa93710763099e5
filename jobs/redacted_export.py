"""Job: export tables of texts without their secrets.

    python -m jobs.redacted_export --input DIR --output DIR [--config FILE]

Secrets that texts of some tables give to names make one dictionary; every text of every table is then freed of every value
of it, wherever and however it stands there (a page may quote what a document defines), and of literals that look like
secrets themselves. Two partitioned tables come out, each source a partition:

    OUTPUT/texts/source=...   key, secrets (SHA-256 of the known values that stood in the text, in order), text
    OUTPUT/leaks/source=...   secret (SHA-256), n_texts, first_key: where each known value stands

A run replaces the partitions of texts that its settings name, whole, and no others; leaks are counted anew from all texts
that are there. So it can be repeated: the same input gives the same rows. Nothing in the output, and nothing in the log,
shows a secret.
"""

from __future__ import annotations

import argparse
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import settings
from siftstone.functions import text
from siftstone.operators import dictionary
from siftstone.plans import textscan

DEFAULTS = {
    "tables": [{"name": "documents", "key": ["doc_id"], "text": "text"}, {"name": "pages", "key": ["page_id"], "text": "html"}, {"name": "conversations", "key": ["conv_id", "turn"], "text": "text"}],
    "secrets_from": ["documents"],
    "broadcast_bytes": dictionary.BROADCAST_BYTES,
}


def rows_of(spark: SparkSession, folder: str, table: dict) -> DataFrame:
    """(source, key, text) of a table; a key of several columns is joined by slashes."""
    key = F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in table["key"]])
    return spark.read.parquet(f"{folder}/{table['name']}.parquet").select(F.lit(table["name"]).alias("source"), key.alias("key"), F.col(table["text"]).alias("text"))


TEXTS = "key string, secrets array<string>, text string, source string"
LEAKS = "secret string, n_texts bigint, first_key string, source string"


def run(spark: SparkSession, folder: str, output: str, options: dict | None = None) -> dict[str, int]:
    """Export the tables below `folder` to `output`; counts of what was read and written."""
    options = DEFAULTS | (options or {})
    tables = {t["name"]: rows_of(spark, folder, t) for t in options["tables"]}
    known = reduce(DataFrame.unionByName, [textscan.secrets(tables[name]) for name in options["secrets_from"]]).distinct()
    for name, rows in tables.items():
        found = dictionary.with_found(rows, ["text"], known, broadcast_bytes=options["broadcast_bytes"])
        clean = text.redact_secretish(text.redact(F.col("text"), F.col("found")))
        hashes = F.transform("found", lambda v: F.sha2(v, 256)).alias("secrets")
        found.select("key", hashes, clean.alias("text")).write.mode("overwrite").parquet(f"{output}/texts/source={name}")
    # What stands where is counted from the table just written: the texts are not read again.
    texts = spark.read.schema(TEXTS).parquet(f"{output}/texts")
    places = texts.select("source", "key", F.explode("secrets").alias("secret"))
    leaks = places.groupBy("source", "secret").agg(F.count(F.lit(1)).alias("n_texts"), F.min("key").alias("first_key"))
    leaks.write.partitionBy("source").mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{output}/leaks")
    counts = {f"texts of {r.source}": r.n for r in texts.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts["known secrets in texts"] = spark.read.schema(LEAKS).parquet(f"{output}/leaks").select("secret").distinct().count()
    for what, n in sorted(counts.items()):
        settings.LOG.info("%s: %d", what, n)
    settings.LOG.info("read %s; wrote %s/texts and %s/leaks", folder, output, output)
    return counts


def output_rows(spark: SparkSession, output: str) -> DataFrame:
    """(kind, source, key, n, text): both tables of the output, as one."""
    texts = spark.read.schema(TEXTS).parquet(f"{output}/texts").select(F.lit("text").alias("kind"), "source", "key", F.size("secrets").cast("bigint").alias("n"), "text")
    leaks = spark.read.schema(LEAKS).parquet(f"{output}/leaks").select(F.lit("leak").alias("kind"), "source", F.col("secret").alias("key"), F.col("n_texts").alias("n"), F.col("first_key").alias("text"))
    return texts.unionByName(leaks)


def main() -> None:
    args = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    args.add_argument("--input", required=True)
    args.add_argument("--output", required=True)
    args.add_argument("--config")
    a = args.parse_args()
    spark = settings.session("redacted export")
    try:
        run(spark, a.input, a.output, settings.read(spark, a.config, DEFAULTS) if a.config else None)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
