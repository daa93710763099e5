"""The corpus pipeline: documents in, packed training sequences out.

Each stage works on all that its predecessor kept, and its decisions take effect: documents that the quality classifier
rejects go, boilerplate lines go, one document of each near-duplicate group stays, repeated passages go, the rest is packed.
All stages but the last return the columns of documents; n_chars follows the text.

Defined results, stage by stage: null, empty and very long texts, ties, repeated rows and extra columns as the operators
define them (their modules say); extra columns pass through every stage but the last as they are. A stage that leaves
nothing hands on an empty table, and an empty table packs to no pieces. A document whose text is emptied stays a document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.llm import lines, near, packing, quality, repeats
from siftstone.llm.common import cut, documents, give_back


def _counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """docs with its own columns only, n_chars counted anew."""
    return docs.select(*[F.length("text").cast("bigint").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in columns])


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(lines.without_boilerplate(docs, host="source", counts=()), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    give_back(spark)
    return near.one_of_each(docs, words=5, percent=80)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    give_back(spark)
    return _counted(repeats.without_repeats(docs), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    give_back(spark)
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("suffix-array dedup", suffix_dedup),
    ("packing", pack),
]

#: A fitted classifier and a least-squares plan are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
