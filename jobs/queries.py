"""The jobs as queries: each runs twice into a new folder, and its whole output is read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from jobs import incremental_scan, redacted_export
from siftstone.functions import text
from siftstone.operators.fixpoint import shared_folder
from siftstone.plans import catalogue


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def job1_redacted_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _folder(spark, "job1")
    for _ in range(2):
        redacted_export.run(spark, sf_dir, out)
    return redacted_export.output_rows(spark, out)


def job2_incremental_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _folder(spark, "job2")
    for _ in range(2):  # a glob, since a stream's path may not be a single file
        incremental_scan.run(spark, f"{sf_dir}/documents.parque[t]", out, f"{out}/checkpoint")
    return incremental_scan.read_report(spark, out)


def queries() -> dict:
    return {f.__name__: f for f in (job1_redacted_export, job2_incremental_scan)}


def oracle_sql() -> dict[str, str]:
    known, every = catalogue.known_secrets_sql(), " UNION ALL ".join(
        f"SELECT '{t}' AS source, {key} AS doc_id, {column} AS text FROM {t}"
        for t, key, column in (("documents", "coalesce(doc_id::VARCHAR, '')", "text"), ("pages", "coalesce(page_id::VARCHAR, '')", "html"), ("conversations", "coalesce(conv_id::VARCHAR, '') || '/' || coalesce(turn::VARCHAR, '')", "text"))
    )
    export = f"""WITH {known}, t AS ({every}), f AS (SELECT source, doc_id, text, list_filter(vs, lambda x: contains(coalesce(text, ''), x)) AS f FROM t, w),
    r AS (SELECT source || chr(1) || doc_id AS doc_id, len(f) AS n, CASE WHEN text IS NOT NULL THEN list_reduce(list_prepend(text, f), lambda a, s: replace(a, s, '{text.REDACTED}')) END AS t FROM f),
    c AS ({catalogue.secretish_sql('r')})
    SELECT 'text' AS kind, split_part(r.doc_id, chr(1), 1) AS source, split_part(r.doc_id, chr(1), 2) AS key, n::BIGINT AS n, c.t AS text FROM r JOIN c USING (doc_id)
    UNION ALL SELECT 'leak', source, sha256(v), count(*), min(doc_id) FROM (SELECT source, doc_id, unnest(f) AS v FROM f) GROUP BY source, v"""
    return {"job1_redacted_export": export, "job2_incremental_scan": catalogue.text_findings_sql()}
