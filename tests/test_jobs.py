"""The jobs: against SQL, over growing input, run again, broken off, by their command lines."""

import subprocess
import sys
from pathlib import Path

import pytest
from conftest import SF, compare
from pyspark.sql import functions as F

from jobs import incremental_scan, queries, redacted_export, settings

ROOT = Path(__file__).resolve().parents[1]
DOCS = "doc_id bigint, text string"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    before = dict(spark.conf.getAll)
    assert compare(spark, name, queries.queries()[name], queries.oracle_sql()[name], SF) > 0
    assert dict(spark.conf.getAll) == before


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def direct(spark, docs):
    """What a scan of these texts alone gives."""
    return rows(incremental_scan.scanned(docs.select(F.col("doc_id").cast("string").alias("key"), "text")), "id", "key", "severity", "sink")


def arrive(spark, folder, texts, name):
    spark.createDataFrame(texts, DOCS).coalesce(1).write.parquet(f"{folder}/{name}")


def test_incremental_over_growing_input(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    source, out, check = f"{tmp_path}/in", f"file://{tmp_path}/out", f"{tmp_path}/check"
    docs.filter("doc_id < 120").coalesce(2).write.parquet(f"{source}/a")
    go = lambda **o: incremental_scan.run(spark, f"{source}/*", out, check, o)
    first = go()
    assert first["rows read"] == 120 and first["batches"] == 1
    report = lambda: incremental_scan.read_report(spark, out)
    assert rows(report(), "id", "key", "severity", "sink") == direct(spark, docs.filter("doc_id < 120"))
    # nothing new: nothing is read, the same report
    before = rows(report(), *report().columns)
    again = go()
    assert again["rows read"] == 0 and again["batches"] == 0 and rows(report(), *report().columns) == before
    # the rest comes in several files, one a batch; document 0 comes again with other text, one that was found to hold something is emptied
    held = int(report().filter("key <> '0'").agg(F.min(F.col("key").cast("int"))).first()[0])
    docs.filter("doc_id >= 120").repartition(3).write.parquet(f"{source}/b")
    arrive(spark, source, [(0, "write to new.person@example.org or 192.168.7.7"), (held, None), (None, "ring +44 20 7946 0958")], "c")
    last = go(max_files=1)
    assert last["rows read"] == 83 and last["batches"] >= 4
    want = docs.filter(~F.col("doc_id").isin(0, held)).unionByName(spark.createDataFrame([(0, "write to new.person@example.org or 192.168.7.7"), (None, "ring +44 20 7946 0958")], DOCS))
    assert rows(report().fillna({"key": "-"}), "id", "key", "severity", "sink") == sorted((i, k or "-", s, t) for i, k, s, t in map(tuple, incremental_scan.scanned(want.select(F.col("doc_id").cast("string").alias("key"), "text")).select("id", "key", "severity", "sink").collect()))
    assert {r.first_batch for r in report().filter("cast(key as int) < 120 AND key <> '0'").collect()} == {0}
    assert report().filter("key = '0'").filter("first_batch > 0").count() == 2
    assert report().filter(f"key = '{held}'").count() == 0
    before = rows(report().fillna({"key": "-"}), *report().columns)
    assert go()["rows read"] == 0 and rows(report().fillna({"key": "-"}), *report().columns) == before


def test_incremental_after_a_batch_that_broke_off(spark, tmp_path, monkeypatch):
    source, out, check = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check"
    arrive(spark, source, [(1, "a@example.org"), (2, "plain")], "a")
    whole = incremental_scan.log_batch

    def half(df, batch, output):
        incremental_scan.scanned(df).withColumn("batch", F.lit(batch).cast("bigint")).write.partitionBy("batch").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{output}/findings")
        raise OSError("the machine is gone")

    monkeypatch.setattr(incremental_scan, "log_batch", half)
    with pytest.raises(Exception, match="gone"):
        incremental_scan.run(spark, f"{source}/*", out, check)
    monkeypatch.setattr(incremental_scan, "log_batch", whole)
    incremental_scan.run(spark, f"{source}/*", out, check)
    report = incremental_scan.read_report(spark, out)
    assert [(r.key, r.sink, r.first_batch) for r in report.collect()] == [("1", "a@example.org", 0)]
    assert spark.read.schema(incremental_scan.FINDINGS).parquet(f"{out}/findings").count() == 1


def test_incremental_without_findings_and_by_severity(spark, tmp_path):
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    arrive(spark, source, [(1, "nothing here"), (2, ""), (3, None)], "a")
    assert incremental_scan.run(spark, f"{source}/*", out, f"{tmp_path}/check")["findings reported"] == 0
    arrive(spark, source, [(4, 'see 10.0.0.1 and token = "abcdefgh12345678"')], "b")
    counts = incremental_scan.run(spark, f"{source}/*", out, f"{tmp_path}/check", {"least_severity": "high"})
    assert counts["findings reported"] == 1 and "abcdefgh" not in str(incremental_scan.read_report(spark, out).collect())
    assert incremental_scan.run(spark, f"{source}/*", out, f"{tmp_path}/check")["findings reported"] == 2


def test_export_shows_no_secret_and_can_be_repeated(spark, tmp_path):
    docs = [(1, 'token = "aB3$kkkk-0001"', "x"), (2, "quotes aB3$kkkk-0001 again", "x"), (3, None, "x"), (4, "", "x")]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/in/documents.parquet")
    spark.createDataFrame([(7, "<p>aB3$kkkk-0001</p> key = 'short'")], "page_id bigint, html string").write.parquet(f"{tmp_path}/in/pages.parquet")
    spark.createDataFrame([(1, None, "user", "none")], "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/in/conversations.parquet")
    outs = []
    for size in (8 << 20, 0):
        for _ in range(2):
            counts = redacted_export.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", {"broadcast_bytes": size})
            outs.append(rows(redacted_export.output_rows(spark, f"{tmp_path}/out").fillna({"text": "-"}), "kind", "source", "key", "n", "text"))
    assert all(o == outs[0] for o in outs)
    got = {(k, s, key): (n, t) for k, s, key, n, t in outs[0]}
    assert got["text", "documents", "1"] == (1, 'token = "<REDACTED>"') and got["text", "documents", "2"] == (1, "quotes <REDACTED> again") and got["text", "documents", "3"] == (0, "-")
    assert got["text", "pages", "7"] == (1, "<p><REDACTED></p> key = '<REDACTED>'") and got["text", "conversations", "1/"] == (0, "none")
    leaks = {s: v for (k, s, _), v in got.items() if k == "leak"}
    assert leaks == {"documents": (2, "1"), "pages": (1, "7")} and "kkkk" not in str(outs)
    assert counts == {"texts of documents": 4, "texts of pages": 1, "texts of conversations": 1, "known secrets in texts": 1}
    # what goes from the input goes from the output
    spark.createDataFrame([], "page_id bigint, html string").write.mode("overwrite").parquet(f"{tmp_path}/in/pages.parquet")
    redacted_export.run(spark, f"{tmp_path}/in", f"{tmp_path}/out")
    outs[0] = [r for r in outs[0] if r[1] != "pages"]
    assert rows(redacted_export.output_rows(spark, f"{tmp_path}/out").fillna({"text": "-"}), "kind", "source", "key", "n", "text") == outs[0]
    # one table alone leaves the partitions of the others
    redacted_export.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", {"tables": redacted_export.DEFAULTS["tables"][:1]})
    assert rows(redacted_export.output_rows(spark, f"{tmp_path}/out").fillna({"text": "-"}), "kind", "source", "key", "n", "text") == outs[0]


def test_settings(spark, tmp_path):
    for name, job in (("redacted_export", redacted_export), ("incremental_scan", incremental_scan)):
        assert settings.read(spark, f"file://{ROOT}/jobs/{name}.toml", job.DEFAULTS) == job.DEFAULTS
    (tmp_path / "odd.toml").write_text("colour = 1\n")
    with pytest.raises(ValueError, match="colour"):
        settings.read(spark, f"{tmp_path}/odd.toml", incremental_scan.DEFAULTS)


def test_command_line(spark, tmp_path):
    arrive(spark, f"{tmp_path}/in", [(1, "a@example.org")], "a")
    line = [sys.executable, "-m", "jobs.incremental_scan", "--source", f"{tmp_path}/in/*", "--output", f"{tmp_path}/out", "--checkpoint", f"{tmp_path}/check", "--config", f"{ROOT}/jobs/incremental_scan.toml"]
    done = subprocess.run(line, cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and "findings reported: 1" in done.stderr, done.stderr[-2000:]
    assert [r.sink for r in incremental_scan.read_report(spark, f"{tmp_path}/out").collect()] == ["a@example.org"]


def test_jobs_need_no_corpus_operators():
    for p in (ROOT / "jobs").glob("*.py"):
        assert "llm" not in p.read_text() and "corpus_pipeline" not in p.read_text()
