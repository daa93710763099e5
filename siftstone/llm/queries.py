"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    docs = documents(spark, sf_dir)
    return toxicity.scored(docs, toxicity.fitted(docs, _labels(spark, sf_dir)))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import licenses

    return licenses.found(documents(spark, sf_dir))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import near

    return near.linked(documents(spark, sf_dir))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import repeats

    done = repeats.with_kept(documents(spark, sf_dir))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import flac

    return flac.stored(documents(spark, sf_dir))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    docs = documents(spark, sf_dir)
    return quality.rated(docs, quality.fitted(docs, _labels(spark, sf_dir))).select("doc_id", "expected_grade", "tail_probability", "accepted")


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import bpe

    return bpe.round_trip(documents(spark, sf_dir), _vocabulary("byte_bpe_50k.json"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing

    return packing.packed(documents(spark, sf_dir), _vocabulary("word_bpe_49k.json"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import lines

    done = lines.without_boilerplate(documents(spark, sf_dir), host="source")
    return done.select("doc_id", F.col("source").alias("host"), "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import rules

    return rules.judged(documents(spark, sf_dir))


def op11_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import ctw

    return ctw.scored(documents(spark, sf_dir))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import ranked

    return ranked.ranked(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


LINE_DEDUP_SQL = """
WITH p AS (SELECT doc_id, source, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, source, i, lines[i] AS line FROM (SELECT doc_id, source, lines, unnest(range(1, len(lines) + 1)) AS i FROM p)),
u AS (SELECT DISTINCT source, coalesce(text, '') AS text FROM documents),
n AS (SELECT source, line, count(*) AS n FROM (SELECT source, unnest(list_distinct(string_split(text, chr(10)))) AS line FROM u) WHERE regexp_matches(line, '[^ \\t\\x0b\\f\\r]') GROUP BY source, line),
t AS (SELECT source, count(*) AS pages FROM u GROUP BY source),
bad AS (SELECT n.source, n.line FROM n JOIN t ON n.source IS NOT DISTINCT FROM t.source WHERE n >= 2 AND n > {ratio} * pages + {deviations} * sqrt({ratio} * (1 - {ratio}) * pages)),
k AS (SELECT l.doc_id, count(*) AS n_lines, count(bad.line) AS n_dropped, string_agg(CASE WHEN bad.line IS NULL THEN l.line END, chr(10) ORDER BY i) AS kept
      FROM l LEFT JOIN bad ON l.line = bad.line AND l.source IS NOT DISTINCT FROM bad.source GROUP BY l.doc_id)
SELECT d.doc_id, d.source AS host, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN k USING (doc_id)"""


#: Pairs by shared shingles, then reachability.
NEAR_DEDUP_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0b\f\r]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 2), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
g AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, g.b FROM r JOIN g ON r.b = g.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, m.c = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) m ON m.a = d.doc_id"""

#: Every window by its MD5; the first place of each stays.
REPEATS_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, h, unnest(range(1, len(h) // 2 + 1)) AS i FROM d),
w AS (SELECT doc_id, i, substring(h, 2 * i - 1, 2) AS x, CASE WHEN 2 * i + 198 <= len(h) THEN md5(substring(h, 2 * i - 1, 200)) END AS k FROM b),
r AS (SELECT doc_id, i, x, k IS NOT NULL AND row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1 AS again FROM w),
g AS (SELECT doc_id, i, x, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS gone FROM r),
s AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS fresh FROM g),
k AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE fresh) AS n_spans, string_agg(CASE WHEN NOT gone THEN x END, '' ORDER BY i) AS kept FROM s GROUP BY doc_id)
SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""

#: Base figures and all rules at once.
RULES_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0b\f\r]+'), lambda w: w <> '') AS w FROM documents),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^ \t\n\x0b\f\r]') GROUP BY doc_id),
v AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 7), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) > 8)),
h AS (SELECT doc_id, i FROM v QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
r AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM h, range(0, 8) AS k(j) GROUP BY doc_id),
f AS (SELECT doc_id, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars, len(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  len(list_filter(w, lambda x: upper(x) = x AND lower(x) <> x)) AS n_upper, len(list_distinct(w)) AS n_distinct, len(regexp_replace(t, '[^\pL]', '', 'g')) AS n_letters, len(regexp_replace(t, '[^0-9]', '', 'g')) AS n_digits
  FROM d LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (10 * n_symbols > word_chars OR 2 * n_upper > n_words OR 2 * n_dup_lines > n_lines OR NOT word_chars BETWEEN 2 * n_words AND 20 * n_words OR 2 * n_letters < word_chars OR (n_words >= 100 AND 20 * n_distinct < n_words) OR 10 * n_digits > 3 * word_chars) AS kept
FROM b"""


#: Every document that shares a term is scored.
RANKED_SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
d AS (SELECT doc_id, w, len(w) AS n FROM t WHERE len(w) > 0),
g AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS nt FROM d),
b AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
q AS (SELECT item_id, term, count(*)::BIGINT AS q FROM b GROUP BY ALL),
p AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, n, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
v AS (SELECT term, floor(1000 * ln((2 * nd + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, g GROUP BY term, nd),
s AS (SELECT item_id, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nd) // nt))))::BIGINT AS score FROM q JOIN v USING (term) JOIN p USING (term), g GROUP BY item_id, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_toxicity, op2_license_scan, op3_near_dedup, op4_suffix_dedup, op5_flac_media, op6_quality_classifier, op7_bpe_round_trip, op8_packing, op9_line_dedup, op10_quality_rules, op11_context_tree, op12_ranked_search, pipeline)}


def oracle_sql() -> dict[str, str]:
    from . import licenses, lines

    return {
        "op2_license_scan": licenses.oracle(),
        "op3_near_dedup": NEAR_DEDUP_SQL,
        "op4_suffix_dedup": REPEATS_SQL,
        "op9_line_dedup": LINE_DEDUP_SQL.format(deviations=lines.DEVIATIONS, ratio=lines.RATIO),
        "op10_quality_rules": RULES_SQL,
        "op12_ranked_search": RANKED_SQL,
    }
