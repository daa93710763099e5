"""Context-tree weighting and ranked search against plain versions, on odd and small tables."""

import random
import zlib

import numpy as np
import pytest
from conftest import SF
from llm import brute
from llm.test_operators import LONG, ODD, frame
from pyspark.sql import functions as F

from siftstone.llm import ctw, ranked

SCORES = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes"]


def check_scores(df, rows, depth):
    got = sorted(map(tuple, df.select(*SCORES).collect()), key=repr)
    want = sorted(((i, zlib.crc32(str("" if i is None else i).encode()) % 7 == 2, n, k, t, b, s, size) for (i, _), (n, k, t, b, s, size) in zip(rows, brute.context_tree(rows, depth))), key=repr)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:5] == w[:5] and g[7] == w[7], (g, w)
        assert g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-5), (g, w)


@pytest.mark.parametrize("depth", [0, 2, 6])
def test_context_tree_equals_the_recursion(spark, depth):
    rng = random.Random(depth)
    pool = ["the", "The", "then", "é", "x1", "ab" * 9, "😀", "aaaa"]
    texts = [None, "", " \n", "a", "one two", "aaaa " * 60, "aaaa " * 60] + [" ".join(rng.choices(pool, k=rng.randrange(40))) for _ in range(60)]
    rows = list(enumerate(texts)) + [(None, "no id here"), (3, "again the same id"), (3, "again the same id")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("slice", F.lit("x")).withColumn("part", F.lit(1)).repartition(3)
    check_scores(ctw.scored(df, depth), rows, depth)


def test_context_tree_in_small_pieces(spark, monkeypatch):
    """Texts cut into pieces, slices of few rows, counts beyond the table: the same scores."""
    rows = [(k, " ".join(f"w{(k * j) % 13}" for j in range(80))) for k in range(40)] + [(99, "z" * 700 + " end"), (100, "aaaa " * 3000)]
    monkeypatch.setattr(ctw, "CHUNK", 64)
    monkeypatch.setattr(ctw, "SLICE", 1000)
    found = [list(ctw.pieces(ctw.tokens(t), 6, 64)) for _, t in rows]
    for (_, t), parts in zip(rows, found):
        assert b"".join(d[6:] for d, _ in parts) == " ".join(t.lower().split()).encode() + b"\n"
        assert sum(n for _, n in parts) == len(t.split())
        for (a, _), (b, _) in zip(parts, parts[1:]):
            assert b[:6] == a[-6:]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    check_scores(ctw.scored(df), rows, 6)


def test_log_kt_beyond_its_table():
    import math

    for a, b in ((0, 0), (3, 0), (4096, 4097), (100_000, 3), (5_000_000, 7_000_000)):
        want = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
        assert ctw.log_kt(np.array([a]), np.array([b]))[0] == pytest.approx(want, rel=1e-9, abs=1e-9)


def test_context_tree_on_odd_and_empty_tables(spark):
    odd = frame(spark, ODD, extra=True)
    got = {r.doc_id: r for r in ctw.scored(odd).collect()}
    assert len(got) == len(ODD) and got[0].n_tokens == 1 and got[0].score == got[1].score == got[2].score and got[6].score == got[7].score
    assert got[11].n_bytes == len(LONG.encode()) + 1
    assert ctw.scored(odd.limit(0)).count() == 0
    # nothing to learn from: every bit is a coin
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    for r in ctw.scored(spark.createDataFrame([(i, "ab c") for i in held], "doc_id bigint, text string")).collect():
        assert r.score == pytest.approx(-8 * 5 * np.log10(2)) and r.train_tokens == 0 and r.n_known == 0 and r.bits_per_byte == pytest.approx(8)


def test_deeper_trees_tell_more_of_held_out_texts(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    sums = [ctw.scored(docs, depth).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first() for depth in (0, 3, 6)]
    assert sums[0][0] < sums[1][0] < sums[2][0] and sums[2][0] > 1.01 * sums[2][1]


@pytest.mark.parametrize("shard", [7, 32_768])
def test_search_equals_scoring_everything(spark, monkeypatch, shard):
    monkeypatch.setattr(ranked, "SHARD", shard)
    rng = random.Random(1)
    pool = ["the", "The", "of", "é", "x1", "rare", "😀", "a", "b"]
    docs = [(None, "rare x1"), (0, None), (1, ""), (2, " -- !"), (3, "rare"), (3, "rare"), (4, "THE-the,the"), (5, LONG)] + [(k, " ".join(rng.choices(pool, weights=[9, 3, 9, 2, 2, 0.2, 1, 5, 5], k=rng.randrange(1, 50)))) for k in range(6, 200)]
    docs += [(k, "of the a b") for k in range(200, 240)]  # ties
    items = [(0, "the rare é"), (1, "of the of"), (2, None), (3, "absent"), (4, "x1 word5 WORD5 sep3"), (5, "a b the of"), (None, "😀"), (6, ", ")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("rank", F.lit("x")).withColumn("score", F.lit(1)).repartition(4)
    found = ranked.ranked(df, spark.createDataFrame(items, "item_id bigint, text string"))
    got = sorted(map(tuple, found.collect()), key=repr)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert got == sorted(brute.ranking(docs, items), key=repr)


def test_search_in_blocks_and_on_empty_tables(spark, monkeypatch):
    docs, items = [(k, f"alpha w{k % 5} beta") for k in range(40)], [(k, f"w{k} alpha") for k in range(5)]
    d, q = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    monkeypatch.setattr(ranked, "BLOCK", 10)
    assert sorted(map(tuple, ranked.ranked(d, q.unionByName(q)).collect())) == sorted(brute.ranking(docs, items))
    assert ranked.ranked(d.limit(0), q).count() == 0 and ranked.ranked(d, q.limit(0)).count() == 0


def test_a_tree_opens_little_for_a_rare_term():
    """Best first: a term that one range has alone leads there, and the other ranges stay shut."""
    n = 20_000
    doc, term = np.repeat(np.arange(n), 2), np.tile([0, 1], n)
    factor = np.tile([10, 10], n)
    term[2 * 777 + 1], factor[2 * 777 + 1] = 2, 900
    order = np.lexsort((term, doc))
    tree = ranked.MaxTree(doc[order], term[order], factor[order])
    opened = []
    for level in tree.levels:
        level.opened = (lambda f: lambda parent, w: opened.append(parent) or f(parent, w))(level.opened)
    assert tree.search(np.array([0, 0, 5]), 10, list(range(n))) == [(4500, 777)]
    assert len(opened) == len(tree.levels)
