"""Every registered query runs, and equals its SQL where it has one."""

import pytest
from conftest import SF, compare

from siftstone.plans import catalogue

SQL = catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    compare(spark, name, catalogue.queries()[name], SQL[name], SF)


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() > 0 and df.columns[0] == "id"
    assert df.select("id").distinct().count() == df.count()


def test_catalogue_is_registered():
    import __spark_entry__ as entry

    assert set(catalogue.queries()) <= set(entry.queries())
    assert set(SQL) <= set(entry.oracle_sql())


def test_anchor_clusters_do_not_bridge(spark):
    """The middle row overlaps both others, which do not overlap: it joins one, the other stays alone."""
    from siftstone.operators.merging import anchor_clusters

    rows = [{"s": 0, "e": 4, "k": 0}, {"s": 3, "e": 7, "k": 1}, {"s": 6, "e": 9, "k": 2}]
    together = lambda a, b: a["s"] < b["e"] and b["s"] < a["e"]
    assert anchor_clusters(rows, lambda r: r["k"], together) == [0, 0, 1]
    assert anchor_clusters([], lambda r: r["k"], together) == []


def test_clusters_overlap_pairwise_and_ignore_order(spark):
    import random

    from siftstone.operators.merging import anchor_clusters

    rng = random.Random(5)
    together = lambda a, b: a["s"] < b["e"] and b["s"] < a["e"]
    for _ in range(100):
        rows = [{"s": (s := rng.randrange(12)), "e": s + rng.randrange(1, 6), "k": i} for i in range(rng.randrange(2, 8))]
        numbers = anchor_clusters(rows, lambda r: (r["e"] - r["s"], r["k"]), together)
        assert all(together(a, b) for a, i in zip(rows, numbers) for b, j in zip(rows, numbers) if i == j)
        mixed = rng.sample(rows, len(rows))
        again = anchor_clusters(mixed, lambda r: (r["e"] - r["s"], r["k"]), together)
        assert dict(zip((r["k"] for r in mixed), again)) == dict(zip((r["k"] for r in rows), numbers))


def test_taxonomy(spark):
    from pyspark.sql import functions as F

    from siftstone.functions import taxonomy

    rows = spark.createDataFrame([("HS-SQLI-009", ["CWE-1"]), ("bandit:B602", []), ("gitleaks:x", ["CWE-89"]), ("t:a", ["CWE-900", "cwe_0078: x"]), ("t:b", ["CWE-900", "CWE-20"]), ("t:c", ["none"]), ("t:d", None)], "rule string, cwes array<string>")
    got = [r[0] for r in rows.select(taxonomy.classify(F.col("rule"), F.col("cwes"))).collect()]
    assert got == ["sqli", "cmdi", "secret", "cmdi", "other:CWE-20", "other:t:c", "other:t:d"]


def test_redaction_longest_first(spark):
    from pyspark.sql import functions as F

    from siftstone.functions import text

    df = spark.createDataFrame([("pass passwort abc", ["pass", "passwort", "abc"]), (None, ["abcd"]), ("", [])], "t string, s array<string>")
    assert [r[0] for r in df.select(text.redact(F.col("t"), F.col("s"))).collect()] == ["<REDACTED> <REDACTED> abc", None, ""]
    assert df.limit(1).select(text.redact(F.col("t"), F.col("s"), tool_secrets=F.array(F.lit("abc")))).first()[0] == "<REDACTED> <REDACTED> <REDACTED>"


def test_fixpoint_says_when_it_is_cut(spark):
    from siftstone.operators import fixpoint

    edges = spark.createDataFrame([(i, i + 1) for i in range(6)] + [(6, 0)], "a int, b int")
    assert fixpoint.reach(edges, "a", "b").count() == 49
    onward = edges.withColumnRenamed("a", "v").withColumnRenamed("b", "n")
    step = lambda d: d.join(onward, d.b == onward.v).select(d.a, onward.n.alias("b"))
    assert fixpoint.fixpoint(edges, step, rounds=2)[1] is False


def test_entropy_of_whole_texts(spark, tmp_path):
    """Every character counts, also past the first 64, and long texts of many different characters take no longer than their length asks for."""
    import math
    import time
    from collections import Counter

    many = "".join(chr(0x4E00 + i % 15000) for i in range(60000))
    texts = ["a" * 64 + "bcd" * 50, "", None, "\U0001f600a\U0001f600\u00e9", "aabb", many, "x" * 300]
    spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").write.parquet(f"{tmp_path}/documents.parquet")
    begun = time.monotonic()
    got = {r.doc_id: r.entropy for r in catalogue.q_entropy(spark, str(tmp_path)).collect()}
    assert time.monotonic() - begun < 60
    for i, t in enumerate(texts):
        want = sum(-n / len(t) * math.log2(n / len(t)) for n in Counter(t).values()) if t else 0.0
        assert abs(got[i] - want) < 2e-6, i


def test_cache_lookup_of_whole_texts(spark, tmp_path):
    """Texts of one head and other tails have keys of their own."""
    head = "h" * 40
    spark.createDataFrame([(0, head + "a"), (1, head + "b"), (2, head + "c"), (3, None), (4, "short")], "doc_id int, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, head + "a"), (8, head + "b"), (9, head + "b"), (5, "short")], "item_id int, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {r.doc_id: r.reply for r in catalogue.q_cache_lookup(spark, str(tmp_path)).collect()} == {0: 7, 1: 8, 2: -1, 3: -1, 4: 5}


def test_reach_counts_cover_every_row(spark):
    """Closure worked out in plain Python: every line of every order is a node, and reaches all lines of its order."""
    from collections import defaultdict

    sizes = defaultdict(int)
    for r in spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey").collect():
        sizes[r.l_orderkey] += 1
    want = {}
    for k, n in sizes.items():
        after = {i: i % n + 1 for i in range(1, n + 1)}
        for start in after:
            seen, at = set(), start
            while after[at] not in seen:
                at = after[at]
                seen.add(at)
            want[k, start] = len(seen)
    got = [(r.l_orderkey, r.line, r.reached) for r in catalogue.q_reachability(spark, SF).collect()]
    assert len(got) == sum(sizes.values()) and {(k, i): n for k, i, n in got} == want


def test_witnesses_are_the_first_and_the_least(spark):
    """A diamond and a cycle: each fact keeps the least witness of its first round, and a trace ends."""
    from pyspark.sql import functions as F

    from siftstone.operators import fixpoint

    edges = spark.createDataFrame([("s", "b"), ("s", "a"), ("a", "x"), ("b", "x"), ("x", "y"), ("y", "s"), ("y", "y"), ("q", "r")], "f string, t string")
    seed = spark.createDataFrame([("s", None)], "node string, before string")
    facts = fixpoint.witnessed(seed, lambda d: d.join(edges, d.node == edges.f).select(F.col("t").alias("node"), F.col("f").alias("before")), ["node"])
    assert {r.node: r.before for r in facts.collect()} == {"s": None, "a": "s", "b": "s", "x": "a", "y": "x"}
    wanted = spark.createDataFrame([("y",), ("s",), ("q",)], "node string")
    trace = lambda n: {r.node: r.trace for r in fixpoint.traced(wanted, facts, ["node"], ["before"], F.col("node"), n).collect()}
    assert trace(5) == {"y": ["y", "x", "a", "s"], "s": ["s"], "q": []} and trace(2)["y"] == ["y", "x"]


def test_innermost_span_by_levels_of_width(spark):
    """Against every span of the key: nested, equal, huge, negative and empty ones; a key with a third of all spans is dealt by bins."""
    import random

    from siftstone.operators import regions

    rng = random.Random(2)
    spans = [(rng.choice("ab"), s := rng.randrange(-300, 300), s + rng.choice([0, 1, 3, 40, 200, -1]), f"n{k}") for k in range(300)] + [("a", -(10**12), 10**12, "all"), ("c", 5, None, "open"), (None, 0, 9, "none")]
    points = [(rng.choice(["a", "b", "c", None]), rng.randrange(-320, 520)) for _ in range(300)] + [("a", None), ("a", 10**13)]

    def plain(k, p):
        held = [(s, -e, n) for key, s, e, n in spans if None not in (k, p, e) and key == k and s <= p <= e]
        return max(held)[2] if held else "<module>"

    df = spark.createDataFrame(points, "k string, p bigint")
    got = regions.innermost(df, spark.createDataFrame(spans, "k string, s bigint, e bigint, n string"), ["k"], "p", "s", "e", "n", "<module>")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(((k, p, plain(k, p)) for k, p in points), key=repr)
    assert regions.innermost(df, spark.createDataFrame([], "k string, s bigint, e bigint, n string"), ["k"], "p", "s", "e", "n", "-").filter("n = '-'").count() == len(points)


def test_anchor_clusters_of_a_whole_table_equal_the_plain_rule(spark):
    """Every order's clusters, whatever their numbers, are those of rows held against all members."""
    import collections

    from siftstone.operators.merging import anchor_clusters

    rows = [r.asDict() for r in catalogue.queries()["q_anchor_cluster"](spark, SF).collect()]
    together = lambda a, b: a["s"] < b["e"] and b["s"] < a["e"] and (a["source"] != b["source"] or a["sink"] == b["sink"])
    by = collections.defaultdict(list)
    for r in rows:
        by[r["l_orderkey"]].append(r)
    sets = lambda own, numbers: {frozenset(id(r) for r, n in zip(own, numbers) if n == k) for k in numbers}
    assert len(rows) > 4000  # all but spans without extent
    for own in by.values():
        plain = anchor_clusters(own, lambda r: tuple(r[c] for c in ("size", "s", "source", "l_partkey", "l_linenumber")), together)
        assert sets(own, plain) == sets(own, [r["cluster"] for r in own])


def test_a_large_island_ends(spark):
    """100,000 spans that all hang together, in thousands of clusters, in bounded time."""
    import time

    import numpy as np

    from siftstone.operators.merging import anchored

    rng = np.random.default_rng(4)
    starts = np.sort(rng.integers(0, 200_000, 100_000))
    ends = starts + rng.integers(3, 12, 100_000)
    began = time.time()
    numbers = anchored(starts, ends, ["a"] * 100_000, ["x"] * 100_000, np.lexsort((starts, ends - starts)).tolist())
    assert len(set(numbers.tolist())) > 1000 and time.time() - began < 120
    for k in range(0, 1000, 50):
        own = np.flatnonzero(numbers == k)
        assert starts[own].max() < ends[own].min()


def test_clusters_are_read_island_by_island_without_a_call_each(spark):
    """Many small islands and one of many clusters, also where a batch ends inside one; the plan has no function that is called once a group."""
    import collections

    from siftstone.operators import merging

    rows = [(k, s, s + 3, s % 2, s % 3, s) for k in range(300) for s in range(0, 20, 2)] + [(-1, s % 50, 60 + s % 7, s % 2, s, s) for s in range(200)] + [(None, 1, 2, 0, 0, 0), (None, 1, 2, 0, 1, 1)]
    df = spark.createDataFrame(rows, "k bigint, s bigint, e bigint, source bigint, sink bigint, id bigint")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        out = merging.cluster(df, ["k"], ["id"], "s", "e", "source", "sink")
        got = [r.asDict() for r in out.collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "FlatMapGroups" not in out._jdf.queryExecution().toString()
    assert len(got) == len(rows)
    together = lambda a, b: a["s"] < b["e"] and b["s"] < a["e"] and (a["source"] != b["source"] or a["sink"] == b["sink"])
    by = collections.defaultdict(list)
    for r in got:
        by[r["k"]].append(r)
    sets = lambda own, numbers: {frozenset(r["id"] for r, n in zip(own, numbers) if n == c) for c in numbers}
    for own in by.values():
        assert sets(own, merging.anchor_clusters(own, lambda r: r["id"], together)) == sets(own, [r["cluster"] for r in own])


def test_paths_within_groups_are_those_of_joins(spark, monkeypatch):
    """Groups closed in one step give what joins give: cycles, branches, edges given twice, null nodes and groups, and a group that is too large for one step. Small groups need no rounds."""
    import random

    from siftstone.operators import fixpoint

    rng = random.Random(3)
    rows = [(g, f"{g}.{rng.randrange(9)}", f"{g}.{rng.randrange(9)}") for g in range(40) for _ in range(g % 12)]
    rows += [(50, f"50.{i}", f"50.{i + 1}") for i in range(7)] * 3 + [(None, "n.1", "n.2"), (None, "n.2", None), (None, None, "n.3")]
    edges = spark.createDataFrame(rows, "g int, a string, b string")
    want = sorted(map(str, fixpoint.reach(edges, "a", "b").collect()))
    for few in (15, 512):  # the group of 21 edges is joined, then closed
        monkeypatch.setattr(fixpoint, "FEW", few)
        assert sorted(map(str, fixpoint.reach(edges, "a", "b", within=["g"]).collect())) == want
    monkeypatch.setattr(fixpoint, "fixpoint", None)
    assert fixpoint.reach(edges, "a", "b", within=["g"]).count() == len(want)
