"""Known values in texts, by either way, against a plain search; and what a report shows of them."""

import random

import pytest
from pyspark.sql import functions as F

from siftstone.functions import text
from siftstone.operators import dictionary

TEXT = "id int, a string, b string"


def plain(rows, values):
    known = {v for v in values if v}
    return {i: sorted(v for v in known if v in (a or "") or v in (b or "")) for i, a, b in rows}


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    values = ["".join(rng.choices("abcé0-", k=rng.randrange(1, 14))) for _ in range(300)] + ["tok_" + "".join(rng.choices("0123456789abcdef", k=20)) for _ in range(60)] + ["x", "aa", "aaaaaaaaaaaaaaaa", "😀😀"]
    rows = [(0, None, None), (1, "", "tok_"), (2, "aaaaaaaaaaaaaaaaaaaa", None), (3, "q" * 50_000 + values[310], values[310]), (4, "😀😀😀", "")]
    rows += [(k, "".join(rng.choices("abcé0- \n", k=60)), rng.choice(values) + "!" if k % 3 else values[305]) for k in range(5, 120)]
    return rows + rows[:3], values


@pytest.mark.parametrize("size", [0, 1 << 20])
def test_found_equals_a_plain_search(spark, texts, size):
    rows, values = texts
    df, known = spark.createDataFrame(rows, TEXT).repartition(4), spark.createDataFrame([(v,) for v in values + values[:5] + [""]], "value string")
    got = [(r.id, r.found) for r in dictionary.with_found(df, ["a", "b"], known, broadcast_bytes=size).collect()]
    assert len(got) == len(rows)
    want = plain(rows, values)
    assert all(want[i] == found for i, found in got)


@pytest.mark.parametrize("size", [0, 1 << 20])
def test_empty_tables(spark, size):
    some, none = spark.createDataFrame([(1, "abc", None)], TEXT), spark.createDataFrame([], "value string")
    assert dictionary.with_found(some, ["a"], none, broadcast_bytes=size).first().found == []
    assert dictionary.with_found(some.limit(0), ["a", "b"], spark.createDataFrame([("abc",)], "value string"), broadcast_bytes=size).count() == 0


@pytest.mark.parametrize("size", [0, 1 << 20])
def test_redacted_by_scope(spark, size):
    rows = spark.createDataFrame([("f.py", "wide-secret-1 short tool x", None), ("g.py", "wide-secret-1 short tool x", "a short one"), (None, "nothing", None)], "path string, sink string, note string")
    value = lambda *v: spark.createDataFrame([(x,) for x in v], "value string")
    scoped = spark.createDataFrame([("f.py", "short")], "path string, value string")
    out = dictionary.redacted(rows, ["sink", "note"], value("wide-secret-1", "wide-secret"), "path", scoped, value("x"), broadcast_bytes=size)
    assert out.columns == rows.columns
    got = {r.path: (r.sink, r.note) for r in out.collect()}
    mark = text.REDACTED
    assert got == {"f.py": (f"{mark} {mark} tool {mark}", None), "g.py": (f"{mark} short tool {mark}", "a short one"), None: ("nothing", None)}


def test_a_value_in_a_third_of_all_texts(spark):
    rows = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, F.concat(F.lit("k = hot-value-77 "), F.col("id").cast("string"))).otherwise(F.col("id").cast("string")).alias("a"))
    known = spark.createDataFrame([("hot-value-77",), ("cold-value-78",)], "value string")
    assert dictionary.with_found(rows, ["a"], known, broadcast_bytes=0).filter("array_contains(found, 'hot-value-77')").count() == 2000


def test_wide(spark):
    rows = spark.createDataFrame([(v,) for v in ("letters", "onlyletters", "letters-1", "averylongwordofletters", "12345678", "été-1234", "", None)], "v string")
    assert {r.value for r in dictionary.collected(rows, F.col("v")).collect()} == {"letters-1", "averylongwordofletters", "12345678", "été-1234"}


def test_secretish(spark):
    mixed = "q7Zr2Xw9Kp4LmN8vB3tYcD"
    cases = {
        'password = "p"': 'password = "<REDACTED>"',
        "name = 'plain' # api_key: 'abc\\'d' x": "name = 'plain' # api_key: '<REDACTED>' x",
        "x = \"token = 'abc'\"": "x = \"token = 'abc'\"",
        f"f('{mixed}')": "f('<REDACTED>')",
        f"f('{'ab' * 20}')": f"f('{'ab' * 20}')",
        "no literal": "no literal",
        "token=''": "token='<REDACTED>'",
    }
    df = spark.createDataFrame(list(cases.items()) + [(None, None)], "t string, want string")
    for r in df.select("want", text.redact_secretish(F.col("t")).alias("got")).collect():
        assert r.got == r.want
    known = df.filter("t = 'no literal'").select(text.redact_secretish(F.col("t"), F.array(F.lit("lit"))))
    assert known.first()[0] == "no <REDACTED>eral"


def test_a_secret_of_one_file_shows_in_no_finding_of_another(spark, tmp_path):
    from siftstone.plans import scan

    secret = "s3cr3t-value-0042"
    (tmp_path / "settings.py").write_text(f'API_KEY = "{secret}"\nPIN = "9x9x"\npassword = "own1"\n')
    (tmp_path / "run.py").write_text(f'import os\n\n\ndef go(x):\n    os.system("curl -H {secret} own1 tool-7 " + x)\n')
    found, errors = scan.scan(spark, str(tmp_path), tool_secrets=spark.createDataFrame([("tool-7",)], "value string"))
    rows = found.collect()
    assert rows and all(secret not in str(r) and "tool-7" not in str(r) for r in rows)
    assert any("own1" in r.sink for r in rows)  # a short secret of another file stays
    assert errors.count() == 0


def test_fixes_with_secrets_go(spark):
    from siftstone.plans import remedy

    fix = spark.createDataFrame([("a.py", "1", "use it", "[]", "-x\n+y"), ("a.py", "2", "d", "[k3y-number]", ""), ("b.py", "3", "mine", "[]", ""), ("b.py", "4", "d", "[]", None)], "path string, id string, description string, edits string, diff string")
    secrets = spark.createDataFrame([(None, "k3y-number"), ("b.py", "mine"), ("c.py", "use it")], "path string, value string")
    assert {r.id for r in remedy.without_secrets(fix, secrets).collect()} == {"1", "4"}
    assert remedy.without_secrets(fix, secrets)._jdf.queryExecution().executedPlan().toString().count("NestedLoop") == 0


def test_a_text_of_very_many_literals_is_searched_once(spark):
    """Thousands of matches in one text: each is decided from one search, in bounded time."""
    import time

    t = "\n".join(f"name_{i} = 'v{i}'; token_{i} = \"w{i}\"" for i in range(6000))
    want = "\n".join(f"name_{i} = 'v{i}'; token_{i} = \"<REDACTED>\"" for i in range(6000))
    df = spark.createDataFrame([(t,)], "t string")
    begin = time.monotonic()
    assert df.select(text.redact_secretish(F.col("t"))).first()[0] == want
    assert time.monotonic() - begin < 30


def test_gram_rows_come_many_a_batch():
    """Distinct grams of each row, as numbers of their bytes, first byte highest; rows of one batch come out together."""
    import numpy as np
    import pyarrow as pa

    rows = ["abcabcabcabc", "", None, "ab", "émoji 🙂 twelve"]
    part = pa.record_batch([pa.array(list("vwxyz")), pa.array(rows)], ["row", "data"])
    out = list(dictionary._gram_rows(iter([part]), (8, 4, 2, 1), False, np.full(1 << 18, 2**64 - 1, np.uint64)))
    assert len(out) == 1
    got = {(r["row"], r["width"], r["gram"]) for r in out[0].to_pylist()}
    want = {(k, w, int.from_bytes(t[i : i + w], "big", signed=w == 8)) for k, t in zip("vwxyz", ((x or "").encode() for x in rows)) for w in (8, 4, 2, 1) for i in range(len(t) - w + 1)}
    assert got == want and out[0].num_rows == len(want)


def test_values_are_worked_out_once(spark):
    """The dictionary may come from a search of all texts: it runs once, whichever way looks the values up."""
    texts = spark.createDataFrame([(1, "one token_abcdefgh two"), (2, "none")], "id int, a string")
    for size in (0, 1 << 20):
        runs = spark.sparkContext.accumulator(0)

        def counted(batches):
            for part in batches:
                runs.add(part.num_rows)
                yield part

        values = spark.createDataFrame([("token_abcdefgh",)], "value string").mapInArrow(counted, "value string")
        found = dictionary.with_found(texts, ["a"], values, broadcast_bytes=size)
        assert {r.id: r.found for r in found.collect()} == {1: ["token_abcdefgh"], 2: []}
        assert runs.value == 1
