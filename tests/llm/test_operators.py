"""The corpus operators against plain versions, on odd and small tables."""

import collections
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import tokenizers
from conftest import SF, compare
from llm import brute
from pyspark.sql import functions as F

from siftstone.llm import bpe, flac, licenses, lines, near, packing, quality, queries, repeats, rules, toxicity

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"word{k % 977} sep{k % 31}" for k in range(60_000))
ODD = [None, "", " \n\t ", "a", "one two", "Éa  b c d\x1ce", "the same text " * 40, "the same text " * 40, "x" * 700, "é" * 400, "ab" * 300, LONG, LONG[7:] + " end", "a\nb\n\na\nb", "😀 <|endoftext|> it's 'll x"]


def frame(spark, texts, extra=False):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    if extra:  # names that operators use inside
        for name in ("node", "rep", "sig", "bucket", "blob", "kept", "score", "n_lines", "_text", "_key", "set", "y", "tags"):
            df = df.withColumn(name, F.array(F.lit("t")) if name == "tags" else F.lit(name))
    return df


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, ODD, extra=True)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    compare(spark, name, queries.queries()[name], queries.oracle_sql()[name], SF)


def test_names():
    assert {n.split("_")[0] for n in queries.queries()} == {f"op{k}" for k in range(1, 13)} | {"pipeline"}


# 1 and 6: classifiers


def test_toxicity(spark, small, odd, empty):
    labels = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/labels.parquet")
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    model = toxicity.fitted(docs, labels)
    got = {r.doc_id: r for r in toxicity.scored(docs, model).collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got.values())
    marked = {r.doc_id: r.toxic for r in labels.collect()}
    right = [got[d].predicted == t for d, t in marked.items() if got[d].held_out]
    assert sum(right) / len(right) > 0.9
    scores = {r.doc_id: r.score for r in toxicity.scored(odd, model).collect()}
    assert len(scores) == len(ODD) and scores[0] == scores[1] and scores[6] == scores[7]
    assert toxicity.scored(empty, model).count() == 0
    # without labels, or with one class, the share decides
    none = toxicity.fitted(docs, labels.limit(0))
    assert len({r.score for r in toxicity.scored(odd, none).collect()}) == 1
    # labels of the held-out fold change nothing
    turned = labels.withColumn("toxic", F.when(toxicity.fold(F.col("doc_id")) == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fitted(docs, turned).bias == model.bias


def test_toxicity_scores_what_it_was_fitted_on():
    """A text's evidence is the sum over its buckets as the fit sees them: words that share a bucket add it once."""
    weights = np.zeros(toxicity.BUCKETS, np.float32)
    words = ["idiot", "idiotic", "idiots", "fine", "ox"]
    for w in words[:3] + words[4:]:
        weights[toxicity.word_buckets(w)] = 1
    model = toxicity.Linear(weights, 0.0)
    for text in ("", "idiot", "Idiot idiotic idiots idiots", "fine ox", " ".join(words)):
        fitted = sum(weights[b] for b, _ in toxicity.text_features(text) if b < toxicity.BUCKETS)
        assert model.evidence(model.telling(w) for w in toxicity.WORDS(text.lower())) == fitted


def test_label_model_discounts_copies():
    """Five copies of one noisy voter do not outvote three good ones."""
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.2
    good = np.stack([(y & (rng.random(4000) < 0.9)) | (rng.random(4000) < 0.02) for _ in range(3)], 1)
    noisy = ((y & (rng.random(4000) < 0.4)) | (rng.random(4000) < 0.2))[:, None].repeat(5, 1)
    n = good.sum(1)
    x = np.concatenate([good, noisy, np.stack([n == 0, n >= 2, n >= 3, n > 2, n < 0, n < 0], 1)], 1).astype(np.int8)
    post, _, weight = toxicity.label_model(x, 0.2)
    assert ((post > 0.5) == y).mean() > 0.95
    assert weight[3:8].max() < weight[:3].max()


def test_quality(spark, odd, empty):
    sf = SF.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fitted(docs, labels)
    assert list(model.thresholds) == sorted(model.thresholds)
    got = {r.doc_id: r for r in quality.rated(docs, model).select("doc_id", "expected_grade", "tail_probability", "accepted").collect()}
    marked = {r.doc_id: r.quality for r in labels.collect()}
    assert sum(got[d].accepted == (q == 1) for d, q in marked.items()) / len(marked) > 0.95
    assert all(0 <= r.expected_grade <= 2 and 0 <= r.tail_probability <= 1 for r in got.values())
    kept = quality.accepted(odd, labels)
    assert kept.columns == odd.columns and dict(kept.dtypes) == dict(odd.dtypes)
    kept.collect()
    assert quality.rated(empty, model).count() == 0


def test_ordinal_fits_ordered_grades():
    """One feature that grows with the grade: expected grades are ordered."""
    y = np.repeat([0, 1, 2], 60)
    row, b = np.arange(180), np.full(180, 7)
    v = (y + np.random.default_rng(1).normal(0, 0.1, 180)).astype(np.float32)
    model = quality.Ordinal.fit(row, b, v, y)
    expected, tail = model.grade(float(model.weights[7]) * np.array([0.0, 1.0, 2.0]))
    assert expected[0] < expected[1] < expected[2] and tail[0] < 0.5 < tail[2]


# 2: licenses


def test_license_scan(spark, odd, empty):
    apache = licenses.TEMPLATES["apache-2.0"]
    texts = [apache.upper().replace(" ", "\n"), "x " * 997 + apache + " y" * 503, " ".join(apache.split()[:4]), licenses.TEMPLATES["mit-notice"][:180], None, ""]
    got = {(r.doc_id, r.license) for r in licenses.found(frame(spark, texts)).collect()}
    assert {g for g in got if g[1] == "apache-2.0"} == {(0, "apache-2.0"), (1, "apache-2.0")}
    assert (3, "mit-notice") in got and not {d for d, _ in got} & {2, 4, 5}
    assert licenses.found(odd).count() == 0 and licenses.found(empty).count() == 0


def test_license_bands_find_every_place(spark):
    """A template at any offset of the windows is retrieved."""
    t = licenses.TEMPLATES["mit"]
    df = frame(spark, [" ".join(f"w{j}" for j in range(k)) + " " + t + " tail of other words here" for k in range(40)])
    assert licenses.found(df).filter("license = 'mit'").count() == 40


def test_license_scan_misses_no_short_template(spark):
    """Templates of one and three shingles among random neighbours, each in one place of 3,000."""
    rng = random.Random(4)
    around = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(30)))
    for name in ("mit", "cc-by-nc-4.0"):
        texts = [f"{around()} {licenses.TEMPLATES[name]} {around()}" for _ in range(3000)]
        assert licenses.found(frame(spark, texts)).filter(F.col("license") == name).count() == 3000


def test_license_scan_is_native(spark, small):
    plan = licenses.found(small)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


# 3: near-dedup


def near_rows(df, **kw):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in near.linked(df, **kw).collect()}


def test_near_dedup_odd(spark, odd, empty):
    assert near_rows(odd) == brute.components(list(enumerate(ODD)))
    assert near.linked(empty).count() == 0
    rows = near.linked(odd.unionByName(odd)).collect()
    assert len(rows) == 2 * len(ODD) and all(r.kept == (r.component_id == r.doc_id) for r in rows)


def test_near_dedup_groups(spark):
    """Chains and dense groups of near copies around a base, passages that many share, and nobody by chance."""
    rng = random.Random(2)
    words = [f"w{k}" for k in range(3000)]
    base, passage, texts = rng.choices(words, k=150), rng.choices(words, k=90), []
    for _ in range(260):
        t = list(base)
        for _ in range(rng.choice([1, 2, 4, 6, 8])):
            t[rng.randrange(len(t))] = rng.choice(words)
        texts.append(" ".join(t))
    texts += [" ".join(rng.choices(words, k=60) + passage) for _ in range(200)]
    for _ in range(60):
        base = list(base)
        base[rng.randrange(150)] = rng.choice(words)
        texts.append(" ".join(base))
    rng.shuffle(texts)
    assert near_rows(frame(spark, texts)) == brute.components(list(enumerate(texts)))


def test_near_dedup_small_nodes_forced(spark, monkeypatch):
    """With tiny nodes all ways are taken: branching, differences, exhaustive."""
    monkeypatch.setattr(near, "SMALL", 3)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text").collect()]
    assert near_rows(frame(spark, [t for _, t in rows])) == brute.components([(i, t) for i, (_, t) in enumerate(rows)])


def test_one_of_each(spark, odd):
    kept = near.one_of_each(odd)
    expected = {i for i, (_, top) in brute.components(list(enumerate(ODD)), words=5, percent=80).items() if i == top}
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == expected
    loose = frame(spark, ["a b c d e f g"] * 3).withColumn("doc_id", F.when(F.col("doc_id") > 0, F.col("doc_id")))
    assert near.one_of_each(loose).count() == 2  # the row without doc_id stays


# 4: repeats


def repeat_rows(df, length=100):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in repeats.with_kept(df, length).collect()}


def test_repeats_odd(spark, odd, empty):
    assert repeat_rows(odd) == brute.kept_bytes(list(enumerate(ODD)))
    assert repeats.with_kept(empty).count() == 0


@pytest.mark.parametrize("length", [8, 100, 101])
def test_repeats_random(spark, length):
    rng = random.Random(length)
    texts = ["".join(rng.choices("ab\n", k=rng.randrange(0, 400))) for _ in range(80)]
    texts += [texts[k][rng.randrange(50) :] + texts[k + 1][: rng.randrange(300)] for k in range(0, 60, 2)]
    assert repeat_rows(frame(spark, texts), length) == brute.kept_bytes(list(enumerate(texts)), length)


def test_repeats_in_stretches(spark, monkeypatch):
    """Texts longer than a stretch are cut with overlap."""
    monkeypatch.setattr(repeats, "SLICE", 1 << 16)
    parts = repeats.stretches(np.array([1, 2]), [b"x" * 200_000, b"y" * 50], 100)
    cuts = [(i, o, len(p)) for ids, offsets, pieces in parts for i, o, p in zip(ids, offsets, pieces)]
    assert cuts[0] == (1, 0, 65536 + 99) and sum(max(0, n - 99) for i, _, n in cuts if i == 1) == 200_000 - 99


def test_repeated_rows_are_not_earlier(spark):
    text = "".join(random.Random(1).choices("abcdefgh", k=400))
    got = [(r.doc_id, r.n_removed) for r in repeats.with_kept(spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id bigint, text string")).collect()]
    assert sorted(got) == [(1, 0), (1, 0), (2, 400)]


def test_without_repeats_keeps_characters(spark, odd):
    out = repeats.without_repeats(odd)
    assert out.columns == odd.columns
    rows = {r.doc_id: r.text for r in out.collect()}
    assert rows[0] is None and rows[7] == "" and rows[9] == "é"
    assert len(rows) == len(ODD)


@pytest.mark.parametrize("length", [4, 8, 9, 16, 37, 100])
def test_bucket_pointer_refinement(length):
    """Buckets of windows are equal where their bytes are, for windows that lie in runs of their own."""
    rng = np.random.default_rng(length)
    runs = [rng.integers(0, 2, length - 1 + n, dtype=np.uint8) for n in rng.integers(1, 40, 60)] + [np.zeros(length + 30, np.uint8)] * 3
    data = np.concatenate(runs)
    place = np.concatenate([a + np.arange(len(r) - length + 1) for r, a in zip(runs, np.cumsum([0, *map(len, runs[:-1])]))])
    windows = [data[p : p + length].tobytes() for p in place]
    got = repeats.refined(data, place, length)
    assert len(set(zip(got.tolist(), windows))) == len(set(got.tolist())) == len(set(windows))
    assert not len(repeats.refined(np.zeros(0, np.uint8), np.zeros(0, np.int64), length))


def test_handed_through_columns(spark, odd):
    """Columns with names that operators use inside keep their values, whatever their case."""
    names = ["bucket", "BUCKET_", "kind", "blob", "accepted", "_accepted", "expected_grade", "tail_probability", "_row", "_host", "_bad", "_left", "_salt", "comp", "rep", "n_pages"]
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars", *[F.concat(F.lit(f"{n} "), F.col("doc_id").cast("string")).alias(n) for n in names])
    labels = spark.createDataFrame([(5, 1, 0), (6, 0, 1)], "doc_id bigint, quality int, toxic int")
    for out in (repeats.without_repeats(docs), near.one_of_each(docs), lines.without_boilerplate(docs, counts=()), quality.accepted(docs, labels)):
        assert out.columns[: len(docs.columns)] == docs.columns
        rows = out.collect()
        assert rows and all(r[n] == f"{n} {r.doc_id}" for r in rows for n in names)
    rows = quality.rated(docs, quality.fitted(docs, labels)).collect()
    assert len(rows) == len(ODD) and all(isinstance(r["accepted"], bool) and r["bucket"] == f"bucket {r.doc_id}" for r in rows)


def test_spark_hash(spark):
    values = [0, 1, -1, 12345678901, -(1 << 63)]
    df = spark.createDataFrame([(v,) for v in values], "x bigint").select("x", F.xxhash64("x").alias("h"))
    assert {r.x: r.h for r in df.collect()} == dict(zip(values, repeats.spark_hash(np.array(values)).tolist()))


# 5: FLAC


def test_flac_odd(spark, odd, empty):
    rows = {r.doc_id: r for r in flac.stored(odd).collect()}
    for i, t in enumerate(ODD):
        p = flac.payload(t)
        assert (rows[i].n_bytes, rows[i].payload_bytes, rows[i].payload_sha256, rows[i].tail_crc32) == (len((t or "").encode()), len(p), brute.digest(p), brute.crc(p[-32:]))
    assert rows[6][1:] == rows[7][1:] and flac.stored(empty).count() == 0


def test_flac_blocks(spark, odd):
    blocks = flac.pcm_blocks(flac.media_column(odd))
    got = collections.defaultdict(bytes)
    for r in blocks.orderBy("doc_id", "block").collect():
        assert r.sample_offset == len(got[r.doc_id]) and r.n_samples == 576
        got[r.doc_id] += bytes(r.pcm)
    assert {i: (np.frombuffer(b, np.uint8) ^ 128).tobytes() for i, b in got.items()} == {i: flac.payload(t) for i, t in enumerate(ODD)}


def test_flac_both_decoders_agree():
    rng = np.random.default_rng(4)
    payloads = [bytes(rng.integers(0, 256, 576, dtype=np.uint8)), bytes(576), b"\0\xff" * 288, (np.sin(np.arange(1728) / 9) * 100 + 128).astype(np.uint8).tobytes(), b"\xff" * 575 + b"\0"]
    for p, m in zip(payloads, flac.encode(payloads)):
        s = flac.Stream(m)
        assert flac.decode([m])[0] == flac.pcm_bytes(flac.decode_slowly(m, s), 8) == (np.frombuffer(p, np.uint8) ^ 128).tobytes()


def test_flac_damage_is_found():
    m = bytearray(flac.encode([flac.payload("some text " * 200)])[0])
    for at in (len(m) - 1, len(m) - 300, flac.Stream(bytes(m)).first + 2, 30):
        broken = bytearray(m)
        broken[at] ^= 4
        with pytest.raises(ValueError):
            flac.decode([bytes(broken)])


def test_flac_linear_prediction_and_stereo():
    """A stream made by hand: two channels as left and difference, one by sent coefficients, escaped residuals, no seek table."""
    left = [3, 5, 7, 9] + [9 + k % 3 for k in range(12)]
    right = [x - (k % 2) for k, x in enumerate(left)]
    side = [a - b for a, b in zip(left, right)]
    bits = ""
    put = lambda v, n: format(v & ((1 << n) - 1), f"0{n}b")
    bits += put(0x7FFC, 15) + put(0, 1) + put(6, 4) + put(5, 4) + put(8, 4) + put(1, 3) + put(0, 1) + put(0, 8) + put(15, 8)
    head = int(bits, 2).to_bytes(len(bits) // 8, "big")
    crc = 0
    for b in head:
        crc = int(flac.CRC8[crc ^ b])
    bits += put(crc, 8)
    order, weights, shift = 2, [3, -1], 1
    bits += put((31 + order) << 1, 8) + "".join(put(x, 8) for x in left[:2]) + put(3, 4) + put(shift, 5) + "".join(put(w, 4) for w in weights)
    residual = [left[k] - ((weights[0] * left[k - 1] + weights[1] * left[k - 2]) >> shift) for k in range(2, 16)]
    bits += put(0, 2) + put(0, 4) + put(15, 4) + put(9, 5) + "".join(put(r, 9) for r in residual)
    bits += put(1 << 1, 8) + "".join(put(x, 9) for x in side)
    bits += "0" * (-len(bits) % 8)
    body = int(bits, 2).to_bytes(len(bits) // 8, "big")
    crc = 0
    for b in body:
        crc = (crc << 8 & 0xFFFF) ^ int(flac.CRC16[crc >> 8 ^ b])
    info = struct.pack(">HH", 16, 16) + bytes(6) + (16000 << 44 | 1 << 41 | 7 << 36 | 16).to_bytes(8, "big") + bytes(16)
    media = b"fLaC\x80" + len(info).to_bytes(3, "big") + info + body + crc.to_bytes(2, "big")
    got = np.frombuffer(flac.decode([media])[0], np.int8)
    assert got[0::2].tolist() == left and got[1::2].tolist() == right


# 7: BPE


def test_bpe_odd(spark, odd, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = tokenizers.Tokenizer.from_file(path)
    rows = {r.doc_id: r for r in bpe.round_trip(odd, path).collect()}
    for i, t in enumerate(ODD):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        assert (rows[i].n_tokens, rows[i].ids_sha256) == (len(ids), brute.digest(np.array(ids, "<u4").tobytes()))
        assert rows[i].decoded_sha256 == brute.digest(tok.decode(ids, skip_special_tokens=False).encode())
    assert bpe.round_trip(empty, path).count() == 0
    back = {r.doc_id: r.text for r in bpe.decoded(bpe.encoded(odd, path), path).collect()}
    assert back == {i: t or "" for i, t in enumerate(ODD)}


def test_bpe_random():
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok, vocab, rng = tokenizers.Tokenizer.from_file(path), bpe.Vocabulary(path), random.Random(1)
    for _ in range(1500):
        t = "".join(rng.choices("ab  \n\t\x1c\x85 éÉ'sll12٣aaa<|endoftext|>　", k=rng.randrange(40)))
        assert list(memoryview(bpe.encode(vocab, [t])[0]).cast("I")) == tok.encode(t, add_special_tokens=False).ids


# 8: packing


def test_packing_odd(spark, odd, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = tokenizers.Tokenizer.from_file(path)
    rows = packing.packed(odd, path).collect()
    check_packing(rows, {i: tok.encode(t or "", add_special_tokens=False).ids + [2] for i, t in enumerate(ODD)})
    assert packing.packed(empty, path).count() == 0


def check_packing(rows, ids):
    pieces, places = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert len(own) == r.length and r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        pieces[r.doc_id].append((r.start, r.length))
        places[r.sequence_id].append((r.offset, r.length))
    for i, own in ids.items():
        assert sum(n for _, n in pieces[i]) == len(own) and all(a + n == b for (a, n), (b, _) in zip(sorted(pieces[i]), [*sorted(pieces[i])[1:], (len(own), 0)]))
    for p in places.values():
        p = sorted(p)
        assert p[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(p, p[1:])) and sum(p[-1]) <= packing.WINDOW


def test_packing_plan():
    rng = np.random.default_rng(5)
    h = np.bincount(np.minimum(4096, rng.gamma(2, 400, 200_000).astype(int) + 1), minlength=4097)
    used, sequences, tokens = np.zeros(4097, np.int64), 0, int((h * np.arange(4097)).sum())
    for combo, n in packing.plan(h):
        assert sum(combo) <= 4096 and n > 0
        sequences += n
        for v in combo:
            used[v] += n
    assert (used == h).all() and tokens / (sequences * 4096) > 0.99
    assert packing.plan(np.zeros(4097, np.int64)) == []


def test_least_squares_is_not_negative():
    h = np.zeros(4097)
    h[[1000, 3096, 2048]] = [10, 4, 6]
    combos = packing.combinations(h.astype(np.int64))
    x = packing.least_squares(h, combos)
    assert (x >= 0).all() and x[combos.index((3096, 1000))] == pytest.approx(4, abs=3.5) and x[combos.index((2048, 2048))] == pytest.approx(3, abs=0.1)


def test_tokens_random():
    path = public_tokenizers.path("word_bpe_49k.json")
    tok, rng = packing.Tokens(path), random.Random(2)
    for _ in range(1500):
        t = "".join(rng.choices("ab  \n\t\x1c\x85 éÉİKΣς'sll12.,!́A<|endoftext|>", k=rng.randrange(30)))
        assert tok.encode([t])[0] == np.array(tok.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_tokens_signs_and_forgetting(monkeypatch):
    """Signs after letters, texts in one batch, and a memory that is emptied at every step."""
    monkeypatch.setattr(packing, "REMEMBERED", 20)
    path = public_tokenizers.path("word_bpe_49k.json")
    tok, rng = packing.Tokens(path), random.Random(3)
    words = ["it", "It's", "don't", "a'", "x_y", "ß", "Ünder", "été", "42", "e\u0301", "naïve", "<|endoftext|>", "…", "\u00a0", "I'LL", "日本"]
    for _ in range(120):
        texts = [rng.choice([None, "", " "])] + ["".join(rng.choice(words) + "".join(rng.choices(".,;:!?*&#$%()[]{}<>|~^`\"'\\/@-_+=", k=rng.randrange(4))) + rng.choice([" ", "\n", "\t", ""]) for _ in range(12)) for _ in range(5)]
        assert tok.encode(texts) == [np.array(tok.tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


# 9: line dedup


def test_line_dedup(spark, odd, empty):
    rows = [(i, f"own {i}\nmenu\n\nmenu\n{'rare' if i == 3 else 'x' + str(i)}", "h" if i < 60 else None) for i in range(120)] + [(200, None, "h"), (201, "menu", "other"), (202, "", "h")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    for limit in (0, 1 << 20):  # salted, broadcast
        got = {r.doc_id: r for r in lines.without_boilerplate(df, broadcast_bytes=limit).collect()}
        assert len(got) == 123 and got[3].text == "own 3\n\nrare" and (got[3].n_lines, got[3].n_dropped) == (5, 2) and got[70].n_dropped == 2
        assert got[200].text is None and got[200].n_lines == 0 and got[201].text == "menu" and got[202].text == ""
    crlf = spark.createDataFrame([(i, f"own {i}\r\n\r\n\t\r\nmenu\r\nend {i}", "h") for i in range(60)], "doc_id bigint, text string, source string")
    assert all(r.text == f"own {r.doc_id}\r\n\r\n\t\r\nend {r.doc_id}" for r in lines.without_boilerplate(crlf).collect())
    few = spark.createDataFrame([(i, f"own {i}\nmenu", "h" if i < 8 else "i") for i in range(15)], "doc_id bigint, text string, source string")
    assert [r.n_dropped for r in lines.without_boilerplate(few).collect()] == [1] * 15  # small hosts too
    one = spark.createDataFrame([(1, "alone\nmenu", "h"), (2, "alone\nmenu", "h"), (None, "alone\nmenu", "h")], "doc_id bigint, text string, source string")
    assert [r.n_dropped for r in lines.without_boilerplate(one).collect()] == [0] * 3  # one page, whatever its copies
    out = lines.without_boilerplate(odd)
    assert out.count() == len(ODD) and set(odd.columns) <= {*out.columns}
    assert lines.without_boilerplate(empty).count() == 0
    plan = lines.without_boilerplate(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_line_dedup_keeps_pages_that_are_copied(spark):
    """A host of 100 pages, eight of them copies of one article: nothing of it goes."""
    rows = [(i, "the article\nand its end" if i < 8 else f"own {i}\nmore {i}", "h") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    assert lines.without_boilerplate(df).agg(F.sum("n_dropped")).first()[0] == 0


def test_line_dedup_by_ratio_on_a_large_host(spark, tmp_path):
    """On 1,000 pages a line stays on 70 and goes from 71; with SQL, where many lines go."""
    rows = [(i, "\n".join([f"own {i}", *(["edge"] if i < 70 else []), *(["over"] if i < 71 else []), "all"]), "h") for i in range(1000)]
    rows += [(2000 + i, rows[i % 1000][1], "h") for i in range(500)] + [(3000 + i, f"a {i % 9}\nb {i % 4}\n \nc", "i" if i % 3 else None) for i in range(90)] + [(4000, None, "h"), (4001, "", "h")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r.doc_id: r.text for r in lines.without_boilerplate(df).collect()}
    assert got[0] == "own 0\nedge" and got[70] == "own 70" and got[2000] == got[0] and got[4000] is None
    df.coalesce(1).write.parquet(f"{tmp_path}/written")
    next((tmp_path / "written").glob("*.parquet")).rename(tmp_path / "documents.parquet")
    assert compare(spark, "op9_line_dedup", queries.op9_line_dedup, queries.oracle_sql()["op9_line_dedup"], str(tmp_path)) == len(rows)


# 10: rules


def test_rules_odd(spark, odd, empty):
    for r in rules.judged(odd).collect():
        assert tuple(r)[1:7] == brute.rule_figures(ODD[r.doc_id]), r.doc_id
    assert rules.judged(empty).count() == 0


def test_rules_whole_table(spark, small):
    texts = {r.doc_id: r.text for r in small.collect()}
    base = {r.doc_id: r for r in rules.judged(small).collect()}
    assert all(tuple(r)[1:7] == brute.rule_figures(texts[i]) for i, r in base.items())
    for order in (sorted(rules.RULES), sorted(rules.RULES, reverse=True)):
        assert {r.doc_id: r.kept for r in rules.judged(small, order).collect()} == {i: r.kept for i, r in base.items()}


def test_cascade_order():
    figures = dict.fromkeys(rules.RULES, (1e-3, 0.0)) | {"same_lines": (1e-3, 0.5), "few_letters": (1e-4, 0.1), "mostly_upper": (1e-5, 0.001)}
    assert rules.cascade(figures)[:3] == ["few_letters", "same_lines", "mostly_upper"]


# the pipeline


def test_pipeline_of_nothing_and_clashing_names(spark, odd, empty):
    """Every stage on an empty table, and on odd texts with columns that operators use inside."""
    import corpus_pipeline as p

    sf = SF.replace("0.001", "0.01")
    for docs in (empty, odd.withColumn("_row", F.concat(F.lit("r"), F.col("doc_id").cast("string")))):
        n, extra = docs.count(), "_row" in docs.columns
        for _, stage in p.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
            rows = out.collect()
            assert len(rows) <= n and not (extra and any(r._row != f"r{r.doc_id}" or r.bucket != "bucket" or r.kept != "kept" for r in rows))
        assert (p.STAGES[-1][1](spark, docs, sf).count() > 0) == (n > 0)


def test_pipeline(spark):
    import corpus_pipeline as p

    sf = SF.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    counts = [docs.count()]
    for name, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns, name
        docs = p.cut(docs)
        counts.append(docs.count())
    assert counts[0] > counts[1] == counts[2] > counts[3] == counts[4]
    assert docs.filter("n_chars <> length(text)").count() == 0
    texts = {r.doc_id: r.text for r in docs.collect()}

    tok = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = p.STAGES[-1][1](spark, docs, sf).collect()
    check_packing(rows, {i: tok.encode(t or "", add_special_tokens=False).ids + [2] for i, t in texts.items()})
