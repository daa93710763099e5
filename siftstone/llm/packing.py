"""Packing into windows of 4096 tokens by non-negative least squares over a length histogram.

Each document's ids (with id 2 at the end) are cut into whole windows and one rest; nothing else is cut. The histogram of
rest lengths (4096 bins, whatever the input's size) goes to the driver. There, combinations of up to three lengths that
fill a window exactly are enumerated, least squares under x >= 0 finds how often to repeat each so that together they use
up the histogram, repeat counts are rounded down within what there is, and what is left is packed greedily, longest first.
The outcome is a plan of (combination, repeats); pieces of a length take its slots in the order of (length, doc_id, start).
That order is made by a range shuffle, so a length that a third of all rows share is dealt over many tasks, and the ranks
need one count for each (length, task).

Defined results: null and empty texts are the one id 2; longer texts are tokenized whole; rows with equal doc_id and text
are packed each by itself; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, held, scaled_partitions, slices

WINDOW = 4096
END = 2
#: Words that a worker remembers; beyond that it keeps what its last slice held and what is short.
REMEMBERED, SHORT = 150_000, 6
#: Letters that neither composition nor lower-casing joins to their neighbours.
LETTERS = "^[A-Za-zÀ-ÖØ-öø-ÿ]+$"
#: ASCII signs that are a token run of their own after letters (an apostrophe may begin one that has letters).
SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Words that go to the library as one text, and texts that go at once (an encoding takes a thousand bytes or so).
TOGETHER, BATCH = 64, 64
#: Bytes of text that are looked at together.
SLICE = 4_000_000


def strings(column: pa.Array) -> list[str]:
    """What to_pylist() gives, in a tenth of its time."""
    return column.to_numpy(zero_copy_only=False).tolist()


class Tokens:
    """Ids of texts by the tokenizers library, worked out once for each distinct run of characters between blanks.

    The vocabulary drops white space and its pre-tokenizer never joins what a blank parts, so a text's ids are its chunks'
    ids in order. A chunk of letters and signs after them is two runs. A word of letters is one run, whose last id is a
    word end and no other; so many new words are encoded as one text and their ids parted there.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}

    def _encoded(self, texts: list[str]) -> Iterator[np.ndarray]:
        for a in range(0, len(texts), BATCH):
            for got in self.tokenizer.encode_batch_fast(texts[a : a + BATCH], add_special_tokens=False):
                yield np.array(got.ids, np.uint32)

    def learn(self, words: list[str], others: list[str]) -> None:
        """words: of letters only."""
        if len(self.known) > REMEMBERED:
            held = {*words, *others}
            self.known = {w: ids for w, ids in self.known.items() if len(w) <= SHORT or w in held}
        words = [w for w in words if w not in self.known]
        others = [w for w in others if w not in self.known]
        groups = [words[a : a + TOGETHER] for a in range(0, len(words), TOGETHER)]
        for group, ids in zip(groups, self._encoded([" ".join(g) for g in groups])):
            cuts = [0, *((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()]
            if len(cuts) != len(group) + 1:
                raise ValueError("the vocabulary does not end each word with one word end")
            data = ids.tobytes()
            self.known.update((w, data[i:j]) for w, i, j in zip(group, cuts, cuts[1:]))
        self.known.update((w, ids.tobytes()) for w, ids in zip(others, self._encoded(others)))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        ids, bounds = self.encode_column(pa.array(texts, pa.string()))
        data, at = ids.astype("<u4").tobytes(), (4 * bounds).tolist()
        return [data[a:b] for a, b in zip(at, at[1:])]

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, where each text's begin, with the total at the end)."""
        texts = pc.fill_null(texts, "")
        # The vocabulary lower-cases anyway; only an added token's string must not come about by it.
        texts = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        parts = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        found = parts.flatten().dictionary_encode()
        chunk, which = found.dictionary, found.indices.to_numpy()
        core = pc.ascii_rtrim(chunk, SIGNS)
        plain = pc.match_substring_regex(core, LETTERS)
        core = pc.if_else(plain, core, chunk)
        words, chunks = strings(core), strings(chunk)
        tails = {c: c[len(w) :] for w, c in zip(words, chunks) if len(c) > len(w)}
        of_letters = plain.to_numpy(zero_copy_only=False).tolist()
        self.learn(list({w for w, p in zip(words, of_letters) if p}), [*{w for w, p in zip(words, of_letters) if not p}.union(tails.values())])
        known = self.known
        ids = [known[w] if len(c) == len(w) else known[w] + known[tails[c]] for w, c in zip(words, chunks)]
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        first, of = np.cumsum(size) - size, size[which]
        ends = np.cumsum(of)
        place = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first[which] - ends + of, of)
        return np.frombuffer(b"".join(ids), np.uint32)[place], np.r_[0, ends][parts.offsets.to_numpy() - parts.offsets[0].as_py()]


def tokens(path: str) -> Tokens:
    return held(("tokens", path), lambda: Tokens(path))


def pieces(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens) of every piece."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def run(batches):
        tok, end = tokens(path), END.to_bytes(4, "little")
        for part in slices(batches, SLICE):
            ids, bounds = tok.encode_column(part.column(1))
            data = memoryview(ids.astype("<u4").tobytes())
            size = np.diff(bounds) + 1
            n = -(-size // WINDOW)
            which = np.repeat(np.arange(len(n)), n)
            start = WINDOW * (np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n))
            length = np.minimum(WINDOW, size[which] - start)
            last = start + length == size[which]
            crc = [zlib.crc32(end, c) if z else c for z, a, b in zip(last, bounds[which] + start, length - last) for c in [zlib.crc32(data[4 * a : 4 * (a + b)])]]
            yield pa.record_batch([part.column(0).take(pa.array(which)), *(pa.array(x, pa.int64()) for x in (start, length, crc, size[which]))], names)

    return docs.select("doc_id", "text").mapInArrow(run, ", ".join(f"{n} bigint" for n in names))


def combinations(h: np.ndarray, each: int = 6) -> list[tuple[int, ...]]:
    """Combinations of one to three lengths with h > 0 that sum to the window; for each longest length those with the most copies."""
    out = {(WINDOW,)} if h[WINDOW] else set()
    lengths = np.flatnonzero(h)
    for a in lengths[lengths < WINDOW].tolist():
        rest = WINDOW - a
        if rest <= a and h[rest]:
            out.add((a, rest))
        b = lengths[(lengths <= a) & (2 * lengths >= rest) & (lengths < rest)]
        b = b[h[rest - b] > 0]
        if len(b):
            plenty = np.minimum(h[b], h[rest - b])
            for x in b[np.lexsort((b, -plenty))[:each]].tolist():
                out.add((a, x, rest - x))
    return sorted(out, reverse=True)


def least_squares(h: np.ndarray, combos: list[tuple[int, ...]], rounds: int = 400) -> np.ndarray:
    """x >= 0 that makes the lengths of x-fold combinations come nearest to h, by accelerated projected gradient."""
    if not combos:
        return np.zeros(0)
    col = np.repeat(np.arange(len(combos)), [len(c) for c in combos])
    row = np.array([v for c in combos for v in c])
    scale = 1 / np.sqrt(np.maximum(h, 1.0))  # relative errors, so that rare lengths count as well
    target, coefficient = h * scale, scale[row]
    forward = lambda x: np.bincount(row, coefficient * x[col], len(h))
    back = lambda r: np.bincount(col, coefficient * r[row], len(combos))
    v = np.ones(len(combos))
    for _ in range(30):
        v = back(forward(v))
        norm = np.linalg.norm(v)
        v /= norm
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - back(forward(y) - target) / (1.05 * norm))
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / s * (new - x)
        x, t = new, s
    return x


def plan(h: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(combination, repeats) that use every length of h exactly as often as it is there."""
    left = h.astype(np.int64).copy()
    combos = combinations(left)
    x = least_squares(left.astype(float), combos)
    out = []
    for c in np.lexsort((np.arange(len(combos)), -x)):
        combo = combos[c]
        n = min(int(x[c] + 1e-6), *(int(left[v]) // combo.count(v) for v in set(combo)))
        if n > 0:
            for v in combo:
                left[v] -= n
            out.append((combo, n))
    lengths = np.flatnonzero(left)
    while len(lengths):
        combo, rest, use = [], WINDOW, {}
        at = len(lengths)
        while True:
            at = min(at, int(np.searchsorted(lengths, rest, side="right")))
            while at and left[lengths[at - 1]] <= use.get(int(lengths[at - 1]), 0):
                at -= 1
            if not at:
                break
            v = int(lengths[at - 1])
            combo.append(v)
            use[v] = use.get(v, 0) + 1
            rest -= v
        n = min(int(left[v]) // k for v, k in use.items())
        for v, k in use.items():
            left[v] -= n * k
        out.append((tuple(combo), n))
        lengths = lengths[left[lengths] > 0]
    return out


def slots(made: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """For each length and run of ranks: key = length << 40 | first rank, the first sequence id, and the offset there; sorted by key."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for combo, n in made:
        offset = 0
        for v in combo:
            rows.append((v << 40 | used.get(v, 0), sequence, offset))
            used[v] = used.get(v, 0) + n
            offset += v
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 3)


def packed(docs: DataFrame, path: str) -> DataFrame:
    """Pieces with sequence_id and offset."""
    spark = docs.sparkSession
    found = cut(pieces(docs, path))
    n = scaled_partitions(spark, 500_000, found.count())
    dealt = found.repartitionByRange(n, "length", "doc_id", "start").sortWithinPartitions("length", "doc_id", "start").withColumn("task", F.spark_partition_id())

    def ranked(batches):
        last, seen = -1, 0
        for part in batches:
            if not part.num_rows:
                continue
            length = part.column(2).to_numpy()
            first = np.r_[True, length[1:] != length[:-1]]
            start = np.maximum.accumulate(np.where(first, np.arange(len(length)), 0))
            rank = np.arange(len(length)) - start
            if length[0] == last:
                rank[: int(first[1:].argmax()) + 1 if first[1:].any() else len(length)] += seen
            last, seen = int(length[-1]), int(rank[-1]) + 1
            yield pa.record_batch([*part.columns, pa.array(rank.astype(np.int64))], [*part.schema.names, "rank"])

    fields = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    numbered = cut(dealt.mapInArrow(ranked, f"{fields}, task int, rank bigint"))
    counts = numbered.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")).orderBy("length", "task").collect()
    h, before = np.zeros(WINDOW + 1, np.int64), {}
    for r in counts:
        before[r.length << 24 | r.task] = int(h[r.length])
        h[r.length] += r.n
    table = slots(plan(h))
    shared = spark.sparkContext.broadcast((table, np.array(sorted(before), np.int64), np.array([before[k] for k in sorted(before)], np.int64)))

    def placed(batches):
        table, keys, offsets = shared.value
        for part in batches:
            length, task, rank = (part.column(i).to_numpy().astype(np.int64) for i in (2, 5, 6))
            rank = rank + offsets[np.searchsorted(keys, length << 24 | task)] if len(keys) else rank
            key = length << 40 | rank
            at = np.searchsorted(table[:, 0], key, side="right") - 1
            yield pa.record_batch([*part.columns[:5], pa.array(table[at, 1] + key - table[at, 0]), pa.array(table[at, 2])], [*part.schema.names[:5], "sequence_id", "offset"])

    return numbered.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "rank").mapInArrow(placed, f"{fields}, sequence_id bigint, offset bigint")
