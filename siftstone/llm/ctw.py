"""Language-model scores by context-tree weighting over binary-decomposed bytes.

The text that is scored: words (A-Z lower-cased) joined by single blanks, then one line feed as its end; the bytes before
its start count as line feeds. Each byte is eight binary decisions, most significant first; a decision has a node (the bits
of its byte before it) and DEPTH + 1 contexts, the last 0 to DEPTH bytes. In each context and node the training texts leave
counts of zeros and ones, so a block probability of Krichevsky and Trofimov, P_e. Weighting runs from the deepest contexts
to the root, P_w = (P_e + product of the children's P_w) / 2, and P_w = P_e at DEPTH; the share of P_e / 2 in P_w is what the
training texts say about stopping at this context. A decision's probability mixes the estimates (ones + 1/2) / (n + 1) of
all its contexts by these shares, from the deepest to the root; an unseen context says 1/2.

How it is spread. The probability of a byte depends on its last DEPTH + 1 bytes alone (a gram). Each task cuts its documents
into slices of about SLICE bytes and counts each slice's distinct grams and words. A gram is a number whose first digit is
the nearest context byte, so every context is a range of numbers. Ranges of about equal content, cut anywhere by a sample of
grams, go to one task each: however hot a context is, it is cut deeper. A context that a cut goes through has parts in
several tasks; a cut has DEPTH of them at most, and only their sums, at most 255 * DEPTH rows a cut, are joined by the
driver. Each range then answers each slice with the log probabilities of the slice's grams and the counts of its words, and
slices add them up by document. Grams and words of every training text are counted; words are told apart by 64-bit hashes.

Defined results: null, empty and blank texts have one token, the end; repeated rows of a doc_id are learned from and scored
each by itself; a null doc_id hashes as the empty text; other columns are ignored; without training texts every decision has
probability 1/2; an empty table gives an empty result. Texts of any length are worked on in pieces of about CHUNK bytes.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, cut, mix64, release, slices, writing
from .hashed import Cache

DEPTH = 6
FOLDS, HELD_OUT = 7, 2
#: Bytes of text of a slice, and of a piece that is worked on at once.
SLICE, CHUNK = 16 << 20, 1 << 20
#: Rows of a slice at most, however short they are.
SLICE_ROWS = 50_000
#: Bytes of text that a range of grams answers for, at most about.
RANGE = 64 << 20
#: About so many documents, and one in SHOWN_GRAMS of their grams, place the cuts between tasks; they decide the balance only.
SHOWN, SHOWN_GRAMS = 2_000, 32
END = 10
#: Key that stands for the end among word hashes.
END_KEY = 0
u64 = np.uint64
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased words as UTF-8."""
    return (text or "").encode().translate(_LOWER).split()


def grams(data: bytes, depth: int) -> np.ndarray:
    """The gram of each byte of data but the first `depth` ones: nearest context byte first, the byte itself last."""
    x = np.frombuffer(data, np.uint8)
    n = max(0, len(data) - depth)
    key = np.zeros(n, u64)
    for k in range(1, depth + 1):
        key |= x[depth - k : depth - k + n]
        np.left_shift(key, u64(8), out=key)
    key |= x[depth : depth + n]
    return key


_SMALL = 4096
_HALVES = np.r_[0.0, np.cumsum(np.log(np.arange(_SMALL) + 0.5))]
_WHOLES = np.r_[0.0, np.cumsum(np.log(np.arange(_SMALL) + 1.0))]


def _rising(table: np.ndarray, start: float, n: np.ndarray) -> np.ndarray:
    """log of start * (start + 1) ... (start + n - 1): from a table, beyond it by Stirling's series."""
    out = table[np.minimum(n, _SMALL)]
    large = np.flatnonzero(n > _SMALL)
    if len(large):
        series = lambda z: (z - 0.5) * np.log(z) - z + 1 / (12 * z) - 1 / (360 * z**3)
        out[large] = table[_SMALL] + series(n[large] + start) - series(np.array(_SMALL + start))
    return out


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural log of the block probability of Krichevsky and Trofimov."""
    return _rising(_HALVES, 0.5, zeros) + _rising(_HALVES, 0.5, ones) - _rising(_WHOLES, 1.0, zeros + ones)


def heads(sorted_keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]]) if len(sorted_keys) else np.zeros(0, np.int64)


def counted(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of each one's counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = heads(keys)
    return keys[at], np.add.reduceat(counts[order], at) if len(at) else counts[:0]


# Slices: texts, grams and words


def pieces(words: list[bytes], depth: int, most: int):
    """The scored text of the words in pieces of about `most` bytes, cut at blanks, each after its `depth` context bytes. Each is (data, number of words)."""
    lead, at, size, begun = bytes([END]) * depth, 0, 0, 0
    for at, w in enumerate(words, 1):
        size += len(w) + 1
        if size >= most and at < len(words):
            data = lead + b" ".join(words[begun:at]) + b" "
            yield data, at - begun
            lead, size, begun = data[-depth:] if depth else b"", 0, at
    yield lead + b" ".join(words[begun:]) + bytes([END]), len(words) - begun


def windows(chunk: bytes, own: np.ndarray, depth: int):
    """(places, grams) of a chunk's own bytes, window by window; own: whether each byte is scored (leads are not)."""
    for i in range(depth, len(chunk), CHUNK):
        keep = own[i : i + CHUNK]
        yield i + np.flatnonzero(keep), grams(chunk[i - depth : i + CHUNK], depth)[keep]


def own_bytes(sizes: np.ndarray, depth: int) -> np.ndarray:
    own = np.ones(int(sizes.sum()), bool)
    starts = np.cumsum(sizes) - sizes
    own[(starts[:, None] + np.arange(depth)).ravel()] = False
    return own


class Chunk:
    """Pieces of texts: bytes one after the other; of each piece the row, its size, its words and whether it is learned from."""

    def __init__(self):
        self.data, self.rows, self.sizes, self.words, self.train, self.bytes = [], [], [], [], [], 0

    def add(self, data: bytes, row: int, words: int, train: bool) -> None:
        self.data.append(data)
        self.rows.append(row)
        self.sizes.append(len(data))
        self.words.append(words)
        self.train.append(train)
        self.bytes += len(data)


def gram_counts(chunk: Chunk, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """A chunk's distinct grams with their counts in training texts."""
    sizes = np.array(chunk.sizes)
    learned, own, joined = np.repeat(np.array(chunk.train), sizes), own_bytes(sizes, depth), b"".join(chunk.data)
    keys, counts = [], []
    for at, g in windows(joined, own, depth):
        train = learned[at]
        seen = np.sort(g[train])
        first = heads(seen)
        keys += [seen[first], np.unique(g[~train])]
        counts += [np.diff(np.r_[first, len(seen)]), np.zeros(len(keys[-1]), np.int64)]
    return counted(np.concatenate(keys), np.concatenate(counts))


def word_keys(words: list[bytes], ids: Cache) -> np.ndarray:
    return np.fromiter(map(ids.__getitem__, words), u64, len(words))


def word_ids() -> Cache:
    return Cache(lambda w: xxhash.xxh64_intdigest(w) or 1)


def packed(a: np.ndarray | bytes) -> bytes:
    return pa.Codec("zstd", compression_level=3).compress(a if isinstance(a, bytes) else np.ascontiguousarray(a).tobytes(), asbytes=True)


def opened(data: bytes, n: int, kind) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind) if n else np.zeros(0, kind)


#: Steps' rows. kind: 0 grams, 1 words, 2 text; part: range of keys; slice; n: keys, or bytes; a: keys, or text; b: counts, or answers; rows, ids, sizes, words: of each piece of a text.
STEP = "kind int, part int, slice bigint, n int, a binary, b binary, rows array<int>, ids array<bigint>, sizes array<int>, words array<int>"
_NAMES = [c.split()[0] for c in STEP.split(", ")]
_KINDS = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()))


def batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], _NAMES)


def gram_parts(keys: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Where each range of cuts ends among sorted keys."""
    return np.r_[np.searchsorted(keys, cuts), len(keys)]


def word_parts(keys: np.ndarray, n: int) -> np.ndarray:
    """The same for n even ranges of hashes."""
    bounds = [(k << 64) // n for k in range(1, n)]
    return np.r_[np.searchsorted(keys, np.array(bounds, u64)), len(keys)].astype(np.int64)


def held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


def sliced(docs: DataFrame, cuts: np.ndarray, parts: int, depth: int) -> DataFrame:
    """Rows of STEP: texts, grams and words of all slices."""

    def run(batches):
        release()
        ids, task, seq = word_ids(), TaskContext.get().partitionId(), 0
        chunk, names, size = Chunk(), [], 0
        gram, word = [], []

        def text_row(piece: Chunk) -> tuple:
            data = b"".join(piece.data)
            return (2, 0, task << 20 | seq, len(data), packed(data), None, piece.rows, [names[r] for r in piece.rows], piece.sizes, piece.words)

        def blocks(kind: int, found: list, ends) -> list[tuple]:
            keys, counts = merged(found)[0]
            out, begin = [], 0
            for part, end in enumerate(ends(keys)):
                if end > begin:
                    out.append((kind, part, task << 20 | seq, int(end - begin), packed(keys[begin:end]), packed(counts[begin:end]), None, None, None, None))
                begin = end
            return out

        def merged(found: list) -> list:
            return [counted(np.concatenate([k for k, _ in found]), np.concatenate([c for _, c in found]))]

        def done() -> pa.RecordBatch:
            gram.append(gram_counts(chunk, depth))
            if len(gram) >= 6:
                gram[:] = merged(gram)
            return batch([text_row(chunk)])

        for part in slices(batches, CHUNK):
            ids.trim()
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                train, found = not held_out(doc_id), tokens(text)
                row = len(names)
                names.append(doc_id)
                keys = np.append(word_keys(found, ids), u64(END_KEY))
                word.append((keys, np.full(len(keys), int(train))))
                for data, n in pieces(found, depth, CHUNK):
                    chunk.add(data, row, n, train)
                    size += len(data)
                    if chunk.bytes >= CHUNK:
                        yield done()
                        chunk = Chunk()
                if len(word) >= 1000:
                    word = merged(word)
                if size >= SLICE or len(names) >= SLICE_ROWS:
                    if chunk.rows:
                        yield done()
                    yield batch(blocks(0, gram, lambda k: gram_parts(k, cuts)) + blocks(1, word, lambda k: word_parts(k, parts)))
                    chunk, names, size, gram, word = Chunk(), [], 0, [], []
                    seq += 1
        if names:
            if chunk.rows:
                yield done()
            yield batch(blocks(0, gram, lambda k: gram_parts(k, cuts)) + blocks(1, word, lambda k: word_parts(k, parts)))

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, STEP)


def shown(docs: DataFrame, depth: int) -> tuple[np.ndarray, int]:
    """(grams of a sample of documents, bytes of all documents as the sample has it)."""

    def run(batches):
        for part in slices(batches, CHUNK):
            for text in part.column(0).to_pylist():
                for data, _ in pieces(tokens(text), depth, CHUNK):
                    g = np.unique(grams(data, depth))
                    yield pa.record_batch([pa.array([g[mix64(g) % u64(SHOWN_GRAMS) == 0].view(np.int64)], pa.list_(pa.int64())), pa.array([len(data) - depth])], ["g", "size"])

    rows = docs.count()
    fraction = min(1.0, SHOWN / max(1, rows))
    got = docs.select("text").sample(False, fraction, 7).mapInArrow(run, "g array<bigint>, size bigint").collect()
    found = np.unique(np.concatenate([np.zeros(0, np.int64), *(np.array(r.g, np.int64) for r in got)])).astype(u64)
    return found, int(sum(r.size for r in got) / fraction)


def even_cuts(found: np.ndarray, parts: int) -> np.ndarray:
    """parts - 1 contexts at most that cut grams evenly, as grams."""
    if not len(found) or parts < 2:
        return np.zeros(0, u64)
    at = found[(np.arange(1, parts) * len(found)) // parts]
    at = np.unique(at >> u64(8) << u64(8))
    return at[at > 0]


# Trees over a range of grams


def levels(keys: np.ndarray, counts: np.ndarray, depth: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """By depth, 0 first: distinct (context, byte) and their counts."""
    out = [(keys, counts)]
    for _ in range(depth):
        keys = keys >> u64(16) << u64(8) | keys & u64(255)
        keys, counts = counted(keys, counts)
        out.append((keys, counts))
    return out[::-1]


def parted(low: int | None, high: int | None, depth: int) -> list[np.ndarray]:
    """By depth: contexts of a range that its ends cut, so that other ranges have parts of them."""
    out = []
    for d in range(depth + 1):
        width = 8 * (depth - d)
        ends = [c >> 8 for c in (low, high) if c is not None]
        out.append(np.array(sorted({e >> width for e in ends if e >> width << width != e}), u64))
    return out


class Tree:
    """What a range's grams say: for each bit of a byte and depth, the nodes with their counts and what lies below."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, low: int | None, high: int | None, depth: int):
        self.depth, self.shared = depth, parted(low, high, depth)
        found = levels(keys[counts > 0], counts[counts > 0], depth)
        #: (bit, depth) -> (nodes, ones, n, share of the node's own estimate), whole contexts only.
        self.nodes: dict[tuple[int, int], tuple] = {}
        #: (depth, bit, node, ones, n, sum of the whole children's log P_w) of contexts that other ranges share.
        self.open: list[tuple] = []
        for j in range(8):
            below = None
            for d in range(depth, -1, -1):
                k, c = found[d]
                node = k >> u64(8 - j)
                at = heads(node)
                bit = (k >> u64(7 - j) & u64(1)).astype(np.int64)
                nodes = node[at]
                ones, n = (np.add.reduceat(v, at) if len(at) else np.zeros(0, np.int64) for v in (c * bit, c))
                under = np.zeros(len(nodes))
                if below is not None and len(below[0]):
                    parents = below[0] >> u64(8 + j) << u64(j) | below[0] & u64((1 << j) - 1)
                    under = np.bincount(np.searchsorted(nodes, parents), weights=below[1], minlength=len(nodes))
                mine = ~np.isin(nodes >> u64(j), self.shared[d])
                for i in np.flatnonzero(~mine):
                    self.open.append((d, j, int(nodes[i]), int(ones[i]), int(n[i]), float(under[i])))
                nodes, ones, n, under = nodes[mine], ones[mine], n[mine], under[mine]
                weighted, share = mixed(ones, n, under, d == depth)
                self.nodes[j, d] = (nodes, ones, n, share)
                below = (nodes, weighted)

    def close(self, top: dict) -> None:
        """Take in the nodes of shared contexts, joined over all ranges."""
        for (j, d), theirs in top.items():
            use = np.isin(theirs[0] >> u64(j), self.shared[d])
            both = [np.concatenate([a, b[use]]) for a, b in zip(self.nodes[j, d], theirs)]
            order = np.argsort(both[0])
            self.nodes[j, d] = tuple(x[order] for x in both)

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """log10 of the probability of each gram's byte after its context."""
        out = np.zeros(len(keys))
        contexts, byte = keys >> u64(8), keys & u64(255)
        for j in range(8):
            one = (byte >> u64(7 - j) & u64(1)).astype(bool)
            p = np.full(len(keys), 0.5)
            for d in range(self.depth, -1, -1):
                nodes, ones, n, share = self.nodes[j, d]
                if not len(nodes):
                    continue
                wanted = contexts >> u64(8 * (self.depth - d)) << u64(j) | byte >> u64(8 - j)
                at = np.minimum(np.searchsorted(nodes, wanted), len(nodes) - 1)
                own = (ones[at] + 0.5) / (n[at] + 1)
                p = np.where(nodes[at] == wanted, share[at] * np.where(one, own, 1 - own) + (1 - share[at]) * p, p)
            out += np.log10(p)
        return out


def mixed(ones: np.ndarray, n: np.ndarray, under: np.ndarray, deepest: bool) -> tuple[np.ndarray, np.ndarray]:
    """(log P_w, share of the own estimate in it) of nodes with these counts and sums of their children's log P_w."""
    own = log_kt(n - ones, ones)
    if deepest:
        return own, np.ones(len(own))
    weighted = np.logaddexp(own, under) - math.log(2)
    return weighted, np.exp(own - math.log(2) - weighted)


def joined(rows, depth: int) -> dict:
    """Nodes of shared contexts by (bit, depth), from their sums over all ranges (depth, bit, node, ones, n, under)."""
    table = {}
    for r in rows:
        table.setdefault((r.bit, r.depth), []).append((r.node, r.ones, r.n, r.under))
    top = {}
    for j in range(8):
        below = None
        for d in range(depth - 1, -1, -1):
            got = sorted(table.get((j, d), []))
            nodes = np.array([x[0] for x in got], u64)
            ones, n = (np.array([x[i] for x in got], np.int64) for i in (1, 2))
            under = np.array([x[3] for x in got], np.float64)
            if below is not None and len(below[0]):
                parents = below[0] >> u64(8 + j) << u64(j) | below[0] & u64((1 << j) - 1)
                under += np.bincount(np.searchsorted(nodes, parents), weights=below[1], minlength=len(nodes))
            weighted, share = mixed(ones, n, under, False)
            top[j, d] = (nodes, ones, n, share)
            below = (nodes, weighted)
    return top


# Steps


class Range:
    """All blocks of one range of grams or words, from one task's rows."""

    def __init__(self, batches):
        self.part, self.blocks = None, {0: [], 1: []}
        for b in batches:
            for kind, part, name, n, keys, counts in zip(*(b.column(c).to_pylist() for c in ("kind", "part", "slice", "n", "a", "b"))):
                self.part = part
                self.blocks[kind].append((name, n, keys, counts))

    def counts(self, kind: int) -> tuple[np.ndarray, np.ndarray]:
        got = self.blocks[kind]
        if not got:
            return np.zeros(0, u64), np.zeros(0, np.int64)
        return counted(np.concatenate([opened(k, n, u64) for _, n, k, _ in got]), np.concatenate([opened(c, n, np.int64) for _, n, _, c in got]))

    def tree(self, cuts: np.ndarray, depth: int) -> tuple[np.ndarray, Tree]:
        keys, counts = self.counts(0)
        low, high = (int(cuts[i]) if 0 <= i < len(cuts) else None for i in (self.part - 1, self.part))
        return keys, Tree(keys, counts, low, high, depth)


def scored(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte) of every row of docs; depth is 6 at most."""
    spark, tables = docs.sparkSession, Tables(docs.sparkSession)
    found, size = shown(docs, depth)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // RANGE)
    cuts = even_cuts(found, parts)
    steps = tables.cut(sliced(docs, cuts, parts, depth))
    ranges = steps.filter("kind < 2").select("kind", "part", "slice", "n", "a", "b").repartitionById(parts, F.col("part"))

    def partial(batches):
        mine = Range(batches)
        rows = []
        if mine.blocks[0]:
            rows = mine.tree(cuts, depth)[1].open
        _, n = mine.counts(1)
        rows.append((-1, 0, 0, int((n > 0).sum()), int(n.sum()), 0.0))
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["depth", "bit", "node", "ones", "n", "under"])

    shares = ranges.mapInArrow(partial, "depth int, bit int, node bigint, ones bigint, n bigint, under double")
    with writing(spark):  # the blocks' shuffle goes at once: they are dealt again below
        sums = shares.groupBy("depth", "bit", "node").agg(F.sum("ones").alias("ones"), F.sum("n").alias("n"), F.sum("under").alias("under")).collect()
    known, total = next(((r.ones, r.n) for r in sums if r.depth < 0), (0, 0))
    top = spark.sparkContext.broadcast(joined([r for r in sums if r.depth >= 0], depth))

    def answered(batches):
        mine = Range(batches)
        out, held = [], 0
        for kind in (0, 1):
            if not mine.blocks[kind]:
                continue
            if kind == 0:
                keys, tree = mine.tree(cuts, depth)
                tree.close(top.value)
                values = tree.log10(keys).astype(np.float32)
            else:
                keys, values = mine.counts(1)
            for name, n, own, _ in mine.blocks[kind]:
                answer = packed(values[np.searchsorted(keys, opened(own, n, u64))])
                # A slice finds its words' keys in its texts again: hashes do not pack.
                out.append((kind, mine.part, name, n, None if kind else own, answer, None, None, None, None))
                held += n
                if held > 1 << 19:
                    yield batch(out)
                    out, held = [], 0
        if out:
            yield batch(out)

    tasks = (steps.agg(F.max(F.expr("shiftright(slice, 20)"))).first()[0] or 0) + 1
    answers = ranges.mapInArrow(answered, STEP).unionByName(steps.filter("kind = 2"))
    # Slices are numbered by task and place, so they are dealt evenly as they come.
    route = F.pmod(F.expr("shiftright(slice, 20)") + F.expr("slice & 1048575") * tasks, F.lit(parts)).cast("int")
    dealt = answers.repartitionById(parts, route).sortWithinPartitions("slice", "kind", "part")
    floor = total + known + 1

    def added(texts: list[dict], logs: tuple, counts: np.ndarray, ids: Cache) -> pa.RecordBatch:
        """A slice's rows, from its texts, the answers to its grams (keys, values) and to its words (values, in the order of the keys)."""
        pieces_of, sums = [], {}
        for r in texts:
            ids.trim()
            data, sizes = pa.decompress(r["a"], r["n"], codec="zstd", asbytes=True), np.array(r["sizes"])
            log = np.zeros(len(data))
            for at, g in windows(data, own_bytes(sizes, depth), depth):
                distinct, back = np.unique(g, return_inverse=True)
                log[at] = logs[1][np.searchsorted(logs[0], distinct)][back]
            starts = np.cumsum(sizes) - sizes
            for row, doc_id, begin, size, total_log in zip(r["rows"], r["ids"], starts.tolist(), sizes.tolist(), np.add.reduceat(log, starts).tolist()):
                text = data[begin + depth : begin + size]
                keys = word_keys(text.split(), ids)
                pieces_of.append((row, np.append(keys, u64(END_KEY)) if text[-1] == END else keys))
                old = sums.get(row, (doc_id, 0, 0.0))
                sums[row] = (doc_id, old[1] + size - depth, old[2] + total_log)
        own = np.unique(np.concatenate([k for _, k in pieces_of]))
        words = {row: (0, 0, 0.0) for row in sums}
        for row, keys in pieces_of:
            c = counts[np.searchsorted(own, keys)]
            n, n_known, base = words[row]
            words[row] = (n + len(keys), n_known + int((c > 0).sum()), base + float(np.log10((c + 1) / floor).sum()))
        out = [(doc_id, held_out(doc_id), *words[row][:2], total, words[row][2], log, n_bytes, -log / math.log10(2) / n_bytes) for row, (doc_id, n_bytes, log) in sums.items()]
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.float64())
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], [c.split()[0] for c in SCORED.split(", ")])

    def add_up(batches):
        release()
        ids, now, logs, counts, texts = word_ids(), None, [], [], []

        def done() -> pa.RecordBatch:  # ranges come in order, so their answers are those to sorted keys
            return added(texts, tuple(np.concatenate(x) for x in zip(*logs)), np.concatenate(counts), ids)

        for b in batches:
            for i in range(b.num_rows):
                r = {c: b.column(c)[i].as_py() for c in _NAMES}
                if r["slice"] != now:
                    if texts:
                        yield done()
                    now, logs, counts, texts = r["slice"], [], [], []
                if r["kind"] == 0:
                    logs.append((opened(r["a"], r["n"], u64), opened(r["b"], r["n"], np.float32)))
                elif r["kind"] == 1:
                    counts.append(opened(r["b"], r["n"], np.int64))
                else:
                    texts.append(r)
        if texts:
            yield done()

    out = cut(dealt.mapInArrow(add_up, SCORED))
    top.unpersist()
    tables.drop()
    return out


SCORED = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, n_bytes bigint, bits_per_byte double"
