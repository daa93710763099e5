"""Exact removal of repeated byte strings by bucket-pointer refinement.

A byte goes if a window of LENGTH bytes covers it that also starts earlier (smaller doc_id, or same document and earlier
start). Sorting all suffixes of the corpus would move many times its size, so positions are bucketed in steps, and only
what may still repeat is refined:

1. Units. The windows of a text fall into units: runs of windows with the same anchor, the place of the least q-gram hash
   in the window (q = LENGTH / 2). Equal windows have equal anchors, so a window can only repeat where the q-gram at its
   anchor repeats: that q-gram is the initial bucket. A unit also has the hash of all bytes its windows cover. Where the
   whole unit stands elsewhere, all but its first place are repeats at once. Buckets with one unit hold no repeat.
2. Refinement. First units in buckets with differing units are sent, with the bytes that their windows cover, to a bucket of
   their anchor's hash; equal windows meet there. Its positions are put into initial buckets by their q-gram (GRAM bytes, as
   they stand), and the buckets are refined in rounds: positions of a bucket are sorted on the bucket identifiers (pointers)
   at a later offset, the new identifiers are written back, and the next round points at these. As much as is settled is the
   next offset, so it doubles until it covers the window; a position alone in its bucket is not looked at again. The first
   window of each final bucket stays, the others are repeats.

Every step sums up before it shuffles: a slice of texts sends each unit once, so a passage that a third of all texts share
costs a row a slice; only units at its edges, whose windows reach into text of their own, go one by one. Units travel as
packed arrays, one a slice and bucket; the number of buckets grows with the bytes of the corpus, and so does that of the
partitions. Texts move once (both uses read the same exchange), positions of unrepeated text not at all. Windows are
compared byte by byte; whole units are held equal by 96 bits of two hashes (two differing ones of 10 ** 12 are with a
probability of 6e-6).

Defined results: null texts are empty; texts under LENGTH bytes keep all bytes; very long texts are worked on whole, in
stretches; a null doc_id comes first; rows that share a doc_id share their spans, cut at their length, and none of them is
earlier than another; ties cannot be otherwise; other columns, whatever their names, pass through without_repeats() as
they are; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.functions.arrow import arrow_schema, ddl_of

from .common import fresh, mix64, release, slices

LENGTH = 100
#: Bytes of text that are looked at together, and for each bucket.
SLICE, BUCKET = 1 << 21, 6 << 20
u64 = np.uint64
_NULL = -(1 << 63)

_BYTES = mix64(np.arange(1, 257) * 0x9E3779B9)
_BASE = 0x9E3779B97F4A7C15 & ~7 | 5
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS[:] = [np.multiply.accumulate(np.r_[u64(1), np.full(n - 1, base, u64)]) for base in (_BASE, _INVERSE)]
    return _POWERS[0][:n], _POWERS[1][:n]


def spark_hash(x: np.ndarray) -> np.ndarray:
    """xxhash64 of 8-byte integers with seed 42, as Spark has it (fixed values: its primes)."""
    p1, p2, p3, p4, p5 = (u64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda v, n: v << u64(n) | v >> u64(64 - n)
    h = (u64(42) + p5 + u64(8)) ^ turn(x.astype(np.int64).view(u64) * p2, 31) * p1
    h = turn(h, 27) * p1 + p4
    h = (h ^ h >> u64(33)) * p2
    h = (h ^ h >> u64(29)) * p3
    return (h ^ h >> u64(32)).view(np.int64)


class Stretch:
    """Texts laid end to end, with prefix hashes: the hash of any substring takes two look-ups."""

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        up, self.down = powers(len(self.data) + 1)
        self.sums = np.zeros(len(self.data) + 1, u64)
        np.cumsum(_BYTES[self.data] * up[:-1], out=self.sums[1:])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.down[start])

    def anchors(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(least q-gram hash, text) of the window at each position; the hash's last 16 bits are its place's, which parts equal ones."""
        q = length // 2
        n = len(self.data) - length + 1
        if n <= 0:
            return np.zeros(0, u64), np.zeros(0, np.int64)
        gram = mix64((self.sums[q:] - self.sums[:-q]) * self.down[: len(self.sums) - q])
        text = np.repeat(np.arange(len(self.sizes)), self.sizes)
        place = (np.arange(len(gram)) - self.starts[text[: len(gram)]]).astype(u64)
        least = (gram & ~u64(0xFFFF)) | (place & u64(0xFFFF))
        width, span = 1, length - q + 1
        while 2 * width <= span:
            least = np.minimum(least[: len(least) - width], least[width:])
            width *= 2
        if width < span:
            least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
        return least[:n], text[:n]

    def units(self, length: int) -> tuple[np.ndarray, ...]:
        """(text, start in the stretch, windows, bucket, content hash) of every unit."""
        least, text = self.anchors(length)
        n = len(least)
        if not n:
            return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, u64),) * 2
        valid = np.arange(n) + length <= self.ends[text]
        change = np.flatnonzero(np.r_[True, (least[1:] != least[:-1]) | (text[1:] != text[:-1]) | (valid[1:] != valid[:-1])])
        count = np.diff(np.r_[change, n])
        keep = valid[change]
        start, count = change[keep], count[keep]
        content = self.hashes(start, start + count + (length - 1)) ^ mix64(count.astype(u64))
        return text[start], start, count, least[start] >> u64(16), content >> u64(16)


def first_of(keys: list[np.ndarray], order: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(places in sorted order, whether each is the first of its keys); within equal keys the order columns decide, the most telling one last. Equal order, as of repeated rows, is first together."""
    at = np.lexsort([*order, *keys])
    new = np.zeros(len(at), bool)
    if not len(at):
        return at, new
    new[0] = True
    for k in keys:
        new[1:] |= k[at[1:]] != k[at[:-1]]
    apart = new.copy()
    for k in order:
        apart[1:] |= k[at[1:]] != k[at[:-1]]
    return at, new[np.maximum.accumulate(np.where(apart, np.arange(len(at)), 0))]


def pack(*arrays: np.ndarray) -> bytes:
    return len(arrays[0]).to_bytes(4, "little") + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def unpack(blobs: list[bytes], kinds: list[str]) -> list[np.ndarray]:
    parts: list[list[np.ndarray]] = [[] for _ in kinds]
    for blob in blobs:
        n, at = int.from_bytes(blob[:4], "little"), 4
        for part, kind in zip(parts, kinds):
            size = n * np.dtype(kind).itemsize
            part.append(np.frombuffer(blob, kind, n, at))
            at += size
    return [np.concatenate(p) if p else np.zeros(0, k) for p, k in zip(parts, kinds)]


def planes(x: np.ndarray, n: int) -> bytes:
    """The lower n bytes of each number, one byte plane after the other: what is alike stands together and is compressed."""
    return np.ascontiguousarray(x.astype(np.int64) if x.dtype != u64 else x).view(np.uint8).reshape(-1, 8)[:, :n].T.tobytes()


def numbers(blob: bytes, at: int, n: int, size: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :size] = np.frombuffer(blob, np.uint8, n * size, at).reshape(size, n).T
    return out.view(u64).ravel()


def place_blob(doc: np.ndarray, start: np.ndarray, *more: tuple[np.ndarray, int]) -> bytes:
    """Places in the order of doc_id and start, with further numbers of so many bytes each."""
    order = np.lexsort([start, doc])
    docs, which = np.unique(doc, return_inverse=True)
    head = np.array([len(docs), len(doc)], np.int64).tobytes() + docs.astype(np.int64).tobytes()
    return head + b"".join(planes(x[order], n) for x, n in ((which, 4), (start, 4), *more))


def place_arrays(blobs: list[bytes], sizes: list[int]) -> list[np.ndarray]:
    """doc_id, start and further numbers of place_blob()s."""
    out = [[np.zeros(0, np.int64), np.zeros(0, np.int64), *[np.zeros(0, u64)] * len(sizes)]]
    for blob in blobs:
        d, n = np.frombuffer(blob, np.int64, 2).tolist()
        docs, at, row = np.frombuffer(blob, np.int64, d, 16), 16 + 8 * d, []
        for size in (4, 4, *sizes):
            row.append(numbers(blob, at, n, size))
            at += n * size
        out.append([docs[row[0].astype(np.int64)], row[1].astype(np.int64), *row[2:]])
    return [np.concatenate(c) for c in zip(*out)]


#: Bytes of a unit's windows, flag, bucket and content hash.
UNIT = [1, 1, 6, 6]
#: Bytes of the q-gram that names an initial bucket.
GRAM = 8


#: Spans of a document: doc_id, first window, windows, and whether they are known to repeat (1) or to be refined (0).
SPAN = ["i8", "u4", "u1", "u1"]


def by_bucket(bucket: np.ndarray, *columns: np.ndarray):
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0]) if len(order) else []
    for a, b in zip(cuts, np.r_[cuts[1:], len(order)].astype(int) if len(order) else []):
        at = order[a:b]
        yield int(bucket[at[0]]), tuple(c[at] for c in columns)


def span_rows(n_buckets: int, doc, start, count, known) -> list[tuple]:
    order = np.lexsort([start, doc])
    doc, start, count, known = doc[order], start[order], count[order], known[order]
    return [(1, b, pack(d.astype("i8"), s.astype("u4"), c.astype("u1"), k.astype("u1"))) for b, (d, s, c, k) in by_bucket(np.mod(spark_hash(doc), n_buckets), doc, start, count, known)]


def record(rows: list[tuple]) -> pa.RecordBatch:
    kind, bucket, blob = zip(*rows) if rows else ((), (), ())
    return pa.record_batch([pa.array(kind, pa.int32()), pa.array(bucket, pa.int64()), pa.array(blob, pa.binary())], ["kind", "bucket", "blob"])


ROWS = "kind int, bucket bigint, blob binary"


def texts_of(ids: pa.Array, texts: pa.Array) -> tuple[np.ndarray, list[bytes]]:
    doc = ids.fill_null(_NULL).to_numpy(zero_copy_only=False).astype(np.int64)
    return doc, [(t or "").encode() for t in texts.to_pylist()]


def stretches(doc: np.ndarray, texts: list[bytes], length: int):
    """(doc_ids, offsets of the pieces in their texts, pieces): pieces of SLICE bytes that overlap by length - 1, so each window lies in one piece."""
    ids, offsets, pieces, size = [], [], [], 0
    for d, t in zip(doc, texts):
        for a in range(0, max(1, len(t) - length + 1), SLICE):
            piece = t[a : a + SLICE + length - 1]
            if size and size + len(piece) > SLICE + length:
                yield np.array(ids), np.array(offsets), pieces
                ids, offsets, pieces, size = [], [], [], 0
            ids.append(d)
            offsets.append(a)
            pieces.append(piece)
            size += len(piece)
    if ids:
        yield np.array(ids), np.array(offsets), pieces


def find_units(docs: DataFrame, n_buckets: int, length: int) -> DataFrame:
    def run(batches):
        release()
        for part in slices(batches, SLICE):
            for ids, offsets, pieces in stretches(*texts_of(part.column(0), part.column(1)), length):
                stretch = Stretch(pieces)
                text, at, count, bucket, content = stretch.units(length)
                if not len(text):
                    continue
                start, doc = at - stretch.starts[text] + offsets[text], ids[text]
                order, first = first_of([content, bucket], [start, doc])
                # Within this slice: later places of a unit are repeats; buckets with differing units are refined without a look elsewhere.
                b = bucket[order]
                left, again = order[first], order[~first]
                b = bucket[left]
                same = np.r_[False, b[1:] == b[:-1]]
                mixed = same | np.r_[same[1:], False]
                lead = mixed & ~same
                rows = span_rows(n_buckets, doc[again], start[again], count[again], np.ones(len(again)))
                rest = left[mixed]
                rows += span_rows(n_buckets, doc[rest], start[rest], count[rest], np.zeros(len(rest)))
                sent, flag = left[~mixed | lead], lead[~mixed | lead]
                to = (bucket[sent] % u64(n_buckets)).astype(np.int64)
                rows += [(0, k, place_blob(c[0], c[1], *zip(c[2:], UNIT))) for k, c in by_bucket(to, doc[sent], start[sent], count[sent], flag, bucket[sent], content[sent])]
                yield record(rows)

    return docs.select("doc_id", "text").mapInArrow(run, ROWS)


def settle_units(rows: DataFrame, n_buckets: int) -> DataFrame:
    def run(batches):
        held: dict[int, list[bytes]] = {}
        for part in batches:
            kind = part.column("kind").to_numpy()
            passing = part.filter(pa.array(kind == 1))
            if passing.num_rows:
                yield passing
            for k, b, blob in zip(kind.tolist(), part.column("bucket").to_pylist(), part.column("blob").to_pylist()):
                if k == 0:
                    held.setdefault(b, []).append(blob)
        for b in list(held):
            doc, start, count, mixed, bucket, content = place_arrays(held.pop(b), UNIT)
            order, first = first_of([content, bucket], [start, doc])
            again = order[~first & (mixed[order] == 0)]
            out = span_rows(n_buckets, doc[again], start[again], count[again], np.ones(len(again)))
            # A bucket is refined if it holds two differing units, or if a slice has found it to.
            left = order[first]
            names, which, n = np.unique(bucket[left], return_inverse=True, return_counts=True)
            refine = n > 1
            refine[np.searchsorted(names, bucket[mixed == 1])] = True
            rest = left[refine[which] & (mixed[left] == 0)]
            out += span_rows(n_buckets, doc[rest], start[rest], count[rest], np.zeros(len(rest)))
            if out:
                yield record(out)

    return rows.repartition(n_buckets, "kind", "bucket").mapInArrow(run, ROWS)


def refined(data: np.ndarray, place: np.ndarray, length: int) -> np.ndarray:
    """A bucket for the window of `length` bytes at each place of data: equal buckets, equal bytes.

    Starts with the q-gram at every position and doubles what the buckets tell apart, by the buckets of later offsets.
    """
    known = min(GRAM, length)
    bucket = np.zeros(len(data), u64)
    if not len(place):
        return bucket[place]
    # Positions that a window's later offsets point at.
    reach = np.zeros(len(data) + 1, np.int32)
    np.add.at(reach, place, 1)
    np.add.at(reach, place + length - known + 1, -1)
    needed = np.flatnonzero(np.cumsum(reach[:-1]) > 0)
    first = needed[np.r_[True, np.diff(needed) != 1]]
    end = needed[np.r_[np.diff(needed) != 1, True]]
    gram = np.zeros(len(needed), u64)
    for i in range(known):
        gram = gram << u64(8) | data[needed + i].astype(u64)
    bucket[needed], used = numbered(gram), len(needed)
    while known < length:
        step = min(known, length - known)
        # A position has a pointer if that lies in its own run, which gets shorter by as much.
        end = end - step
        size = np.maximum(0, end - first + 1)
        needed = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        shared = needed[np.bincount(bucket[needed].view(np.int64), minlength=1)[bucket[needed]] > 1]
        bucket[shared] = numbered(bucket[shared] << u64(32) | bucket[shared + step]) + u64(used)
        used += len(shared)
        known += step
    return bucket[place]


def numbered(keys: np.ndarray) -> np.ndarray:
    """0, 1, ... for equal keys, by sorting."""
    order = np.argsort(keys)
    out = np.empty(len(keys), u64)
    if len(keys):
        sorted_keys = keys[order]
        out[order] = np.cumsum(np.r_[False, sorted_keys[1:] != sorted_keys[:-1]]).astype(u64)
    return out


def runs(doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows as (doc, first window, windows) of runs of up to 255."""
    order = np.lexsort([start, doc])
    doc, start = doc[order], start[order]
    if not len(doc):
        return doc, start, start
    new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)])
    size = np.diff(np.r_[new, len(doc)])
    parts = -(-size // 255)
    which = np.repeat(np.arange(len(new)), parts)
    step = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
    return doc[new][which], start[new][which] + 255 * step, np.minimum(255, size[which] - 255 * step)


def find_windows(texts: DataFrame, spans: DataFrame, key: str, n_buckets: int, length: int) -> DataFrame:
    """Known repeats by document, and units to refine, with their bytes, by anchor."""

    def run(_, left, right):
        doc, start, count, known = unpack(right.column("blob").to_pylist(), SPAN)
        sure = known == 1
        rows = span_rows(n_buckets, doc[sure], start[sure], count[sure], known[sure])
        ask = np.flatnonzero(~sure)
        ask = ask[np.lexsort([start[ask], doc[ask]])]
        asked = doc[ask]
        batches = left.select(["doc_id", "text"]).combine_chunks().to_batches() if len(ask) else []
        for part in slices(iter(batches), SLICE):
            ids, data = texts_of(part.column(0), part.column(1))
            wanted = np.isin(ids, asked)
            ids, data = ids[wanted], [t for t, w in zip(data, wanted) if w]
            for own, offset, pieces in stretches(ids, data, length):
                stretch = Stretch(pieces)
                least, _ = stretch.anchors(length)
                d, p, at, n = [], [], [], []
                for i, (one, shift) in enumerate(zip(own, offset)):
                    mine = ask[np.searchsorted(asked, one, side="left") : np.searchsorted(asked, one, side="right")]
                    # Of each unit, the windows that begin in this piece.
                    first = np.maximum(start[mine].astype(np.int64), shift)
                    last = np.minimum(start[mine].astype(np.int64) + count[mine], min(shift + SLICE, shift + len(pieces[i]) - length + 1))
                    here = last > first
                    first, last = first[here], last[here]
                    d.append(np.full(len(first), one))
                    p.append(first)
                    at.append(first - shift + stretch.starts[i])
                    n.append(last - first)
                d, p, at, n = (np.concatenate(x) for x in (d, p, at, n))
                if not len(d):
                    continue
                to = ((least[at] >> u64(16)) % u64(n_buckets)).astype(np.int64)
                whole = stretch.data.tobytes()
                for k, (x, y, z, a) in by_bucket(to, d, p, n, at):
                    rows.append((0, k, pack(x.astype("i8"), y.astype("u4"), z.astype("u1")) + b"".join([whole[i:j] for i, j in zip(a.tolist(), (a + z + (length - 1)).tolist())])))
        return pa.Table.from_batches([record(rows)])

    return texts.groupBy(key).cogroup(spans.repartition(n_buckets, "bucket").groupBy("bucket")).applyInArrow(run, ROWS)


def settle_windows(rows: DataFrame, n_buckets: int, length: int) -> DataFrame:
    """Windows that have an equal one before them, from the units of each anchor."""

    def run(batches):
        release()
        held: dict[int, list[bytes]] = {}
        for part in batches:
            kind = part.column("kind").to_numpy()
            passing = part.filter(pa.array(kind == 1))
            if passing.num_rows:
                yield passing
            for k, b, blob in zip(kind.tolist(), part.column("bucket").to_pylist(), part.column("blob").to_pylist()):
                if k == 0:
                    held.setdefault(b, []).append(blob)
        for b in list(held):
            blobs = held.pop(b)
            doc, start, count = unpack(blobs, SPAN[:3])
            head = sum(np.dtype(k).itemsize for k in SPAN[:3])
            data = np.frombuffer(b"".join([x[4 + head * int.from_bytes(x[:4], "little") :] for x in blobs]), np.uint8)
            count = count.astype(np.int64)
            begin = np.cumsum(count + (length - 1)) - count - (length - 1)
            step = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            doc, start = np.repeat(doc, count), np.repeat(start.astype(np.int64), count) + step
            bucket = refined(data, np.repeat(begin, count) + step, length)
            at, first = first_of([bucket], [start, doc])
            again = at[~first]
            x, y, z = runs(doc[again], start[again])
            out = span_rows(n_buckets, x, y, z, np.ones(len(x)))
            if out:
                yield record(out)

    return rows.repartition(n_buckets, "kind", "bucket").mapInArrow(run, ROWS)


def removed_bytes(n: int, start: np.ndarray, count: np.ndarray, length: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, np.minimum(start, n), 1)
    np.add.at(edge, np.minimum(start + count + (length - 1), n), -1)
    return np.cumsum(edge[:n]) > 0


def removals(docs: DataFrame, length: int) -> tuple[DataFrame, DataFrame, str]:
    """(docs with a column of their bucket, packed spans of repeated windows by bucket, that column's name)."""
    if length < 4 or length > 250:
        raise ValueError("windows of 4 to 250 bytes")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET))
    key = fresh("bucket", docs.columns)
    value = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(_NULL))), F.lit(n_buckets).cast("bigint"))
    texts = docs.select(*[F.col(f"`{c}`") for c in docs.columns], value.alias(key)).repartition(n_buckets, key)
    spans = settle_units(find_units(docs, n_buckets, length), n_buckets)
    found = settle_windows(find_windows(texts, spans, key, n_buckets, length), n_buckets, length)
    return texts, found.repartition(n_buckets, "bucket"), key


def masks(left: pa.Table, right: pa.Table, length: int):
    """(bytes, which of them go) of each text of a bucket; no mask where nothing goes."""
    doc, start, count, _ = unpack(right.column("blob").to_pylist(), SPAN)
    order = np.argsort(doc, kind="stable")
    doc, start, count = doc[order], start[order].astype(np.int64), count[order].astype(np.int64)
    ids, data = texts_of(left.column("doc_id").combine_chunks(), left.column("text").combine_chunks()) if left.num_rows else (np.zeros(0, np.int64), [])
    for t, i, j in zip(data, np.searchsorted(doc, ids, side="left"), np.searchsorted(doc, ids, side="right")):
        yield t, removed_bytes(len(t), start[i:j], count[i:j], length) if i < j else None


def with_kept(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): kept holds the remaining bytes."""
    texts, spans, bucket = removals(docs.select("doc_id", "text"), length)

    def run(key, left, right):
        rows = [(len(t), 0, 0, t) if out is None or not len(t) else (len(t), int(out.sum()), int(out[0]) + int((out[1:] & ~out[:-1]).sum()), np.frombuffer(t, np.uint8)[~out].tobytes()) for t, out in masks(left, right, length)]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.table([left.column("doc_id"), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return texts.groupBy(bucket).cogroup(spans.groupBy("bucket")).applyInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with repeated bytes taken out of text; a character stays whole if any of its bytes stays. Null texts stay null."""
    texts, spans, bucket = removals(docs, length)
    names = docs.columns
    place = names.index("text")

    def run(key, left, right):
        out = []
        for t, gone in masks(left, right, length):
            if gone is not None and len(t):
                data = np.frombuffer(t, np.uint8)
                first = np.flatnonzero(data & 0xC0 != 0x80)
                whole = np.repeat(np.minimum.reduceat(gone, first), np.diff(np.r_[first, len(t)]))
                t = data[~whole].tobytes()
            out.append(t.decode())
        null = left.column("text").combine_chunks().is_null().to_pylist() if left.num_rows else []
        texts = pa.array([None if n else t for t, n in zip(out, null)], pa.string())
        return left.select(names).set_column(place, "text", texts).cast(arrow)

    schema = ddl_of(docs.schema)
    arrow = arrow_schema(schema)
    return texts.groupBy(bucket).cogroup(spans.groupBy("bucket")).applyInArrow(run, schema)
