"""FLAC media columns: encode 8-bit samples, decode Rice residuals and linear predictors, verify frame checksums, and
write PCM blocks with seekable sample offsets.

Frames of many texts are worked on together: NumPy decodes one sample of every frame per step, so a step costs the same
for one frame and for thousands. Where frames lie is read from the SEEKTABLE block, which points at every frame. Frames
of other encoders (linear prediction with sent coefficients, several channels, escaped partitions, wasted bits, other
block sizes, no seek table) go through decode_frame(), which reads bit by bit.

Defined results: a null text is empty; the payload of an empty text is one block of padding; equal texts give equal
bytes; a stream whose header, CRC-8, CRC-16, sample count or MD5 does not hold raises ValueError, never wrong samples.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

BLOCK = 576
RATE = 16_000
#: Frames that are worked on together.
TOGETHER = 4096
#: Longest run of zeros that the encoder lets a Rice code start with; with 9 low bits it fits a 57-bit window.
LONGEST_UNARY = 40
PARAMETERS = 10
u64 = np.uint64


def crc_table(poly: int, width: int) -> np.ndarray:
    table = np.arange(256, dtype=np.uint32) << (width - 8)
    for _ in range(8):
        table = ((table << 1) ^ np.where(table >> (width - 1) & 1, poly, 0)) & ((1 << width) - 1)
    return table.astype(np.uint32)


CRC8, CRC16 = crc_table(0x07, 8), crc_table(0x8005, 16)


def crc16_rows(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-16 of data[start:start+size] for every row, one byte of each row per step."""
    order = np.argsort(-size, kind="stable")
    at, left, crc = start[order], size[order], np.zeros(len(size), np.uint32)
    live = np.searchsorted(-left, -np.arange(left[0] if len(left) else 0), side="left")
    for j, n in enumerate(live):
        c = crc[:n]
        crc[:n] = ((c << 8) & 0xFFFF) ^ CRC16[(c >> 8) ^ data[at[:n] + j]]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def coded_number(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers in FLAC's UTF-8-like code, as (value, bits); numbers below 2**26."""
    n = n.astype(u64)
    low = lambda k: (n >> u64(6 * k)) & u64(63) | u64(128)
    two = (u64(0xC0) | n >> u64(6)) << u64(8) | low(0)
    three = (u64(0xE0) | n >> u64(12)) << u64(16) | low(1) << u64(8) | low(0)
    four = (u64(0xF0) | n >> u64(18)) << u64(24) | low(2) << u64(16) | low(1) << u64(8) | low(0)
    five = (u64(0xF8) | n >> u64(24)) << u64(32) | low(3) << u64(24) | low(2) << u64(16) | low(1) << u64(8) | low(0)
    kind = np.searchsorted([128, 2048, 65536, 1 << 21], n, side="right")
    return np.choose(kind, [n, two, three, four, five]), 8 * (kind + 1)


def encode_frames(samples: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, size of each frame): samples (frames x 576, signed 8-bit), numbers as they stand in their stream."""
    f = len(samples)
    x = samples.astype(np.int32)
    cost, diffs, d = [], [], x
    for order in range(5):
        diffs.append(d)
        cost.append(np.abs(d[:, 4 - order :]).sum(1))
        d = np.diff(d, axis=1)
    order = np.argmin(np.stack(cost), 0)
    constant = (x == x[:, :1]).all(1)
    residual = np.zeros((f, BLOCK), np.int32)
    for o in range(5):
        rows = np.flatnonzero(order == o)
        residual[rows, o:] = diffs[o][rows]
    folded = ((residual << 1) ^ (residual >> 31)).astype(np.int64)
    n = BLOCK - order
    bits = np.stack([(folded >> k).sum(1) + n * (k + 1) for k in range(PARAMETERS)])
    most = folded.max(1)
    bits[np.stack([most >> k > LONGEST_UNARY for k in range(PARAMETERS)])] = 1 << 40
    k = np.argmin(bits, 0)
    verbatim = ~constant & (bits.min(0) + 10 + 8 * order >= 8 * BLOCK)
    rice = ~constant & ~verbatim
    order = np.where(rice, order, 0)
    # One column of codes per field: header, number, CRC-8, subframe header, warm-up, Rice parameter, samples.
    value, length = np.zeros((f, 9 + BLOCK), u64), np.zeros((f, 9 + BLOCK), np.int64)
    value[:, 0], length[:, 0] = 0xFFF82502, 32
    value[:, 1], length[:, 1] = coded_number(numbers)
    crc = np.zeros(f, np.uint32)
    for v, size in ((value[:, 0], length[:, 0]), (value[:, 1], length[:, 1])):
        for j in range(4, -1, -1):
            has = size > 8 * j
            crc[has] = CRC8[crc[has] ^ ((v[has] >> u64(8 * j)) & u64(255)).astype(np.uint32)]
    value[:, 2], length[:, 2] = crc, 8
    value[:, 3], length[:, 3] = np.where(constant, 0, np.where(verbatim, 2, (8 | order) << 1)), 8
    raw = (x & 255).astype(u64)
    for o in range(4):
        has = (rice & (order > o)) | (constant & (o == 0))
        value[has, 4 + o], length[has, 4 + o] = raw[has, o], 8
    value[rice, 8], length[rice, 8] = k[rice], 10
    at = np.arange(BLOCK)
    coded = rice[:, None] & (at >= order[:, None])
    ks = k[:, None]
    value[:, 9:] = np.where(coded, (folded & ((1 << ks) - 1)) | (1 << ks), np.where(verbatim[:, None], raw, 0))
    length[:, 9:] = np.where(coded, (folded >> ks) + 1 + ks, np.where(verbatim[:, None], 8, 0))
    size = (length.sum(1) + 7) // 8 + 2
    start = np.cumsum(size) - size
    end = (np.cumsum(length, 1) + 8 * start[:, None]).ravel()
    value = value.ravel()
    words = np.zeros(int(size.sum()) // 8 + 2, u64)
    has = np.flatnonzero(length.ravel())
    value, last = value[has], end[has] - 1
    shift, word = u64(63) - (last & 63).astype(u64), last >> 6
    for part, to in ((value << shift, word), (np.where(shift > 0, value >> (u64(64) - shift), u64(0)), word - 1)):
        first = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
        keep = to[first] >= 0
        words[to[first][keep]] |= np.bitwise_or.reduceat(part, first)[keep]
    data = np.frombuffer(words.astype(">u8").tobytes(), np.uint8).copy()[: int(size.sum())]
    crc = crc16_rows(data, start, size - 2)
    data[start + size - 2], data[start + size - 1] = crc >> 8, crc & 255
    return data, size


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream (one channel, 8 bits, blocks of 576) of each payload, whose size is a multiple of 576."""
    counts = np.array([len(p) // BLOCK for p in payloads], np.int64)
    samples = (np.frombuffer(b"".join(payloads), np.uint8) ^ 128).view(np.int8).reshape(-1, BLOCK)
    numbers = np.arange(len(samples)) - np.repeat(np.cumsum(counts) - counts, counts)
    parts = [encode_frames(samples[i : i + TOGETHER], numbers[i : i + TOGETHER]) for i in range(0, len(samples), TOGETHER)]
    data = b"".join(d.tobytes() for d, _ in parts)
    size = np.concatenate([s for _, s in parts]) if parts else np.zeros(0, np.int64)
    out, frame, byte = [], 0, 0
    for p, n in zip(payloads, counts):
        own = size[frame : frame + n]
        offsets = np.cumsum(own) - own
        table = np.zeros(n, np.dtype([("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")]))
        table["sample"], table["offset"], table["n"] = np.arange(n) * BLOCK, offsets, BLOCK
        total = int(own.sum())
        info = struct.pack(">HH", BLOCK, BLOCK) + int(own.min()).to_bytes(3, "big") + int(own.max()).to_bytes(3, "big") + (RATE << 44 | 0 << 41 | 7 << 36 | n.item() * BLOCK).to_bytes(8, "big")
        info += hashlib.md5((samples[frame : frame + n]).tobytes()).digest()
        seek = table.tobytes()
        out.append(b"fLaC\x00" + len(info).to_bytes(3, "big") + info + _seek_blocks(seek) + data[byte : byte + total])
        frame, byte = frame + n, byte + total
    return out


def _seek_blocks(table: bytes) -> bytes:
    """A metadata block holds under 2**24 bytes; a longer table goes to an application block each."""
    most = (1 << 24) // 18 * 18 - 18
    cuts = [table[i : i + most] for i in range(0, len(table), most)]
    return b"".join((bytes([(3 if i == 0 else 2) | (128 if i == len(cuts) - 1 else 0)]) + (len(c) + (4 if i else 0)).to_bytes(3, "big") + (b"seek" if i else b"") + c) for i, c in enumerate(cuts))


class Stream:
    """The metadata of a stream and where its frames begin."""

    def __init__(self, media: bytes):
        if media[:4] != b"fLaC":
            raise ValueError("not a FLAC stream")
        at, last, table = 4, False, b""
        info = None
        while not last:
            kind, n = media[at], int.from_bytes(media[at + 1 : at + 4], "big")
            body, last = media[at + 4 : at + 4 + n], kind >> 7
            if len(body) != n:
                raise ValueError("cut off")
            if kind & 127 == 0:
                info = body
            elif kind & 127 == 3:
                table += body
            elif kind & 127 == 2 and body[:4] == b"seek":
                table += body[4:]
            at += 4 + n
        if info is None or len(info) < 34:
            raise ValueError("no STREAMINFO")
        self.min_block, self.max_block = struct.unpack(">HH", info[:4])
        packed = int.from_bytes(info[10:18], "big")
        self.rate, self.channels, self.bits, self.samples = packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & ((1 << 36) - 1)
        self.md5, self.first = info[18:34], at
        points = np.frombuffer(table, np.dtype([("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")]))
        points = points[points["sample"] != np.uint64((1 << 64) - 1)]
        self.offsets, self.starts = points["offset"].astype(np.int64), points["sample"].astype(np.int64)
        whole = len(points) and int(points["n"].astype(np.int64).sum()) == self.samples
        self.quick = bool(whole and self.channels == 1 and self.bits == 8 and self.min_block == self.max_block == BLOCK and (points["n"] == BLOCK).all())


def decode_quick(data: np.ndarray, start: np.ndarray, size: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples (frames x 576, int8) and which of the frames are left to decode_frame()."""
    f = len(start)
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    window = np.zeros(len(data) + 8, u64)
    for j in range(8):
        window = window << u64(8) | padded[j : j + len(window)]
    value, bits = coded_number(numbers)
    nbytes = bits // 8
    ok = (window[start] >> u64(32) == 0xFFF82502) & (window[start + 4] >> (u64(64) - bits.astype(u64)) == value)
    crc = np.zeros(f, np.uint32)
    for j in range(9):
        has = j < 4 + nbytes
        crc[has] = CRC8[crc[has] ^ padded[start[has] + j]]
    body = start + 4 + nbytes
    if not (ok & (crc == padded[body])).all():
        raise ValueError("a frame header or its CRC-8 does not hold")
    sums = crc16_rows(data, start, size - 2)
    if (sums != padded[start + size - 2].astype(np.uint32) << 8 | padded[start + size - 1]).any():
        raise ValueError("a frame's CRC-16 does not hold")
    kind = padded[body + 1]
    body = body + 2
    out, odd = np.zeros((f, BLOCK), np.int8), np.zeros(f, bool)
    rows = np.flatnonzero(kind == 0)
    out[rows] = padded[body[rows]].view(np.int8)[:, None]
    rows = np.flatnonzero(kind == 2)
    out[rows] = padded[body[rows][:, None] + np.arange(BLOCK)].view(np.int8)
    rice = np.flatnonzero((kind >= 16) & (kind <= 24) & (kind & 1 == 0))
    odd[(kind != 0) & (kind != 2)] = True
    odd[rice] = False
    order = (kind[rice] >> 1).astype(np.int64) & 7
    at = 8 * (body[rice] + order)
    head = (window[at >> 3] >> u64(54)).astype(np.int64)
    plain = (head >> 4 == 0) & (head & 15 != 15)
    odd[rice[~plain]] = True
    rice, order, at, k = rice[plain], order[plain], at[plain] + 10, (head[plain] & 15).astype(u64)
    if not len(rice):
        return out, odd
    signal = np.zeros((BLOCK, len(rice)), np.int64)
    slow = np.zeros(len(rice), bool)
    limit = len(window) - 1
    for i in range(BLOCK):
        w = window[np.minimum(at >> 3, limit)] << (at & 7).astype(u64)
        q = 1075 - ((w >> u64(11)).astype(np.float64).view(np.int64) >> 52)  # leading zeros among the top 53 bits
        low = (w << (q + 1).astype(u64)) >> (u64(64) - k)
        u = (q.astype(u64) << k | low).astype(np.int64)
        used = q + 1 + k.astype(np.int64)
        if i < 4:
            live = order <= i
            slow |= live & (used > 57)
            signal[i] = np.where(live, (u >> 1) ^ -(u & 1), 0)
            at = np.where(live, at + used, at)
        else:
            slow |= used > 57
            signal[i] = (u >> 1) ^ -(u & 1)
            at = at + used
    odd[rice[slow]] = True
    signal = np.ascontiguousarray(signal.T)
    for o in range(1, 5):
        rows = np.flatnonzero(order == o)
        warm = padded[body[rice[rows]][:, None] + np.arange(o)].view(np.int8).astype(np.int64)
        own = signal[rows]
        for j in range(o, 0, -1):
            own[:, j - 1] = np.diff(warm, n=j - 1, axis=1)[:, 0]
            own[:, j - 1 :] = np.cumsum(own[:, j - 1 :], axis=1)
        signal[rows] = own
    if ((signal[~slow] < -128) | (signal[~slow] > 127)).any():
        raise ValueError("samples leave their range")
    out[rice] = signal.astype(np.int8)
    return out, odd


class Bits:
    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, 8 * at

    def take(self, n: int) -> int:
        a, b = self.at >> 3, (self.at + n + 7) >> 3
        if b > len(self.data):
            raise ValueError("cut off")
        self.at += n
        return int.from_bytes(self.data[a:b], "big") >> (8 * b - self.at) & ((1 << n) - 1)

    def signed(self, n: int) -> int:
        x = self.take(n) if n else 0
        return x - (1 << n) if n and x >> (n - 1) else x

    def zeros(self) -> int:
        n = 0
        while not self.take(1):
            n += 1
        return n


def _residual(bits: Bits, block: int, order: int) -> list[int]:
    method, parts = bits.take(2), 1 << bits.take(4)
    wide, out = 5 if method else 4, []
    for p in range(parts):
        k, n = bits.take(wide), block // parts - (order if p == 0 else 0)
        if k == (1 << wide) - 1:
            raw = bits.take(5)
            out += [bits.signed(raw) for _ in range(n)]
        else:
            for _ in range(n):
                u = bits.zeros() << k | (bits.take(k) if k else 0)
                out.append(u >> 1 ^ -(u & 1))
    return out


#: The coefficients of FLAC's fixed predictors of order 0 to 4.
FIXED = ([], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1])


def _subframe(bits: Bits, block: int, depth: int) -> list[int]:
    head = bits.take(8)
    kind, wasted = head >> 1, 0
    if head & 1:
        wasted = bits.zeros() + 1
    depth -= wasted
    if kind == 0:
        out = [bits.signed(depth)] * block
    elif kind == 1:
        out = [bits.signed(depth) for _ in range(block)]
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind < 32 else kind - 31
        out, shift = [bits.signed(depth) for _ in range(order)], 0
        weights = FIXED[order] if kind < 32 else None
        if weights is None:
            precision = bits.take(4) + 1
            shift = bits.signed(5)
            weights = [bits.signed(precision) for _ in range(order)]
        for r in _residual(bits, block, order):
            out.append(r + (sum(w * out[-1 - j] for j, w in enumerate(weights)) >> shift))
    else:
        raise ValueError("reserved subframe type")
    return [x << wasted for x in out]


def decode_frame(media: bytes, at: int, stream: Stream) -> tuple[list[list[int]], int]:
    """The samples of each channel of the frame at this byte, and where it ends. Verifies both checksums."""
    bits = Bits(media, at)
    if bits.take(15) != 0x7FFC:
        raise ValueError("no frame here")
    bits.take(1)
    size, rate, channels, depth = bits.take(4), bits.take(4), bits.take(4), bits.take(3)
    bits.take(1)
    lead = bits.take(8)
    while lead >= 0xC0 and lead & 0x40:
        bits.take(8)
        lead = lead << 1 & 0xFF
    block = {1: 192, 6: 0, 7: 0}.get(size, 144 << size if size < 6 else 1 << size)
    if size in (6, 7):
        block = bits.take(8 * (size - 5)) + 1
    if rate in (12, 13, 14):
        bits.take(8 if rate == 12 else 16)
    crc = 0
    for b in media[at : bits.at >> 3]:
        crc = int(CRC8[crc ^ b])
    if bits.take(8) != crc:
        raise ValueError("a frame's CRC-8 does not hold")
    depth = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}.get(depth, stream.bits)
    if channels < 8:
        out = [_subframe(bits, block, depth) for _ in range(channels + 1)]
    else:
        a = _subframe(bits, block, depth + (channels == 9))
        b = _subframe(bits, block, depth + (channels in (8, 10)))
        if channels == 8:
            out = [a, [x - y for x, y in zip(a, b)]]
        elif channels == 9:
            out = [[x + y for x, y in zip(a, b)], b]
        else:
            mid = [x << 1 | (y & 1) for x, y in zip(a, b)]
            out = [[(m + y) >> 1 for m, y in zip(mid, b)], [(m - y) >> 1 for m, y in zip(mid, b)]]
    end = (bits.at + 7) >> 3
    crc = 0
    for b in media[at:end]:
        crc = (crc << 8 & 0xFFFF) ^ int(CRC16[crc >> 8 ^ b])
    if int.from_bytes(media[end : end + 2], "big") != crc:
        raise ValueError("a frame's CRC-16 does not hold")
    return out, end + 2


def decode_slowly(media: bytes, stream: Stream) -> np.ndarray:
    """All samples, channels interleaved."""
    at, out = stream.first, []
    while at < len(media):
        channels, at = decode_frame(media, at, stream)
        out.append(np.array(channels, np.int64).T.ravel())
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def pcm_bytes(samples: np.ndarray, bits: int) -> bytes:
    """Little-endian signed samples, as the stream's MD5 takes them."""
    width = (bits + 7) // 8
    return samples.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :width].tobytes() if width < 4 else samples.astype("<i4").tobytes()


def decode(media: list[bytes]) -> list[bytes]:
    """PCM bytes of each stream; checks every checksum, the sample count and the MD5."""
    streams = [Stream(m) for m in media]
    out: list[bytes | None] = [None] * len(media)
    quick = [i for i, s in enumerate(streams) if s.quick]
    if quick:
        counts = np.array([len(streams[i].offsets) for i in quick])
        bodies = [media[i][streams[i].first :] for i in quick]
        data = np.frombuffer(b"".join(bodies), np.uint8)
        base = np.cumsum([0, *map(len, bodies)])
        start = np.concatenate([streams[i].offsets + b for i, b in zip(quick, base)])
        size = np.diff(np.r_[start, base[-1]])
        numbers = np.arange(len(start)) - np.repeat(np.cumsum(counts) - counts, counts)
        if len(start) and (size < 8).any():
            raise ValueError("the seek table does not hold")
        parts = []
        for i in range(0, len(start), TOGETHER):
            a, b = start[i], start[min(i + TOGETHER, len(start)) - 1] + size[min(i + TOGETHER, len(start)) - 1]
            samples, odd = decode_quick(data[a:b], start[i : i + TOGETHER] - a, size[i : i + TOGETHER], numbers[i : i + TOGETHER])
            for j in np.flatnonzero(odd):
                got, _ = decode_frame(data[a:b].tobytes(), int(start[i + j] - a), streams[quick[0]])
                samples[j] = got[0]
            parts.append(samples)
        samples = np.concatenate(parts) if parts else np.zeros((0, BLOCK), np.int8)
        for i, n, first in zip(quick, counts, np.cumsum(counts) - counts):
            out[i] = samples[first : first + n].tobytes()
    for i, s in enumerate(streams):
        if out[i] is None:
            out[i] = pcm_bytes(decode_slowly(media[i], s), s.bits)
        if s.samples and len(out[i]) != s.samples * s.channels * ((s.bits + 7) // 8):
            raise ValueError("the sample count does not hold")
        if any(s.md5) and hashlib.md5(out[i]).digest() != s.md5:
            raise ValueError("the MD5 does not hold")
    return out


def payload(text: str | None) -> bytes:
    data = (text or "").encode()
    return data.ljust(max(1, -(-len(data) // BLOCK)) * BLOCK, b"\xff")


def feature(samples: bytes) -> str:
    """Frames, extremes, sum, energy and sign changes: integers, so equal everywhere."""
    x = np.frombuffer(samples, np.int8).astype(np.int64)
    return f"blocks={len(x) // BLOCK};low={x.min()};high={x.max()};sum={x.sum()};energy={(x * x).sum()};crossings={int(((x[1:] < 0) != (x[:-1] < 0)).sum())}"


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, media): the FLAC stream of each text's payload."""

    def run(batches):
        for part in slices(batches, 2_000_000):
            yield pa.record_batch([part.column(0), pa.array(encode([payload(t) for t in part.column(1).to_pylist()]), pa.binary())], [id_col, "media"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.selectExpr(f"`{id_col}`", f"`{text_col}` AS text").mapInArrow(run, f"`{id_col}` {kind}, media binary")


def pcm_blocks(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(id, block, sample_offset, n_samples, pcm) of any FLAC streams: blocks of 576 samples that can be read alone."""

    def run(batches):
        for part in batches:
            for i in range(part.num_rows):
                row = part.slice(i, 1)
                stream = row.column(1)[0].as_py()
                if stream is None:
                    continue
                pcm, s = decode([stream])[0], Stream(stream)
                wide = s.channels * ((s.bits + 7) // 8)
                cuts = [pcm[a : a + BLOCK * wide] for a in range(0, len(pcm), BLOCK * wide)]
                n = len(cuts)
                yield pa.record_batch([pa.array(row.column(0).to_pylist() * n, row.column(0).type), pa.array(range(n), pa.int64()), pa.array([b * BLOCK for b in range(n)], pa.int64()), pa.array([len(c) // wide for c in cuts], pa.int64()), pa.array(cuts, pa.binary())], [id_col, "block", "sample_offset", "n_samples", "pcm"])

    kind = media.schema[id_col].dataType.simpleString()
    return media.selectExpr(f"`{id_col}`", f"`{media_col}` AS media").mapInArrow(run, f"`{id_col}` {kind}, block bigint, sample_offset bigint, n_samples bigint, pcm binary")


def stored(docs: DataFrame) -> DataFrame:
    """Store each text as FLAC, read the stream back, and give digests of both."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches):
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for part in slices(batches, 2_000_000):
            texts = part.column(1).to_pylist()
            media = encode([payload(t) for t in texts])
            pcm = decode(media)
            back = [(np.frombuffer(p, np.uint8) ^ 128).tobytes() for p in pcm]
            yield pa.record_batch(
                [part.column(0)]
                + [pa.array(c) for c in ([len((t or "").encode()) for t in texts], [len(b) for b in back], [sha(b) for b in back], [zlib.crc32(b[-32:]) for b in back], [len(m) for m in media], [sha(m) for m in media], [feature(p) for p in pcm])],
                names,
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
