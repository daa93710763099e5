"""Byte-level BPE encoding and decoding with a pair occurrence index.

The words of a slice of a partition that are not known yet are laid out in one symbol array. An index maps each
adjacent pair to all of its positions in that array; the active ranks wait in a heap. The lowest active rank is
applied at all its positions at once, and only the lists of the neighbouring pairs change. A merge can only create
pairs of later ranks, so each rank is applied once and the outcome equals merging word by word. Long lists of positions
are applied as arrays, short ones one by one.

Defined results: null and empty texts have no ids and decode to the empty text; an added token's string in a text is
that token; ids that the vocabulary does not have decode to U+FFFD; texts are handled whole, of any length; repeated rows
get equal results; other columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import held, slices

#: The pre-tokenizer's pattern of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Words that a worker remembers; beyond that it keeps what its last slice held and what is short.
REMEMBERED, SHORT = 300_000, 7
#: Places of a pair that are worked on one by one rather than as an array.
LOOSE = 40
#: What stands for an id that the vocabulary does not have.
UNKNOWN = "\N{REPLACEMENT CHARACTER}".encode()
#: Characters of text that are looked at together.
SLICE = 4_000_000


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (b for b in range(256) if b not in set(plain))
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Pairs:
    """(left id, right id) -> rank for whole arrays of pairs, by open addressing; and each rank's pair and merged id."""

    def __init__(self, merges: dict[tuple[int, int], tuple[int, int]]):
        self.of_rank = {rank: (a, b, new) for (a, b), (rank, new) in merges.items()}
        self.bits = max(4, (4 * len(merges)).bit_length())
        size = 1 << self.bits
        self.keys, self.ranks = np.full(size, -1, np.int64), np.full(size, -1, np.int32)
        left = np.array([k for k, _ in merges], np.int64) << 32 | np.array([k for _, k in merges], np.int64)
        rank, slot = np.array([r for r, _ in merges.values()], np.int32), self._slots(left)
        while len(left):  # one of those that want a slot gets it if it is free, the others move on
            winner = np.zeros(size, np.int64)
            winner[slot] = np.arange(len(slot))
            got = (winner[slot] == np.arange(len(slot))) & (self.keys[slot] == -1)
            self.keys[slot[got]], self.ranks[slot[got]] = left[got], rank[got]
            left, rank, slot = left[~got], rank[~got], (slot[~got] + 1) & (size - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks, -1 for pairs that do not merge."""
        keys = left.astype(np.int64) << 32 | (right.astype(np.int64) & 0xFFFFFFFF)
        slot = self._slots(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.ranks[slot], -1)
        out[left < 0] = -1
        rest = np.flatnonzero((there != keys) & (there != -1))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & (len(self.keys) - 1)
            there = self.keys[slot[rest]]
            same = there == keys[rest]
            out[rest[same]] = self.ranks[slot[rest[same]]]
            rest = rest[~same & (there != -1)]
        return out


class Vocabulary:
    """A byte-level BPE file: single-byte ids, (left id, right id) -> (rank, id), id -> bytes, added tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids, letters = spec["model"]["vocab"], byte_letters()
        back = {c: b for b, c in letters.items()}
        bytes_of = {i: bytes(map(back.__getitem__, s)) for s, i in ids.items()}
        self.single = np.array([ids[letters[b]] for b in range(256)], np.int32)
        self.merges = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault((ids[a], ids[b]), (rank, ids[a + b]))
        self.pairs = Pairs(self.merges)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        bytes_of |= {i: s.encode() for s, i in self.added.items()}
        # The bytes of all ids in one pool; the last place stands for ids that are not there.
        every = [bytes_of.get(i, UNKNOWN) for i in range(max(bytes_of) + 1)] + [UNKNOWN]
        self.pool, self.sizes = np.frombuffer(b"".join(every), np.uint8), np.array([*map(len, every)], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.known: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[str]:
        """Words of the text, added tokens as they stand."""
        if self.split is None or not any(s in text for s in self.added):
            return _WORDS(text)
        return [w for i, part in enumerate(self.split.split(text)) for w in ([part] if i % 2 else _WORDS(part))]

    def learn(self, words: set[str]) -> None:
        """Encode words that are not known yet, all of them together."""
        if len(self.known) > REMEMBERED:
            self.known = {w: ids for w, ids in self.known.items() if len(w) <= SHORT or w in words}
        fresh = words.difference(self.known)
        plain = [w for w in fresh if w not in self.added]
        self.known |= {w: self.added[w].to_bytes(4, "little") for w in fresh if w in self.added}
        self.known.update(zip(plain, merge_together([w.encode() for w in plain], self)))


_WORDS = regex.compile(PATTERN).findall


def merge_together(words: list[bytes], vocab: Vocabulary) -> list[bytes]:
    """The ids of each word, packed as little-endian unsigned 32-bit integers."""
    # A word's symbols are neighbours in one array; -1 stands between words, so no pair crosses them.
    data, sizes = np.frombuffer(b"".join(words), np.uint8), np.fromiter(map(len, words), np.int64, len(words))
    size = len(data) + len(words) + 1
    # Long lists of places are worked on as arrays, short ones one by one: both see the same memory.
    symbol, left, right = (array("i", bytes(4 * size)) for _ in range(3))
    symbols, lefts, rights = (np.frombuffer(x, np.int32) for x in (symbol, left, right))
    symbols[:] = -1
    symbols[np.arange(len(data)) + 1 + np.repeat(np.arange(len(words)), sizes)] = vocab.single[data]
    lefts[:], rights[:] = np.arange(-1, size - 1), np.arange(1, size + 1)
    # The index: a pair's rank -> all its places, as arrays and one by one; ranks wait in a heap.
    many: dict[int, list[np.ndarray]] = {}
    few: dict[int, list[int]] = {}
    active: list[int] = []
    find, of_rank = vocab.merges.get, vocab.pairs.of_rank

    def put(ranks: np.ndarray, places: np.ndarray) -> None:
        if len(ranks) < LOOSE:
            for rank, at in zip(ranks.tolist(), places.tolist()):
                if rank in few:
                    few[rank].append(at)
                else:
                    few[rank] = [at]
                    if rank not in many:
                        heapq.heappush(active, rank)
            return
        order = np.argsort(ranks, kind="stable")
        ranks, places = ranks[order], places[order]
        cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
        for rank, a, b in zip(ranks[cuts[:-1]].tolist(), cuts, cuts[1:]):
            if rank not in many and rank not in few:
                heapq.heappush(active, rank)
            if b - a < LOOSE:
                few.setdefault(rank, []).extend(places[a:b].tolist())
            else:
                many.setdefault(rank, []).append(places[a:b])

    ranks = vocab.pairs.find(symbols[:-1], symbols[1:])
    there = np.flatnonzero(ranks >= 0)
    put(ranks[there], there)
    while active:
        rank = heapq.heappop(active)
        arrays, places = many.pop(rank, ()), few.pop(rank, [])
        a, b, new = of_rank[rank]
        if arrays and a != b:
            p = np.concatenate([*arrays, np.array(places, np.int64)])
            p = p[symbols[p] == a]
            q = rights[p]
            same = symbols[q] == b
            p, q = p[same], q[same]
            after = rights[q]
            symbols[p], symbols[q] = new, -2
            rights[p], lefts[after] = after, p
            before = lefts[p]
            ranks = vocab.pairs.find(np.r_[symbols[before], symbols[p]], np.r_[symbols[p], symbols[after]])
            there = np.flatnonzero(ranks >= 0)
            put(ranks[there], np.r_[before, p][there])
            continue
        for x in arrays:
            places += x.tolist()
        if a == b:  # places may overlap: the first ones go first
            places.sort()
        for p in places:
            if symbol[p] != a:
                continue  # an earlier merge took it
            q = right[p]
            if symbol[q] != b:
                continue
            symbol[p], symbol[q] = new, -2
            right[p] = after = right[q]
            left[after] = p
            before = left[p]
            for at, hit in ((before, find((symbol[before], new))), (p, find((new, symbol[after])))):
                if hit:
                    if hit[0] in few:
                        few[hit[0]].append(at)
                    else:
                        few[hit[0]] = [at]
                        if hit[0] not in many:
                            heapq.heappush(active, hit[0])
    alive = symbols >= 0
    out = symbols[alive].astype("<u4").tobytes()
    cuts = (4 * np.cumsum(alive)[symbols == -1]).tolist()
    return [out[a:b] for a, b in zip(cuts, cuts[1:])]


def vocabulary(path: str) -> Vocabulary:
    return held(("bpe", path), lambda: Vocabulary(path))


def encode(vocab: Vocabulary, texts: list[str | None]) -> list[bytes]:
    """Packed ids of each text."""
    cut = [vocab.pieces(t) if t else [] for t in texts]
    vocab.learn(set().union(*cut))
    return [b"".join(map(vocab.known.__getitem__, words)) for words in cut]


def decode(vocab: Vocabulary, ids: bytes) -> str:
    """Ids that are not there, and bytes that are not UTF-8 (possible only for ids that no text gave), become U+FFFD."""
    which = np.minimum(np.frombuffer(ids, "<u4"), len(vocab.sizes) - 1).astype(np.int64)
    size = vocab.sizes[which]
    place = np.arange(int(size.sum())) + np.repeat(vocab.starts[which] - (np.cumsum(size) - size), size)
    return vocab.pool[place].tobytes().decode("utf-8", "replace")


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids): ids as an array of int."""

    def run(batches):
        vocab = vocabulary(path)
        for part in slices(batches, SLICE):
            ids = encode(vocab, part.column(1).to_pylist())
            yield pa.record_batch([part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([list(memoryview(x).cast("I")) for x in ids], pa.list_(pa.int32()))], [id_col, "n_tokens", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.selectExpr(f"`{id_col}`", f"`{text_col}` AS text").mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, ids array<int>")


def decoded(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) from the arrays that encoded() gives; a null array decodes to the empty text."""
    def run(batches):
        vocab = vocabulary(path)
        for part in batches:
            texts = [decode(vocab, np.array(x or [], np.uint32).tobytes()) for x in part.column(1).to_pylist()]
            yield pa.record_batch([part.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    kind = tokens.schema[id_col].dataType.simpleString()
    return tokens.selectExpr(f"`{id_col}`", f"`{ids_col}` AS ids").mapInArrow(run, f"`{id_col}` {kind}, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Digests of the ids and of the text decoded from them, in one pass over the texts."""

    def run(batches):
        vocab = vocabulary(path)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for part in slices(batches, SLICE):
            ids = encode(vocab, part.column(1).to_pylist())
            yield pa.record_batch(
                [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(map(sha, ids), pa.string()), pa.array([sha(decode(vocab, x).encode()) for x in ids], pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
