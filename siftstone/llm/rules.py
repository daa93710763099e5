"""Quality rules as a short-circuit cascade.

Base figures are computed for every document. The rules after them run one by one and stop at the first rejection; their
order comes from a sample, on which each rule's cost (seconds a document) and selectivity (share rejected) are measured:
rules that reject most per second go first. The verdict is the conjunction of all rules, so the order changes only the
time that is spent, and figures from another sample give the same result.

Defined results: null, empty and blank texts have no words and fail the base; whole texts are read; repeated rows get
equal results; an empty table gives an empty result and no figures, and rules without figures, or with equal ones, run in
the order of their names; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Documents that costs and selectivities are measured on, about; smaller tables are measured whole.
SAMPLE = 512
WINDOW = 8
_POWERS = np.array([0x9E3779B97F4A7C15 * (2 * i + 1) % (1 << 64) | 1 for i in range(WINDOW)], np.uint64)


class WordIds(dict):
    """A number for each word, spread over 64 bits; forgotten when there are too many (numbers are compared within a text only)."""

    def __missing__(self, word):
        value = self[word] = (len(self) + 1) * 0xD6E8FEB86659FD93 % (1 << 64)
        return value


def repeat_words(words: list[str], ids: WordIds) -> int:
    """Words that lie in a window of eight words that the text holds twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    x = np.fromiter(map(ids.__getitem__, words), np.uint64, len(words))
    h = np.zeros(n, np.uint64)
    for i, p in enumerate(_POWERS):
        h += (x[i : i + n] ^ (x[i : i + n] >> np.uint64(29))) * p
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    again = np.zeros(n, bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:n] += again
    edge[WINDOW : WINDOW + n] -= again
    return int((np.cumsum(edge) > 0).sum())


class Document:
    """A text with what the base has counted."""

    __slots__ = ("text", "words", "word_chars", "n_symbols", "lines", "n_dup_lines", "n_repeat_words", "base_failed")

    def __init__(self, text: str | None, ids: WordIds):
        self.text = text = text or ""
        self.words = [w.decode() for w in text.encode().split()] if not text.isascii() else text.translate(_SEPARATORS).split()
        self.word_chars = len(text) - sum(map(text.count, BLANKS))
        self.n_symbols = sum(map(text.count, SYMBOLS))
        self.lines = [x for x in text.split("\n") if x.strip(BLANKS)]
        self.n_dup_lines = len(self.lines) - len(set(self.lines))
        self.n_repeat_words = repeat_words(self.words, ids)
        n = len(self.words)
        self.base_failed = n < 20 or 100 * self.n_repeat_words > 30 * n


#: str.split() also parts at these four; bytes.split() does not, and the words of this contract neither.
_SEPARATORS = {c: 0xE000 + c for c in range(0x1C, 0x20)}


def too_many_symbols(d: Document) -> bool:
    return 10 * d.n_symbols > d.word_chars


def mostly_upper(d: Document) -> bool:
    upper = sum(map(str.isupper, d.words))
    return 2 * upper > len(d.words)


def same_lines(d: Document) -> bool:
    return 2 * d.n_dup_lines > len(d.lines)


def odd_word_length(d: Document) -> bool:
    return not 2 * len(d.words) <= d.word_chars <= 20 * len(d.words)


def few_letters(d: Document) -> bool:
    return 2 * sum(map(str.isalpha, d.text)) < d.word_chars


def few_distinct(d: Document) -> bool:
    return len(d.words) >= 100 and 20 * len(set(d.words)) < len(d.words)


def mostly_digits(d: Document) -> bool:
    return 10 * sum(map(d.text.count, "0123456789")) > 3 * d.word_chars


RULES: dict[str, Callable[[Document], bool]] = {f.__name__: f for f in (too_many_symbols, mostly_upper, same_lines, odd_word_length, few_letters, few_distinct, mostly_digits)}


def measured(docs: DataFrame, sample: int = SAMPLE) -> dict[str, tuple[float, float]]:
    """name -> (seconds a document, share rejected), on about sample documents, chosen by a hash of doc_id, of those that pass the base. Only sums leave the executors."""
    whole = 1 << 30
    share = min(whole, whole * sample // max(1, docs.count()) + 1)
    docs = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(whole).cast("bigint")) < share)

    def run(batches: Iterator[pa.RecordBatch]):
        ids, spent, hits, n = WordIds(), dict.fromkeys(RULES, 0.0), dict.fromkeys(RULES, 0), 0
        for part in slices(batches, 4_000_000):
            for text in part.column(0).to_pylist():
                d = Document(text, ids)
                if d.base_failed:
                    continue
                n += 1
                for name, rule in RULES.items():
                    began = time.perf_counter()
                    hits[name] += rule(d)
                    spent[name] += time.perf_counter() - began
        yield pa.record_batch([pa.array(RULES), pa.array(spent.values()), pa.array(hits.values(), pa.int64()), pa.array([n] * len(RULES), pa.int64())], ["rule", "s", "hits", "n"])

    rows = docs.select("text").mapInArrow(run, "rule string, s double, hits bigint, n bigint").groupBy("rule").agg(*[F.sum(c).alias(c) for c in ("s", "hits", "n")]).collect()
    return {r.rule: (r.s / max(1, r.n), r.hits / max(1, r.n)) for r in rows}


def cascade(figures: dict[str, tuple[float, float]]) -> list[str]:
    """Rules by rejection per cost, the best first; rules without figures last, ties by name."""
    return sorted(RULES, key=lambda r: (-figures[r][1] / max(figures[r][0], 1e-9) if r in figures else 1.0, r))


def judged(docs: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Base figures and verdict of every document; order defaults to the cascade that a sample of docs gives."""
    order = cascade(measured(docs)) if order is None else order
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]

    def run(batches):
        ids, rules = WordIds(), [RULES[n] for n in order]
        for part in slices(batches, 4_000_000):
            rows = []
            for text in part.column(1).to_pylist():
                if len(ids) > 500_000:
                    ids.clear()
                d = Document(text, ids)
                kept = not d.base_failed and not any(rule(d) for rule in rules)
                rows.append((len(d.words), d.word_chars, d.n_symbols, d.n_dup_lines, d.n_repeat_words, d.base_failed, kept))
            columns = [pa.array(c, pa.int64() if i < 5 else pa.bool_()) for i, c in enumerate(zip(*rows))]
            yield pa.record_batch([part.column(0), *columns], names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean")
