"""Toxicity by weak supervision: a generative label model over many lexicon and pattern voters, then a linear classifier
on its posterior labels.

Voters. Lexicon voters fire on a term (a word, or a beginning of four or five letters) that labelled rows of the training
fold show to go with toxicity; pattern voters fire on several such terms, on a dense use of them, on none, on shouting and
on exclamation marks. Label model. EM estimates how often each voter fires under either class; residual correlations of
voters given the posterior are then estimated, correlated voters are joined to groups, and a group's evidence is divided
by its design effect before EM runs again. Classifier. Logistic regression on hashed words and beginnings is fitted to the
posteriors, and its output is scaled on the training fold's labels, so that 0.3 is a probability.

Only rows whose crc32(doc_id) mod 4 is not 2 are learned from, at most LABELLED_ROWS of them. Labels, language, source and
doc_id are no inputs of a score.

Defined results: null and empty texts get the score of a text without features; whole texts are read, of any length; each
bucket of a text's words counts once, in the fit and in the score; equal texts and repeated rows get equal scores; without
labelled rows of both classes every score is the smoothed share; an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices
from .hashed import BUCKETS, LABELLED_ROWS, Cache, bucket, features, labelled

HELD_OUT = 2
THRESHOLD = 0.3
LEXICON = 96
STEPS = 120
RATE = 0.3
LIFT = 4
WORDS = re.compile(r"\w+").findall
#: Buckets that hold a text's style, beside its words.
SHOUT, EXCLAIM = BUCKETS, BUCKETS + 1

sigmoid = lambda z: 0.5 * (1 + np.tanh(0.5 * z))


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4


def word_buckets(word: str) -> list[int]:
    out = [bucket("t" + word)]
    if len(word) > 4:
        out += [bucket("4" + word[:4]), bucket("5" + word[:5])]
    return out


def text_features(text: str) -> list[tuple[int, float]]:
    """Buckets of the distinct words, with how many of them fall there; then style."""
    counts: dict[int, float] = {}
    for w in sorted(set(WORDS(text.lower()))):
        for b in word_buckets(w):
            counts[b] = counts.get(b, 0) + 1
    letters = sum(map(str.isalpha, text))
    counts[SHOUT] = sum(map(str.isupper, text)) / letters if letters else 0
    counts[EXCLAIM] = text.count("!") / max(1, len(text))
    return list(counts.items())


def lexicon(row, b, y, most: int = LEXICON) -> np.ndarray:
    """Buckets whose presence goes with label 1: by signed log-likelihood, those with at least five documents and a tenfold lift."""
    n1, n0 = int((y == 1).sum()), int((y == 0).sum())
    words = b < BUCKETS
    pos = np.bincount(b[words & (y[row] == 1)], minlength=BUCKETS)
    neg = np.bincount(b[words & (y[row] == 0)], minlength=BUCKETS)
    p, q = (pos + 0.5) / (n1 + 1), (neg + 0.5) / (n0 + 1)
    gain = pos * np.log(p / q)
    gain[(pos < 5) | (p < 10 * q)] = -np.inf
    best = np.lexsort((np.arange(BUCKETS), -gain))[:most]
    return np.sort(best[np.isfinite(gain[best]) & (gain[best] > 0)])


def votes(row, b, v, n: int, terms: np.ndarray) -> np.ndarray:
    """(documents x voters) of 0 and 1: a column a term, then the patterns."""
    at = np.searchsorted(terms, b)
    hit = (at < len(terms)) & (terms[np.minimum(at, len(terms) - 1)] == b) if len(terms) else np.zeros(len(b), bool)
    out = np.zeros((n, len(terms) + 6), np.int8)
    out[row[hit], at[hit]] = 1
    terms_of, size = out.sum(1), np.bincount(row, v * (b < BUCKETS), n)
    style = lambda k: np.bincount(row[b == k], v[b == k], n)
    out[:, -6:] = np.stack([terms_of == 0, terms_of >= 2, terms_of >= 4, terms_of > 0.01 * np.maximum(size, 1), style(SHOUT) > 0.5, style(EXCLAIM) > 0.01], 1)
    return out


def label_model(x: np.ndarray, prior: float, rounds: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior, rate of firing under either class, weight of each voter), by EM with a correction for correlated voters."""
    n, m = x.shape
    post = np.clip((x[:, -5] + x[:, -4]) / 2.0, 0.02, 0.98)
    weight = np.ones(m)
    rate = np.zeros((2, m))
    for stage in range(2):
        for _ in range(rounds):
            for c, p in ((0, 1 - post), (1, post)):
                rate[c] = (p @ x + 0.5) / (p.sum() + 1)
            share = min(max(float(post.mean()), 0.5 * prior), 2 * prior)
            llr = weight * (x * np.log(rate[1] / rate[0]) + (1 - x) * np.log((1 - rate[1]) / (1 - rate[0])))
            post = sigmoid(np.clip(llr.sum(1) + np.log(share / (1 - share)), -30, 30))
        if stage == 0:
            residual = x - (post[:, None] * rate[1] + (1 - post)[:, None] * rate[0])
            spread = np.sqrt((residual**2).mean(0)) + 1e-6
            corr = np.abs(residual.T @ residual / n / np.outer(spread, spread))
            np.fill_diagonal(corr, 0)
            # A voter's evidence counts one part in 1 + the sum of its strong correlations.
            weight = 1 / (1 + np.where(corr > 0.2, corr, 0).sum(1))
    return post, rate, weight


def informative(row, b, words, post) -> np.ndarray:
    pos = np.bincount(b[words], post[row[words]], BUCKETS + 2)
    both = np.bincount(b[words], minlength=BUCKETS + 2)
    p, q = (pos + 0.2) / (post.sum() + 0.4), (both - pos + 0.2) / ((1 - post).sum() + 0.4)
    return (both >= 3) & (p >= LIFT * q)


class Linear:
    def __init__(self, weights: np.ndarray, bias: float, slope: float = 1.0, shift: float = 0.0):
        self.weights, self.bias, self.slope, self.shift = weights, bias, slope, shift

    @classmethod
    def fit(cls, row, b, v, y, steps: int = STEPS) -> Linear:
        n, share = len(y), (float((y == 1).sum()) + 0.5) / (len(y) + 1)
        weights, bias = np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share)))
        if not 0 < (y == 1).sum() < n:
            return cls(weights, bias)
        terms = lexicon(row, b, y)
        post, _, _ = label_model(votes(row, b, v, n, terms), share)
        words = b < BUCKETS
        # Kept: features of three documents or more that are LIFT times likelier in toxic texts by their posteriors.
        words &= informative(row, b, words, post)[b]
        row, b = row[words], b[words]
        used, at = np.unique(b, return_inverse=True)
        w, g2, gb = np.zeros(len(used)), np.full(len(used), 1e-8), 1e-8
        for _ in range(steps):
            z = np.bincount(row, w[at], n) + bias
            r = (sigmoid(z) - post) / n
            g, d = np.bincount(at, r[row], len(used)) + 1e-6 * w, r.sum()
            g2 += g * g
            gb += d * d
            w -= RATE * g / np.sqrt(g2)
            bias -= RATE * d / np.sqrt(gb)
        weights[used] = w
        z = np.bincount(row, w[at], n) + bias
        scale, gold = np.array([1.0, 0.0]), (y == 1).astype(float)
        for _ in range(20):  # Newton steps of the scaling, held near (1, 0)
            p = sigmoid(scale[0] * z + scale[1])
            a = np.stack([z, np.ones(n)], 1)
            step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + np.eye(2), a.T @ (p - gold) + (scale - [1, 0]))
            scale = scale - np.clip(step, -1, 1)
        return cls(weights, float(bias), float(max(scale[0], 0.1)), float(scale[1]))

    def telling(self, word: str) -> tuple[int, ...]:
        """The word's buckets that have a weight."""
        return tuple(b for b in word_buckets(word) if self.weights[b])

    def evidence(self, words: Iterable[tuple[int, ...]]) -> float:
        """Sum of the weights of a text's buckets, each once, as in the fit."""
        return float(sum(float(self.weights[b]) for b in sorted({b for found in words for b in found})))


def fitted(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> Linear:
    return Linear.fit(*features(labelled(docs, labels, F.col("toxic"), keep=fold(F.col("doc_id")) != HELD_OUT, rows=rows), text_features))


def scored(docs: DataFrame, model: Linear) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias, model.slope, model.shift))

    def run(batches):
        own = Linear(*shared.value)
        telling = Cache(own.telling)
        for part in slices(batches, 8_000_000):
            telling.trim()
            z = np.array([own.evidence(map(telling.__getitem__, set(WORDS((t or "").lower())))) for t in part.column(1).to_pylist()])
            score = sigmoid(own.slope * (z + own.bias) + own.shift)
            yield pa.record_batch([part.column(0), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"])

    done = docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, score double, predicted int")
    return done.select("doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "score", "predicted")
