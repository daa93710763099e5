"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(threshold_k - w . x), with one weight vector w of hashed text shared by all grades and ordered
thresholds (the first free, then positive steps). x is the mean over a text's words of up to three features each: the
lower-cased word, its shape, and whether it follows its like. Grades: 0 low quality, 1 good but toxic, 2 good. Expected grade and the tail P(grade >= 1) follow; a
text whose tail is under TAIL is rejected.

Fitted on at most LABELLED_ROWS labelled rows by full-batch AdaGrad, the same for the same rows. With no labelled row, or
one grade only, all thresholds follow the smoothed shares and nothing but the share decides.

Defined results: null and empty texts have x = 0; whole texts are read, of any length; repeated rows get equal results;
other columns pass through the filter as they are, whatever their names (rated() replaces those of its own names); an empty
table gives an empty result, and labels of documents that are not there do not count.
"""

from __future__ import annotations

from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.functions.arrow import arrow_schema, ddl_of

from .common import fresh, release, slices
from .hashed import BUCKETS, LABELLED_ROWS, Cache, bucket, features, labelled, shape

GRADES = 3
TAIL = 0.5
STEPS = 150
RATE = 0.5
DECAY = 1e-6
#: The feature of a word that follows its like.
AGAIN = "again"

sigmoid = lambda z: 0.5 * (1 + np.tanh(0.5 * z))


def word_buckets(word: str) -> tuple[int, int]:
    return bucket("w" + word.lower()), bucket("s" + shape(word))


def text_features(text: str) -> list[tuple[int, float]]:
    words = text.split()
    if not words:
        return []
    counts: Counter = Counter({bucket(AGAIN): sum(map(eq, words, words[1:]))})
    for w, n in Counter(words).items():
        for b in word_buckets(w):
            counts[b] += n
    return [(b, n / len(words)) for b, n in counts.items()]


class Ordinal:
    """weights (float32, hashed) and ordered thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    @classmethod
    def fit(cls, row, b, v, y, grades: int = GRADES, steps: int = STEPS) -> Ordinal:
        n = len(y)
        share = (np.bincount(y, minlength=grades)[:grades] + 0.5) / (n + 0.5 * grades)
        below = np.clip(np.cumsum(share)[:-1], 1e-6, 1 - 1e-6)
        cuts = np.log(below / (1 - below))
        free = np.r_[cuts[0], np.log(np.maximum(np.diff(cuts), 1e-3))]
        used, at = np.unique(b, return_inverse=True)
        w, g2, h2 = np.zeros(len(used)), np.full(len(used), 1e-8), np.full(len(free), 1e-8)
        # Rare grades weigh as much as common ones in w's gradient, up to tenfold; thresholds see true shares.
        weigh = np.minimum(10, 1 / (grades * share))[y] if n else np.zeros(0)
        for _ in range(steps if n and len(np.unique(y)) > 1 else 0):
            cuts = np.cumsum(np.r_[free[0], np.exp(free[1:])])
            z = np.bincount(row, w[at] * v, n)
            upper, lower = np.r_[cuts, np.inf][y] - z, np.r_[-np.inf, cuts][y] - z
            fu, fl = sigmoid(upper), sigmoid(lower)
            p = np.maximum(fu - fl, 1e-9)
            du, dl = fu * (1 - fu) / p, fl * (1 - fl) / p  # d log p / d upper, -d log p / d lower
            gz = weigh * (du - dl) / n  # of -log p by z
            gw = np.bincount(at, gz[row] * v, len(used)) + DECAY * w
            gc = np.array([(-weigh * du)[y == k].sum() + (weigh * dl)[y == k + 1].sum() for k in range(grades - 1)]) / n
            gf = np.cumsum(gc[::-1])[::-1] * np.r_[1, np.exp(free[1:])]
            g2 += gw * gw
            h2 += gf * gf
            w -= RATE * gw / np.sqrt(g2) * 10
            free = free - 0.1 * gf / np.sqrt(h2)
        weights = np.zeros(BUCKETS, np.float32)
        weights[used] = w
        return cls(weights, np.cumsum(np.r_[free[0], np.exp(free[1:])]))

    def word_weight(self, word: str) -> float:
        a, b = word_buckets(word)
        return float(self.weights[a]) + float(self.weights[b])

    def grade(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(expected grade, tail probability P(grade >= 1))."""
        above = 1 - sigmoid(self.thresholds[None, :] - z[:, None])
        return above.sum(1), above[:, 0]


def fitted(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> Ordinal:
    grade = F.when(F.col("quality") == 1, F.when(F.col("toxic") == 1, 1).otherwise(2)).when(F.col("quality") == 0, 0)
    return Ordinal.fit(*features(labelled(docs, labels, grade, rows=rows), text_features))


def rated(docs: DataFrame, model: Ordinal, names=("expected_grade", "tail_probability", "accepted")) -> DataFrame:
    """docs with expected grade, tail probability and verdict, which replace columns of these names."""
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in {n.lower() for n in names}])
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))
    place = docs.columns.index("text")
    schema = ddl_of(docs.schema, f"{names[0]} double", f"{names[1]} double", f"{names[2]} boolean")
    arrow = arrow_schema(schema)

    def run(batches):
        release()
        own = Ordinal(*shared.value)
        weight, again = Cache(own.word_weight), float(own.weights[bucket(AGAIN)])
        for part in slices(batches, 8_000_000):
            weight.trim()
            z = []
            for text in part.column(place).to_pylist():
                words = (text or "").split()
                z.append((sum(map(weight.__getitem__, words)) + again * sum(map(eq, words, words[1:]))) / len(words) if words else 0.0)
            expected, tail = own.grade(np.array(z))
            yield pa.record_batch([*part.columns, pa.array(expected), pa.array(tail), pa.array(tail >= TAIL)], [*part.schema.names, *names]).cast(arrow)

    return docs.mapInArrow(run, schema)


def accepted(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> DataFrame:
    """The rows of docs that the classifier accepts, with their own columns only."""
    names = tuple(fresh(n, docs.columns) for n in ("expected_grade", "tail_probability", "accepted"))
    done = rated(docs, fitted(docs, labels, rows), names)
    return done.filter(F.col(names[2])).select(*[F.col(f"`{c}`") for c in docs.columns])
