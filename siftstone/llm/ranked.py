"""Ranked lexical search by a hierarchical max tree over document ranges.

Terms are the maximal runs of letters and digits of ASCII and of all other characters, A-Z lower-cased. With N documents that
have a term, L terms in all and df documents that hold a term, its weight is w = floor(1000 ln((2N + 2) / (2df + 1))). A
document of n terms has m = 25 + 75nN div L and scores w * (1000000000 tf div (1000 tf + 8m)) for each of a query's terms.

Tree. Each task indexes its documents in shards of consecutive rows. For every term the tree holds the greatest factor of w over
each range of FAN ** k documents (only ranges that hold the term have an entry). Search is best-first: the range with the
highest sum of w times greatest factor is opened next, into its FAN parts or, at the end, into documents, whose sums are
exact. It stops when a shard's k-th score is above the highest bound left; ranges whose bound equals it are still opened, as
they may hold a tie of a smaller doc_id. A shard gives k documents a query at most, of which the k best of all are the result.

Only terms that a query has enter the index; that drops nothing that a score could see. Queries are read by the driver in blocks of
about BLOCK bytes of text; each block is one pass over the documents. Statistics cover all documents.

Defined results: null, empty and termless texts are no documents (they count in neither N nor L) and match nothing;
repeated rows of a doc_id are documents of their own; a null doc_id comes before others among ties; rows of one
item are one query, their distinct texts together; an item without terms, or without matches, has no rows; other columns are ignored; empty
tables give an empty result. A text of any length is one document.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, cut, slices

FAN = 16
#: Documents and index entries of a shard, at most.
SHARD, ENTRIES = 32_768, 3_000_000
#: Bytes of query texts that the driver reads at once, about.
BLOCK = 8 << 20
TOP = 10
_TERM_BYTES = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c > 127 else c + 32 if 65 <= c < 91 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TERM_BYTES).split()


def matches(docs: DataFrame, ids: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs) of every document with a term: its length, and the query terms in it with their occurrences."""
    held = docs.sparkSession.sparkContext.broadcast(ids)

    def run(batches):
        known = held.value
        for part in slices(batches, 4_000_000):
            names, sizes, found, often = [], [], [], []
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                words = terms(text)
                if not words:
                    continue
                tf = Counter(map(known.get, words))
                tf.pop(None, None)
                names.append(doc_id)
                sizes.append(len(words))
                found.append(sorted(tf))
                often.append([tf[t] for t in found[-1]])
            yield pa.record_batch([pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int32())), pa.array(often, pa.list_(pa.int64()))], ["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, n bigint, terms array<int>, tfs array<bigint>")


class Level:
    """Entries (node, term, greatest factor) of one width of ranges, by node; parents are ranges FAN times as wide."""

    def __init__(self, node: np.ndarray, term: np.ndarray, value: np.ndarray):
        self.term, self.value = term, value
        first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        self.nodes, self.starts = node[first], np.r_[first, len(node)]
        parent = self.nodes // FAN
        at = np.flatnonzero(np.r_[True, parent[1:] != parent[:-1]])
        self.spans = {int(parent[a]): (int(a), int(b)) for a, b in zip(at, np.r_[at[1:], len(parent)])}

    def wider(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The entries of ranges FAN times as wide."""
        node = np.repeat(self.nodes // FAN, np.diff(self.starts))
        order = np.lexsort((self.term, node))
        node, term = node[order], self.term[order]
        at = np.flatnonzero(np.r_[True, (node[1:] != node[:-1]) | (term[1:] != term[:-1])])
        return node[at], term[at], np.maximum.reduceat(self.value[order], at)

    def opened(self, parent: int, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The parts of a range that have an entry, and their sums of weight times factor."""
        a, b = self.spans[parent]
        begin, end = self.starts[a], self.starts[b]
        return self.nodes[a:b], np.add.reduceat(weights[self.term[begin:end]] * self.value[begin:end], self.starts[a:b] - begin)


class MaxTree:
    """Over the documents 0, 1, 2 ... of a shard; entries (doc, term, factor) are sorted by doc."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, factor: np.ndarray):
        self.levels = [Level(doc, term, factor)]
        while len(self.levels[-1].spans) > 1:
            self.levels.append(Level(*self.levels[-1].wider()))

    def search(self, weights: np.ndarray, k: int, order: list) -> list[tuple[int, int]]:
        """(score, doc) of the k best documents with a score above 0; order: rank of each document among ties, least first."""
        best: list[tuple[int, int, int]] = []
        top = len(self.levels) - 1
        queue = [(-math.inf, top, parent) for parent in self.levels[top].spans]
        while queue:
            bound, level, parent = heapq.heappop(queue)
            if len(best) == k and -bound < best[0][0]:
                break
            nodes, sums = self.levels[level].opened(parent, weights)
            least = best[0][0] if len(best) == k else 1
            for i in np.flatnonzero(sums >= max(least, 1)).tolist():
                node, score = int(nodes[i]), int(sums[i])
                if level:
                    heapq.heappush(queue, (-score, level - 1, node))
                else:
                    found = (score, -order[node], node)
                    if len(best) < k:
                        heapq.heappush(best, found)
                    elif found > best[0]:
                        heapq.heapreplace(best, found)
        return [(score, node) for score, _, node in best]


def factors(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    m = 25 + 75 * n * n_docs // n_terms
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def searched(found: DataFrame, queries: list[tuple[int, np.ndarray, np.ndarray]], n_known: int, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(query, doc_id, score): of each shard the k best of each query. queries: (number, terms, weights)."""
    held = found.sparkSession.sparkContext.broadcast(queries)

    def shard(parts: list[pa.RecordBatch]):
        table = pa.Table.from_batches(parts)
        names = table.column("doc_id").combine_chunks()
        lists, often = table.column("terms").combine_chunks(), table.column("tfs").combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        doc = np.repeat(np.arange(len(names)), sizes)
        if not len(doc):
            return
        n = np.repeat(table.column("n").to_numpy(), sizes)
        tree = MaxTree(doc, lists.flatten().to_numpy(), factors(often.flatten().to_numpy(), n, n_docs, n_terms))
        order = [-(1 << 63) - 1 if x is None else x for x in names.to_pylist()]
        weights = np.zeros(n_known, np.int64)
        out = []
        for number, its, w in held.value:
            weights[its] = w
            out += [(number, node, score) for score, node in tree.search(weights, k, order)]
            weights[its] = 0
        if out:
            number, node, score = zip(*out)
            yield pa.record_batch([pa.array(number, pa.int32()), names.take(pa.array(node)), pa.array(score, pa.int64())], ["query", "doc_id", "score"])

    def run(batches):
        rows, entries, parts = 0, 0, []
        for part in batches:
            for begin in range(0, part.num_rows, 2048):
                piece = part.slice(begin, 2048)
                parts.append(piece)
                rows += piece.num_rows
                entries += len(piece.column("terms").flatten())
                if rows >= SHARD or entries >= ENTRIES:
                    yield from shard(parts)
                    rows, entries, parts = 0, 0, []
        if parts:
            yield from shard(parts)

    return found.mapInArrow(run, "query int, doc_id bigint, score bigint")


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item."""
    spark = docs.sparkSession
    texts = items.filter("text IS NOT NULL").groupBy("item_id").agg(F.concat_ws(" ", F.array_sort(F.collect_set("text"))).alias("text"))
    blocks = 1 + (texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK
    out = None
    for block in range(blocks):
        got = texts.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()
        words = [Counter(terms(r.text)) for r in got]
        ids = {w: i for i, w in enumerate(sorted(set().union(*words)))}
        tables = Tables(spark)
        found = tables.cut(matches(docs, ids))
        n_docs, n_terms = found.agg(F.count(F.lit(1)), F.sum("n")).first()
        df = np.zeros(len(ids), np.int64)
        for r in found.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
            df[r.t] = r["count"]
        weight = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df]
        queries = []
        for i, counts in enumerate(words):
            its = np.array(sorted(ids[w] for w in counts), np.int64)
            if len(its):
                queries.append((i, its, np.array([counts[w] * weight[ids[w]] for w in sorted(counts, key=ids.get)], np.int64)))
        best = searched(found, queries, len(ids), n_docs, n_terms or 1, k)
        first = Window.partitionBy("query").orderBy(F.desc("score"), "doc_id")
        best = best.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)
        named = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(got)], f"query int, item_id {dict(items.dtypes)['item_id']}")
        done = cut(best.join(F.broadcast(named), "query").select("item_id", "rank", "doc_id", "score"))
        tables.drop()
        out = done if out is None else out.unionByName(done)
    return out
