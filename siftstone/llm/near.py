"""MinHash near-dedup by chosen-path set similarity join.

Sets. A text's words are lower-cased (A-Z) runs of other characters than blanks; its set holds the hashes of the distinct
three-word shingles. Equal sets form a class, of which only the least doc_id (its representative) goes on.

Trees. Each of TREES independent trees starts by choosing BRANCHES minwise coordinates; a representative goes to the node
named by each coordinate and its value. Nodes of up to SMALL members are compared exhaustively. A larger node chooses
BRANCHES coordinates again, by a hash of its path, and passes its members on, to DEPTH levels. Branching parts texts that
share a passage, but not near copies: where DENSE of a large node's members are likely copies of its pivot, and at the last
level, members are written as their difference from what a sample of the node has in common: the common tokens they miss and
the others they have. Members outside the node's largest component are then compared with all others by these short lists,
exactly, after a bound from the lists' lengths; only links come out. A linked pair (similarity 0.85) stays together through a level with probability
1 - 0.15 ** 2, and it takes all TREES * BRANCHES first coordinates to part it at once: 0.15 ** 8 = 3e-7; where two more levels
follow everywhere, (1 - 0.85 * 0.9775 ** 2) ** 8 = 2e-6. Such a pair is lost if no chain of other links joins its texts.

Groups of near copies would make every pair of a node a candidate. So each node is first compared with one pivot of its
own, in two rounds with fresh pivots; verified links give components, and from then on only members of different
components are compared, and a node that holds one component only is done. That loses no component: a pair within one
component adds nothing to it.

Candidates pass an estimate on 128 minwise values of 8 bits (4.7 standard deviations under the threshold at least, 0.70 for
0.85: one linked pair in a million falls short) and are then confirmed on the full sets, 100 * |A and B| >= 85 * |A or B|.

Nothing of this is collected by the driver. Sums are made before shuffles; joins of hot nodes are ordinary equi-joins that
adaptive execution splits; steps end in tables in the shared folder.

Defined results: null, empty and blank texts have the empty set and are alone; repeated rows of a doc_id are one vertex,
and each gets the same component; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tables, cut, mix64, release, slices, tidy
from .hashed import Cache

WORDS = 3
PERCENT = 85
TREES, BRANCHES, DEPTH, SMALL = 4, 2, 3, 48
COORDINATES = 128
#: Standard deviations that an estimate may fall short of the threshold.
SHORT = 4.7
DENSE = 0.1
#: Members of a node that show what its members have in common, and how many of them have a common token at least.
SEEN, COMMON = 16, 4
ROUNDS = 2
#: Nodes with more than one part in HOT of all rows, and more than LARGE members, are joined by broadcast.
HOT, LARGE = 500, 200
u64 = np.uint64

_TIMES = mix64(np.arange(1, 64)) | u64(1)
_SEEDS = mix64(np.arange(101, 101 + COORDINATES)) | u64(1)


def agreement(percent: int) -> float:
    """Share of equal signature places that a likely pair has at least."""
    p = percent / 100
    return p - SHORT * (p * (1 - p) / COORDINATES) ** 0.5


def word_cache() -> Cache:
    return Cache(lambda w: xxhash.xxh64_intdigest(w))


def shingle_set(text: str | None, ids: Cache, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles: runs of `words` words, or the whole sequence of fewer; empty without words."""
    found = (text or "").encode().lower().split()
    n = len(found)
    if not n:
        return np.zeros(0, u64)
    x = np.fromiter(map(ids.__getitem__, found), u64, n)
    if n < words:
        return mix64(np.array([(x * _TIMES[:n]).sum() + u64(n)], u64))
    h = np.zeros(n - words + 1, u64)
    for i in range(words):
        h += x[i : n - words + 1 + i] * _TIMES[i]
    return np.unique(mix64(h))


def min_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """(sets x COORDINATES) least hashes, 32 bits each; no set may be empty."""
    joined, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), COORDINATES), np.uint32)
    for j, seed in enumerate(_SEEDS):
        h = joined * seed
        h ^= h >> u64(32)
        h *= u64(0xD6E8FEB86659FD93)
        out[:, j] = np.minimum.reduceat(h, starts) >> u64(32)
    return out


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n_shingles, k1, k2, nodes, sig): a 128-bit name of the set, the nodes of all trees' first level, 8 bits of each minwise value."""
    names = ["doc_id", "n_shingles", "k1", "k2", "nodes", "sig"]

    def run(batches):
        release()
        ids = word_cache()
        for part in slices(batches, 2_000_000):
            ids.trim()
            sets = [shingle_set(t, ids, words) for t in part.column(1).to_pylist()]
            full = [s for s in sets if len(s)]
            least = min_hashes(full) if full else np.zeros((0, COORDINATES), np.uint32)
            first = least[:, : TREES * BRANCHES].astype(u64)
            nodes = mix64(first + (np.arange(1, TREES * BRANCHES + 1, dtype=u64) << u64(40))).view(np.int64)
            sig = least.astype(np.uint8)
            rows, at = [], 0
            for s in sets:
                if len(s):
                    key = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
                    rows.append((len(s), int(key[0]), int(key[1]), nodes[at].tolist(), sig[at].tobytes()))
                    at += 1
                else:
                    rows.append((0, None, None, None, None))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
            yield pa.record_batch([part.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_shingles bigint, k1 bigint, k2 bigint, nodes array<bigint>, sig binary")


def stored_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(id, set) of the wanted doc_ids: the upper 40 bits of each shingle hash, in order.

    The ids grow with the documents, so they are joined by a shuffle at every size, also where a broadcast would do yet.
    """

    def run(batches):
        ids = word_cache()
        for part in slices(batches, 2_000_000):
            ids.trim()
            sets = [(shingle_set(t, ids, words) >> u64(24) << u64(24)).astype(">u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes() for t in part.column(1).to_pylist()]
            yield pa.record_batch([part.column(0), pa.array(sets, pa.binary())], ["id", "set"])

    return docs.select("doc_id", "text").join(wanted.withColumnRenamed("id", "doc_id").hint("merge"), "doc_id", "left_semi").mapInArrow(run, "id bigint, set binary")


def opened(packed: bytes) -> np.ndarray:
    wide = np.zeros((len(packed) // 5, 8), np.uint8)
    wide[:, 3:] = np.frombuffer(packed, np.uint8).reshape(-1, 5)
    return wide.view(">u8").ravel().astype(u64)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    with_b = pairs.join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b")
    both = with_b.join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a").select("a", "b", "set_a", "set_b")

    def run(batches):
        release()
        for part in batches:
            held: dict[bytes, np.ndarray] = {}
            keep = []
            for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                n, m = len(x) // 5, len(y) // 5
                if 100 * min(n, m) < percent * max(n, m):
                    keep.append(False)
                    continue
                p = held.get(x)
                if p is None:
                    held = {x: opened(x)}
                    p = held[x]
                q = opened(y)
                at = np.searchsorted(p, q)
                common = int((p[np.minimum(at, n - 1)] == q).sum())
                keep.append(100 * common >= percent * (n + m - common))
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a bigint, b bigint")


def likely(pairs: DataFrame, reps: DataFrame, agree: float) -> DataFrame:
    """The pairs whose signatures agree in this share of their places at least."""
    sig = lambda k: reps.select(F.col("rep").alias(k), F.col("sig").alias(f"sig_{k}"))
    both = pairs.join(sig("b"), "b").join(sig("a"), "a").select("a", "b", "sig_a", "sig_b")

    def run(batches):
        for part in batches:
            if part.num_rows:
                x, y = (np.frombuffer(b"".join(part.column(i).to_pylist()), np.uint8).reshape(-1, COORDINATES) for i in (2, 3))
                yield part.select(["a", "b"]).filter(pa.array((x == y).sum(1) >= agree * COORDINATES))

    return both.mapInArrow(run, "a bigint, b bigint")


def components(edges: DataFrame, tables: Tables) -> DataFrame:
    """(id, comp): the least id of each connected component, for every id that an edge names. Alternates large-star and small-star steps until every id hangs on one least id that hangs on nothing."""
    now = tables.cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    while True:
        both = now.select("u", "v", F.lit(1).alias("down")).unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"), F.lit(0).alias("down")))
        least = tables.cut(both.groupBy("u").agg(F.min("v").alias("m"), F.sum("down").alias("down"), F.count(F.lit(1)).alias("n")))
        if least.filter("down > 1 OR (down > 0 AND down < n)").isEmpty():
            return least.select(F.col("u").alias("id"), F.least("u", "m").alias("comp"))
        large = both.join(least.select("u", F.least("u", "m").alias("m")), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = tables.cut(large)
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        now = large.join(lower, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(lower.select("u", F.col("m").alias("v")))
        now = tables.cut(now.distinct())


def attached(rows: DataFrame, facts: DataFrame, tables: Tables) -> DataFrame:
    """rows joined by node to facts (node, n, ...), which sum up rows of these nodes.

    A node with more than one part in HOT of the rows would be one long task; there are HOT such nodes at most, so their
    facts are broadcast. The others are joined by a shuffle.
    """
    facts = tables.cut(facts)
    total, top = facts.agg(F.sum("n"), F.max("n")).first()
    most = max(LARGE, (total or 0) // HOT)
    if (top or 0) <= most:
        return rows.join(facts, "node")
    hot = F.broadcast(facts.filter(F.col("n") > most))
    rest = rows.join(hot.select("node"), "node", "left_anti").join(facts.filter(F.col("n") <= most), "node")
    return rows.join(hot, "node").unionByName(rest)


def with_components(members: DataFrame, comps: DataFrame | None, tables: Tables) -> DataFrame:
    """(node, rep, comp, n): members of nodes with their components; nodes that hold one component only are left out."""
    rows = members.select("node", "rep")
    if comps is not None:
        rows = rows.join(comps.select(F.col("id").alias("rep"), "comp"), "rep", "left")
        rows = tables.cut(rows.withColumn("comp", F.coalesce("comp", "rep")))
    else:
        rows = rows.withColumn("comp", F.col("rep"))
    return sized(rows, tables)


def stars(rows: DataFrame, turn: int, tables: Tables) -> DataFrame:
    """Pairs of each node's pivot of this turn with the members of other components."""
    order = F.xxhash64("node", "rep", F.lit(turn))
    pivots = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min_by("rep", order).alias("p"), F.min_by("comp", order).alias("q"))
    return attached(rows.drop("n"), pivots, tables).filter("comp <> q").select(F.least("rep", "p").alias("a"), F.greatest("rep", "p").alias("b")).distinct()


def agreeing(agree: float, sigs: np.ndarray, comp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places i < j of pairs of different components whose signatures agree often enough."""
    counts = np.stack([(s == sigs).sum(1) for s in sigs])
    return np.nonzero(np.triu((counts >= agree * COORDINATES) & (comp[:, None] != comp[None, :]), 1))


def grouped(batches, key: int = 0):
    """Runs of rows with equal keys, from batches that are sorted by it."""
    rest = None
    for part in batches:
        if rest is not None and rest.num_rows:
            part = pa.Table.from_batches([rest, part]).combine_chunks().to_batches()
            part = part[0] if part else rest
        if not part.num_rows:
            continue
        keys = part.column(key).to_numpy()
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        for a, b in zip(np.r_[0, cuts[:-1]], cuts) if len(cuts) else ():
            yield part.slice(int(a), int(b - a))
        rest = part.slice(int(cuts[-1]) if len(cuts) else 0)
    if rest is not None and rest.num_rows:
        yield rest


def _sigs(group) -> np.ndarray:
    return np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint8).reshape(-1, COORDINATES)


def exhaustive(rows: DataFrame, agree: float) -> DataFrame:
    """Likely pairs of different components in nodes of up to SMALL members; rows: node, rep, comp, sig."""

    def run(batches):
        release()
        for g in grouped(batches):
            rep = g.column("rep").to_numpy()
            i, j = agreeing(agree, _sigs(g), g.column("comp").to_numpy())
            if len(i):
                yield pa.record_batch([pa.array(np.minimum(rep[i], rep[j])), pa.array(np.maximum(rep[i], rep[j]))], ["a", "b"])

    dealt = rows.select("node", "rep", "comp", "sig").repartition("node").sortWithinPartitions("node")
    return dealt.mapInArrow(run, "a bigint, b bigint").filter("a < b").distinct()


def children(rows: DataFrame, level: int) -> DataFrame:
    """(node, rep, comp): each member goes on to BRANCHES nodes, named by the coordinates that its node chooses. rows: node, rep, comp, sig."""

    def child(k: int) -> Column:
        choice = F.xxhash64("node", F.lit(level), F.lit(k))
        at = (F.pmod(choice, F.lit(COORDINATES - TREES * BRANCHES)) + (TREES * BRANCHES + 1)).cast("int")
        return F.xxhash64(choice, F.substring(F.col("sig"), at, F.lit(1)))

    return rows.select(F.explode(F.array(*map(child, range(BRANCHES)))).alias("node"), "rep", "comp")


def sized(rows: DataFrame, tables: Tables) -> DataFrame:
    """(node, rep, comp, n): rows of nodes with two components at least, and the node's size. rows: a table."""
    found = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("node", "n")
    return attached(rows, found, tables)


def density(rows: DataFrame, reps: DataFrame, agree: float, tables: Tables) -> DataFrame:
    """rows with dense: whether many members of the node are likely copies of its pivot."""
    pivots = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min_by("rep", F.xxhash64("node", "rep", F.lit(-1))).alias("p"))
    pivots = pivots.join(reps.select(F.col("rep").alias("p"), F.col("sig").alias("sig_p")), "p")

    def run(batches):
        for part in batches:
            if part.num_rows:
                x, y = (np.frombuffer(b"".join(part.column(i).to_pylist()), np.uint8).reshape(-1, COORDINATES) for i in (1, 2))
                yield pa.record_batch([part.column(0), pa.array(((x == y).sum(1) >= agree * COORDINATES).astype(np.int32))], ["node", "near"])

    near = attached(rows.select("node", "sig"), pivots.select("node", "n", "sig_p"), tables).select("node", "sig", "sig_p").mapInArrow(run, "node bigint, near int")
    found = near.groupBy("node").agg(F.count(F.lit(1)).alias("n"), (F.avg("near") >= DENSE).alias("dense"))
    return tables.cut(attached(rows.drop("n"), found, tables))


def differing_pairs(rows: DataFrame, sets: DataFrame, percent: int, tables: Tables) -> DataFrame:
    """The linked pairs of a node's members of different components, from the members' differences from the node's common tokens. rows: node, n, rep, comp."""
    # About SEEN members of each node, by a hash; which ones decides the work only.
    shown = rows.filter(F.pmod(F.xxhash64("rep", "node"), F.col("n")) < SEEN)
    seen = shown.select("node", "rep").join(sets.withColumnRenamed("id", "rep"), "rep").groupBy("node").agg(F.collect_list("set").alias("seen"))

    def common(batches):
        for part in batches:
            out = []
            for group in part.column("seen").to_pylist():
                tokens, n = np.unique(np.concatenate([opened(x) for x in group]), return_counts=True)
                out.append(tokens[n >= COMMON].tobytes())
            yield pa.record_batch([part.column("node"), pa.array(out, pa.binary())], ["node", "common"])

    def differences(batches):
        for part in batches:
            out = []
            for packed, shared in zip(part.column("set").to_pylist(), part.column("common").to_pylist()):
                tokens, usual = opened(packed), np.frombuffer(shared, u64)
                out.append((len(tokens), len(usual), usual[~np.isin(usual, tokens)].view(np.int64).tolist(), tokens[~np.isin(tokens, usual)].view(np.int64).tolist()))
            columns = list(zip(*out)) if out else [(), (), (), ()]
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.record_batch([*part.columns[:3], *(pa.array(c, k) for c, k in zip(columns, kinds))], ["node", "rep", "comp", "size", "usual", "miss", "rare"])

    sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    usual = sizes.join(seen.mapInArrow(common, "node bigint, common binary"), "node", "left").select("node", "n", F.coalesce("common", F.lit(b"")).alias("common"))
    full = attached(rows.select("node", "rep", "comp").join(sets.withColumnRenamed("id", "rep"), "rep"), usual, tables).select("node", "rep", "comp", "set", "common")
    held = tables.cut(full.mapInArrow(differences, "node bigint, rep bigint, comp bigint, size bigint, usual bigint, miss array<bigint>, rare array<bigint>"))
    largest = held.groupBy("node", "comp").agg(F.count(F.lit(1)).alias("c")).groupBy("node").agg(F.sum("c").alias("n"), F.max_by("comp", F.struct("c", "comp")).alias("giant"))
    # plain: tokens that are common ones; a pair's overlap is plain_a + plain_b - usual + misses and others that they share.
    held = attached(held, largest, tables).select(
        "node", "rep", "comp", "size", "usual", (F.col("size") - F.size("rare")).alias("plain"), "miss", "rare", F.size("miss").alias("n_miss"), F.size("rare").alias("n_rare"), (F.col("comp") == F.col("giant")).alias("in_giant")
    )
    a = held.filter("NOT in_giant").select("node", *[F.col(c).alias(f"{c}_a") for c in ("rep", "comp", "size", "plain", "miss", "rare", "n_miss", "n_rare")])
    linked = "100 * ({0}) >= " + str(percent) + " * (size + size_a - ({0}))"
    most = linked.format("plain + plain_a - usual + least(n_miss, n_miss_a) + least(n_rare, n_rare_a)")
    exact = linked.format("plain + plain_a - usual + size(array_intersect(miss, miss_a)) + size(array_intersect(rare, rare_a))")
    found = a.join(held, "node").filter(f"comp <> comp_a AND (in_giant OR rep_a < rep) AND {most} AND {exact}")
    return found.select(F.least("rep", "rep_a").alias("a"), F.greatest("rep", "rep_a").alias("b")).distinct()


def path_pairs(members: DataFrame, reps: DataFrame, sets: DataFrame, percent: int, tables: Tables) -> DataFrame:
    """Pairs across components that may be linked, from all nodes: small ones exhaustively, larger ones along chosen paths, dense ones by their differences. members: node, rep, comp, n."""
    agree, signs = agreement(percent), reps.select("rep", "sig")
    rows, out = tables.cut(members), None
    for level in range(1, DEPTH + 1):
        found = exhaustive(rows.filter(F.col("n") <= SMALL).join(signs, "rep"), agree)
        out = found if out is None else out.unionByName(found)
        large = rows.filter(F.col("n") > SMALL)
        if large.isEmpty():
            break
        if level == DEPTH:
            out = out.unionByName(differing_pairs(large, sets, percent, tables))
            break
        # Signatures are joined anew at each level: only node, rep and comp are moved on.
        large = density(tables.cut(large.join(signs, "rep")), reps, agree, tables)
        out = out.unionByName(differing_pairs(large.filter("dense"), sets, percent, tables))
        rows = tables.cut(sized(tables.cut(children(large.filter("NOT dense"), level)), tables))
        tidy(rows.sparkSession)
    return out


def linked(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs."""
    tables = Tables(docs.sparkSession)
    sigs = tables.cut(signatures(docs, words))
    classes = sigs.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"))
    named = cut(sigs.select("doc_id", "n_shingles", "k1", "k2").join(classes, ["k1", "k2"], "left").select("doc_id", "n_shingles", "rep"))
    reps = tables.bucketed(sigs.join(classes, ["k1", "k2"]).filter("doc_id = rep").select("rep", "nodes", "sig").dropDuplicates(["rep"]), "rep")
    members = reps.select("rep", F.explode("nodes").alias("node"))
    members = tables.cut(attached(members, members.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), tables))
    sets = tables.bucketed(stored_sets(docs, members.select(F.col("rep").alias("id")).distinct(), words), "id")
    # Rows of one doc_id with different texts are one vertex.
    twice = named.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select(F.col("doc_id").alias("b"))
    edges = tables.cut(named.filter("rep <> doc_id").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).join(twice, "b").select("a", "b"))
    comps = None
    for turn in range(ROUNDS + 1):
        rows = with_components(members, comps, tables)
        pairs = likely(stars(rows, turn, tables), reps, agreement(percent)) if turn < ROUNDS else path_pairs(rows, reps, sets, percent, tables)
        # Components so far stand for the edges that made them.
        edges = edges.unionByName(confirmed(pairs.distinct(), sets, percent))
        steps = Tables(docs.sparkSession)
        comps = (cut if turn == ROUNDS else tables.cut)(components(edges, steps))
        steps.drop()
        edges = comps.select(F.col("id").alias("a"), F.col("comp").alias("b"))
        tidy(docs.sparkSession)
    tables.drop()
    return (
        named.select("doc_id", "n_shingles", "rep")
        .join(comps.withColumnRenamed("id", "rep"), "rep", "left")
        .select("doc_id", "n_shingles", F.coalesce("comp", "rep", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))
    )


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs but those whose near copy with a smaller doc_id stays; rows without a doc_id stay."""
    gone = linked(docs, words, percent).filter("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
