"""Plain versions of the corpus operators, for small inputs."""

import collections
import hashlib
import math
import re
import zlib


def components(rows, words=3, percent=85):
    """doc_id -> (set size, least reachable doc_id)."""
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = frozenset(tuple(w[k : k + words]) for k in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else [])
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    holders = collections.defaultdict(list)
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    for i, s in sets.items():
        for j, n in collections.Counter(j for g in s for j in holders[g] if j > i).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {i: (len(s), top(i)) for i, s in sets.items()}


def kept_bytes(rows, length=100):
    """doc_id -> (bytes, removed, runs, what is left)."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        d = (t or "").encode()
        gone = bytearray(len(d))
        for p in range(len(d) - length + 1):
            w = d[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        left = bytes(b for b, g in zip(d, gone) if not g)
        out[i] = (len(d), sum(gone), sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone)), left)
    return out


def rule_figures(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = collections.defaultdict(list)
    for k in range(len(words) - 7):
        windows[tuple(words[k : k + 8])].append(k)
    again = {k + j for places in windows.values() if len(places) > 1 for k in places for j in range(8)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again), n < 20 or 100 * len(again) > 30 * n


def digest(b):
    return hashlib.sha256(b).hexdigest()


def crc(b):
    return zlib.crc32(b)


def context_tree(rows, depth):
    """[(tokens, known, N, base score, score, bytes)] of (doc_id, text) rows, by the recursion as it is written."""
    learned = [zlib.crc32(str("" if i is None else i).encode()) % 7 != 2 for i, _ in rows]
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode().split() for _, t in rows]
    data = [b" ".join(w) + b"\n" for w in words]
    count = collections.defaultdict(lambda: [0, 0])
    steps = lambda d: (((b"\n" * depth + d)[i : i + depth], c) for i, c in enumerate(d))
    for d, use in zip(data, learned):
        for context, c in steps(d) if use else ():
            for j in range(8):
                for k in range(depth + 1):
                    count[context[depth - k :], j, c >> (8 - j)][c >> (7 - j) & 1] += 1
    children = collections.defaultdict(set)
    for context, j, node in count:
        if context:
            children[context[1:], j, node].add((context, j, node))
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    known = {}

    def weighted(key):
        if key not in known:
            own = kt(*count[key])
            if len(key[0]) == depth:
                known[key] = own, 1.0
            else:
                below = sum(weighted(k)[0] for k in children[key])
                most = max(own, below)
                total = most + math.log(math.exp(own - most) + math.exp(below - most)) - math.log(2)
                known[key] = total, math.exp(own - math.log(2) - total)
        return known[key]

    def bit(context, j, c):
        p = 0.5
        for k in range(depth, -1, -1):
            key = (context[depth - k :], j, c >> (8 - j))
            if key in count:
                zeros, ones = count[key]
                own = ((ones if c >> (7 - j) & 1 else zeros) + 0.5) / (zeros + ones + 1)
                share = weighted(key)[1]
                p = share * own + (1 - share) * p
        return p

    often = collections.Counter()
    for w, use in zip(words, learned):
        if use:
            often.update([*w, None])
    total = sum(often.values())
    out = []
    for w, d in zip(words, data):
        c = [often.get(x, 0) for x in [*w, None]]
        out.append((len(c), sum(x > 0 for x in c), total, sum(math.log10((x + 1) / (total + len(often) + 1)) for x in c), sum(math.log10(bit(context, j, b)) for context, b in steps(d) for j in range(8)), len(d)))
    return out


def ranking(docs, items, k=10):
    """Rows (item, rank, doc_id, score), every document scored for every item."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(i, collections.Counter(w)) for i, t in docs if (w := split(t))]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = collections.Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in held:
            n = sum(c.values())
            m = 100 - 75 + (75 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in split(text) if t in c)
            if score > 0:
                scores.append((-score, i is not None, i or 0))
        out += [(item, r, i if there else None, -s) for r, (s, there, i) in enumerate(sorted(scores)[:k], 1)]
    return out
