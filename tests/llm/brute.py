"""Plain Python versions of the contracts, for small inputs."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lower(text):
    return (text or "").translate(LOW)


def contaminated(docs, items, k=10):
    windows = defaultdict(set)
    for item, text in items:
        w = ALNUM.findall(lower(text))
        for i in range(max(1, len(w) - k + 1) if w else 0):
            windows[tuple(w[i : i + k])].add(str(item) if item is not None else "null")
    lengths = sorted({len(x) for x in windows})
    out = []
    for doc, text in docs:
        w = ALNUM.findall(lower(text))
        hit, found = set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (x := tuple(w[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[x]
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def repeats(docs, k=20):
    """docs: (doc_id, text) -> (doc_id, n_words, n_removed, kept_sha256)."""
    seen, out = set(), []
    for doc, text in sorted(docs, key=lambda x: (x[0] is None, x[0] or 0)):
        w = WORD.findall(text or "")
        gone = set()
        for i in range(len(w) - k + 1):
            x = tuple(w[i : i + k])
            if x in seen:
                gone.update(range(i, i + k))
            seen.add(x)
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """sizes: {source: words} -> {source: target} by resharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, done = share * sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in done]
        if not open_:
            return done
        left = total - sum(done.values())
        given = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = [s for s in open_ if given[s] > most * sizes[s]]
        if not over:
            return done | given
        for s in over:
            done[s] = most * sizes[s]


def fingerprint(text, k=4):
    import xxhash

    w = [x.encode() for x in WORD.findall(lower(text))]
    shingles = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    ones = Counter(b for s in shingles for h in [xxhash.xxh64_intdigest(s, 42)] for b in range(64) if h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def components(prints, most=4):
    """prints: {doc_id: fingerprint} -> {doc_id: smallest doc_id reachable}."""
    ids = sorted(prints)
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[:n]:
            if (prints[a] ^ prints[b]).bit_count() <= most:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def held_out(doc_id, n, rest):
    return zlib.crc32(str(doc_id).encode()) % n == rest
