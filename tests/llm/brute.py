"""Plain Python versions of the contracts, for small fixtures."""

import re
import zlib
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def quality(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    spans = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often = Counter(spans)
    hit = {i + k for i, x in enumerate(spans) if often[x] > 1 for k in range(5)}
    failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit), failed


def targets(sizes):
    """sizes: {source: words} -> {source: target}."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, full = 1.5 * sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in full]
        if not rest:
            return full
        level = (total - sum(full.values())) / sum(weight[s] for s in rest)
        over = [s for s in rest if level * weight[s] > 2 * sizes[s]]
        if not over:
            return full | {s: level * weight[s] for s in rest}
        full |= {s: 2.0 * sizes[s] for s in over}


def crc(text):
    return zlib.crc32((text or "").encode())


def set_join(docs, k, percent):
    """docs: [(id, text)] -> {id: (n_shingles, component_id)}."""
    sets = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    where = {}
    for i, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(i)
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in sets.items():
        seen = Counter(j for x in s for j in where[x] if j < i)
        for j, n in seen.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(s), root(i)) for i, s in sets.items()}


def drop_repeats(docs, window):
    """docs: [(id, text)] with distinct ids -> {id: (n_words, n_removed, kept text)}."""
    owner = {}
    for i, t in sorted(docs):
        w = (t or "").encode().split()
        for j in range(len(w) - window + 1):
            owner.setdefault(tuple(w[j : j + window]), i)
    out = {}
    for i, t in docs:
        w = (t or "").encode().split()
        gone = {j + x for j in range(len(w) - window + 1) if owner[tuple(w[j : j + window])] < i for x in range(window)}
        out[i] = len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()
    return out
