"""Maximal repeats against a listing of all substrings, and removal against plain Python, with small chunks and groups."""

import random

import pytest

from tapeloom.llm import repeats

from . import brute


def texts(seed):
    rng = random.Random(seed)
    vocab = [f"v{i}" for i in range(40)]
    base = [[rng.choice(vocab) for _ in range(rng.randint(20, 60))] for _ in range(4)]
    out = []
    for i in range(36):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        lo = rng.randint(0, 6)
        w = w[lo:] + [rng.choice(vocab) for _ in range(rng.randint(0, 8))]
        out.append((i, " ".join(w + w[:25] if i % 9 == 0 else w)))
    return [*out, (36, out[3][1]), (37, None), (38, "")]


def plain(docs, window):
    """All substrings of window words or more that repeat after different and before different words."""
    words = {i: (t or "").split() for i, t in docs}
    where = {}
    for i, w in words.items():
        for a in range(len(w)):
            for b in range(a + window, len(w) + 1):
                where.setdefault(tuple(w[a:b]), []).append((i, a, b))
    out = set()
    for places in where.values():
        left = [words[i][a - 1] if a else (i, a) for i, a, _ in places]
        right = [words[i][b] if b < len(words[i]) else (i, a) for i, a, b in places]
        if len(set(left)) > 1 and len(set(right)) > 1:
            owner = min(i for i, _, _ in places)
            out |= {(i, a, b - a, owner) for i, a, b in places if owner < i}
    best = {}
    for i, a, n, owner in out:
        best[i, a, owner] = max(n, best.get((i, a, owner), 0))
    steps = {(i, a, n, o) for (i, a, o), n in best.items()}
    return {(i, a, n, o) for i, a, n, o in steps if not any(x == i and y == a and m > n and p <= o for x, y, m, p in steps)}


@pytest.mark.parametrize(("seed", "limit", "chunk"), [(1, 1 << 20, 4 << 20), (2, 60, 300), (3, 200, 900)])
def test_maximal_repeats(spark, seed, limit, chunk):
    docs = texts(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {tuple(r) for r in repeats.maximal_repeats(df, 13, chunk_bytes=chunk, group_windows=limit).collect()}
    want = plain(docs, 13)
    assert got == want and max(n for _, _, n, _ in want) > 25
    kept = {r[0]: tuple(r[1:]) for r in repeats.drop_repeats(df, 13, chunk_bytes=chunk, group_windows=limit).select("doc_id", "n_words", "n_removed", "text").collect()}
    assert kept == brute.drop_repeats(docs, 13)


def test_a_very_long_text(spark):
    """Texts beyond the chunk size and the slice size of several MB, one inside the other."""
    rng = random.Random(4)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(400_000))
    docs = [(1, "a " + long), (2, long[: 2 << 20].rpartition(" ")[0] + " end"), (3, "b c")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = {r["doc_id"]: (r["n_words"], r["n_removed"], r["text"]) for r in repeats.drop_repeats(df, 13, chunk_bytes=1 << 20).collect()}
    n = len(docs[1][1].split()) - 1
    assert rows[2] == (n + 1, n, "end") and rows[1][1] == 0 and rows[3] == (2, 0, "b c")


def test_tree_of_equal_and_nested_suffixes():
    word = lambda x: bytes([0, 0, 0, 0, x])
    s = [b"".join(map(word, x)) for x in ([1, 2, 3], [1, 2, 3], [1, 2], [1, 2, 3, 4], [1, 5])]
    import numpy as np

    t = repeats.Tree(s, np.array([7, 8, 7, 7, 9]), np.array([4, 3, 2, 5, 1]), np.ones(5, np.int64), 2)
    assert t.steps(0) == [(3, 3), (2, 2)] and t.steps(3) == [(3, 3), (2, 2)] and t.steps(2) == [(2, 2)] and t.steps(4) == []
