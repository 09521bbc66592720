"""Altered copies of licences: the index against a plain comparison of every text with every template."""

import math
import random
import re

from tapeloom.llm import license_scan
from tapeloom.llm.license_texts import TEMPLATES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(text.lower())


def altered(rng, w, share):
    """w with that share of its words dropped, replaced or preceded by another one."""
    out = []
    for x in w:
        if rng.random() < share:
            out += rng.choice([[], ["other"], ["new", x]])
        else:
            out.append(x)
    return out


def common(a, b, weight):
    """Weight of the heaviest common subsequence."""
    best = [0.0] * (len(b) + 1)
    for x in a:
        row = [0.0]
        for j, y in enumerate(b):
            row.append(best[j] + weight[x] if x == y else max(best[j + 1], row[j]))
        best = row
    return best[-1]


def test_altered_copies(spark):
    rng = random.Random(3)
    vocab = ["".join(rng.choice("bdgklmnprstuvw") for _ in range(6)) for _ in range(300)] + ["the", "of", "software", "license", "and", "this", "is"]
    prose = lambda n: [rng.choice(vocab) for _ in range(n)]
    docs, planted = [], []
    for label, text, _ in TEMPLATES:
        for share in (0, 0.04, 0.08, 0.12):
            planted.append((len(docs), label, share))
            docs.append(prose(rng.randint(0, 30)) + altered(rng, words(text), share) + prose(rng.randint(0, 30)))
    clean = len(docs)
    docs += [prose(rng.randint(5, 200)) for _ in range(60)]
    whole = {w for d in docs for w in d}
    df = {w: sum(w in set(d) for d in docs) for w in whole}
    weight = {w: math.log((len(docs) + 2) / (df.get(w, 0) + 1)) for _, t, _ in TEMPLATES for w in words(t)}
    table = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: {s["label"] for s in r["spans"]} for r in license_scan.scan(table).collect()}
    want = {}
    for i, d in enumerate(docs):
        line = " " + " ".join(d) + " "
        want[i] = {
            label
            for label, text, phrases in TEMPLATES
            if any(f" {p} " in line for p in phrases) and common(words(text), d, weight) >= 0.6 * sum(weight[w] for w in words(text))
        }
    assert all(got[i] <= want[i] for i in want)
    assert not any(got[i] for i in range(clean, len(docs)))
    pairs = [(i, x) for i in want for x in want[i]]
    recall = sum(x in got[i] for i, x in pairs) / len(pairs)
    found = {s: sum(label in got[i] for i, label, x in planted if x == s) / len(TEMPLATES) for s in (0, 0.04, 0.08, 0.12)}
    print("recall against brute force", round(recall, 3), "of", len(pairs), "planted copies found, by share of altered words", found)
    assert recall >= 0.9 and found[0] == 1


def test_places_and_long_texts(spark):
    mit = next(t for label, t, _ in TEMPLATES if label == "mit" and len(t) > 500)
    far = "lorem ipsum " * 450_000  # beyond the size of a chunk
    rows = [(1, far + mit + far), (2, mit), (3, mit + " " + mit), (4, None), (5, ""), (6, far)]
    got = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    at = {i: [(s["label"], s["word"], s["share"]) for s in r["spans"]] for i, r in got.items()}
    n = len(words(mit))
    assert at == {1: [("mit", 900_000, 1.0)], 2: [("mit", 0, 1.0)], 3: [("mit", 0, 1.0), ("mit", n, 1.0)], 4: [], 5: [], 6: []}
    assert got[4]["score"] == got[6]["score"] == 0 and got[3]["labels"] == "mit" and got[1]["n_words"] == 1_800_000 + n
