"""Numbers of links against plain Python and SQL, with components whole and cut into blocks."""

import pytest

import __spark_entry__
from tapeloom.llm import set_join

from ..compare import connect, differences


def plain(docs, k, percent):
    sets = []
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    linked = lambda x, y: bool(x) and 100 * len(x & y) >= percent * len(x | y)
    return sorted((i, sum(a != b and linked(x, y) for b, y in enumerate(sets))) for a, ((i, _), x) in enumerate(zip(docs, sets, strict=True)))


def near_copies():
    """A chain: every text differs from the next by one word, so that links reach farther than similarity."""
    words = [f"w{i}" for i in range(80)]
    return [(1000 + n, " ".join([f"x{i}" if i < n else w for i, w in enumerate(words)])) for n in range(40)]


@pytest.mark.parametrize("block", [512, 7])
def test_links_inside_components(spark, data, monkeypatch, block):
    monkeypatch.setattr(set_join, "BLOCK", block)
    docs = [(i, t) for i, t, *_ in data] + near_copies()
    docs += [docs[-1], (2000, docs[-1][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = sorted((r["doc_id"], r["n_links"]) for r in set_join.link(df, 4, 85, links=True).collect())
    assert got == plain(docs, 4, 85) and max(n for _, n in got) > 5


def test_links_odd(odd, none, data):
    rows = set_join.link(odd, 4, 85, links=True).collect()
    assert len(rows) == len(data) + 4 and all(r["n_links"] == 0 for r in rows if r["doc_id"] is None)
    assert set_join.link(none, 4, 85, links=True).count() == 0


def test_links_equal_sql(spark):
    name, sf = "op3_ngram_jaccard_join", "/root/testdata/sf0.001"
    assert differences(spark, connect(sf), sf, __spark_entry__.queries()[name], __spark_entry__.oracle_sql()[name]) == ""
