"""The stages against plain versions of what they decide, each on its own input."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from tapeloom.llm import corpus, quality_rules

from . import brute


def test_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [docs]
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], sf).write.parquet(f"{tmp_path}/{n}")
        seen.append(spark.read.parquet(f"{tmp_path}/{n}"))
    good, single, clean, mixed, shards = seen[1:]
    assert all(x.columns == docs.columns for x in seen[1:5])

    rules = quality_rules.cascade(quality_rules.RULES, quality_rules.Values(quality_rules.text_of(docs)))
    want = {r[0] for r in docs.filter(rules.isNull()).select("doc_id").collect()}
    assert {r[0] for r in good.select("doc_id").collect()} == want

    linked = brute.set_join([tuple(r) for r in good.select("doc_id", "text").collect()], 5, 80)
    assert {r[0] for r in single.select("doc_id").collect()} == {c for _, c in linked.values()}

    def grams(t):
        w = [x for x in "".join(c if c.isalnum() else " " for c in t.lower()).split()]
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    items = [grams(r[0]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("text").collect()]
    leak = {r[0] for r in single.select("doc_id", "text").collect() for g in [grams(r[1])] if any(i and len(i & g) >= 0.8 * len(i) for i in items)}
    assert {r[0] for r in clean.select("doc_id").collect()} == {r[0] for r in single.select("doc_id").collect()} - leak

    copies = Counter(r[0] for r in mixed.select("doc_id").collect())
    assert max(copies.values()) <= 2 and set(copies) <= {r[0] for r in clean.select("doc_id").collect()}
    sizes = {r[0]: r[1] for r in clean.groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).collect()}
    taken = {r[0]: r[1] for r in mixed.groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).collect()}
    for s, t in brute.targets(sizes).items():
        assert abs(taken.get(s, 0) - t) <= 0.05 * t + 60

    assert Counter(r[0] for r in shards.select("doc_id").collect()) == copies
    n = Counter(r[0] for r in shards.select("shard").collect())
    assert max(n.values()) - min(n.values()) <= 1


def test_rows_that_repeat(spark):
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(1, text, "en", "a", 1), (1, text, "en", "a", 1), (2, text + " more", "en", "a", 1), (None, text + " other end", "en", None, 1), (3, "quite another text with enough words to be kept by all rules", "en", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    single = corpus.near_duplicates(spark, docs, "")
    assert sorted(map(str, (r["doc_id"] for r in single.collect()))) == ["1", "3", "None"]
    mixed = corpus.mixture(spark, docs, "")
    n = Counter(r["doc_id"] for r in mixed.collect())
    assert mixed.columns == docs.columns and n[1] <= 4 and all(n[i] <= 2 for i in (2, 3, None))
