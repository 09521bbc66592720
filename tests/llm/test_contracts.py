"""Every operator against plain Python, and on odd and empty tables."""

import hashlib
import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F

from tapeloom.llm import corpus, decontaminate, license_scan, mixing, quality_rules, repeats, set_join, sharding, text_arrays, token_tables, toxicity, warc

from . import brute


def by_id(df, *cols):
    return {r[0]: tuple(r[1:]) for r in df.select(*cols).collect()}


def test_word_hashes_do_not_depend_on_slices(monkeypatch):
    texts = [b"aa bb  cc", b"", b" dd\n" + b"x" * 300 + b" yy", b"zz"]
    whole = text_arrays.words(texts)
    monkeypatch.setattr(text_arrays, "_SLICE", 7)
    cut = text_arrays.words(texts)
    assert whole.hash.tolist() == cut.hash.tolist() and whole.first.tolist() == cut.first.tolist() == [0, 3, 3, 6, 7]
    assert text_arrays.words([b"cc"]).hash[0] == whole.hash[2]


def test_quality(docs, odd, none, data):
    got = by_id(quality_rules.judge(docs), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    for i, t, *_ in data:
        assert got[i][:6] == brute.quality(t)
        assert not (got[i][5] and got[i][6])
    assert quality_rules.judge(odd).count() == len(data) + 4
    assert quality_rules.judge(none).count() == 0 and quality_rules.keep_good(none).columns == none.columns


def test_rule_order_changes_no_verdict(docs):
    rules = quality_rules.RULES
    v = quality_rules.Values(quality_rules.text_of(docs))
    a, b = (by_id(docs.select("doc_id", quality_rules.cascade(r, v).isNull().alias("k")), "doc_id", "k") for r in (rules, rules[::-1]))
    assert a == b == by_id(quality_rules.judge(docs), "doc_id", "kept")
    assert {r[0] for r in quality_rules.keep_good(docs).select("doc_id").collect()} == {i for i, (k,) in a.items() if k}
    e = [quality_rules.Estimate("few_words", 1.0, 10, 100), quality_rules.Estimate("repeats", 0.1, 10, 100)]
    assert [r.name for r in quality_rules.in_order(rules[:2], e)] == ["repeats", "few_words"]


def test_rules_after_a_rejection_are_not_asked(docs):
    """A rule that fails wherever it is asked: behind one that rejects all rows it is never asked."""
    fails = quality_rules.Rule("fails", lambda v: F.raise_error(v.text).isNotNull())
    all_ = quality_rules.Rule("all", lambda v: v.n_words >= 0)
    short = quality_rules.Rule("short", lambda v: v.n_words < 50)
    v = quality_rules.Values(quality_rules.text_of(docs))
    assert docs.filter(quality_rules.cascade([all_, fails], v).isNull()).count() == 0
    few = docs.sparkSession.createDataFrame([r for r in docs.collect() if len((r["text"] or "").split()) < 40], docs.schema)
    assert few.count() and few.filter(quality_rules.cascade([short, fails], quality_rules.Values(quality_rules.text_of(few))).isNull()).count() == 0
    with pytest.raises(Exception, match="USER_RAISED|raise"):
        docs.filter(quality_rules.cascade([fails, all_], v).isNull()).count()


def test_costs_are_measured_warm(docs):
    dear = quality_rules.Rule("dear", lambda v: quality_rules.n_repeat_words(quality_rules.words_of(F.repeat(v.text, F.lit(300)))) < 0)
    cheap = quality_rules.Rule("cheap", lambda v: F.octet_length(v.text) < 0)
    found = {e.name: e.seconds for e in quality_rules.estimate(docs, [dear, cheap])}
    assert found["dear"] > found["cheap"]


def test_names_do_not_clash(spark, docs):
    clash = docs.withColumns({n: F.lit(777) for n in ("n_words", "word_chars", "kept", "base_failed", "size")})
    kept = quality_rules.keep_good(clash)
    assert kept.columns == clash.columns and {r["n_words"] for r in kept.select("n_words").collect()} == {777}
    mixed = corpus.mixture(spark, clash, "")
    assert mixed.columns == clash.columns and {r["size"] for r in mixed.select("size").collect()} == {777}
    assert by_id(quality_rules.judge(clash), "doc_id", "n_words") == by_id(quality_rules.judge(docs), "doc_id", "n_words")


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80), (2, 50)])
def test_set_join(docs, data, k, percent):
    want = brute.set_join([(i, t) for i, t, *_ in data], k, percent)
    assert by_id(set_join.link(docs, k, percent), "doc_id", "n_shingles", "component_id") == want


def test_set_join_odd(odd, none, data):
    assert set_join.link(odd, 4, 85).count() == len(data) + 4
    assert set_join.link(none, 4, 85).count() == 0
    assert set_join.one_of_each(none).columns == none.columns
    kept = set_join.one_of_each(odd)
    assert kept.columns == odd.columns and kept.filter("doc_id is null").count() == 2


@pytest.mark.parametrize("limit", [1 << 20, 40])
def test_repeats(docs, data, limit):
    want = brute.drop_repeats([(i, t) for i, t, *_ in data], 13)
    got = by_id(repeats.drop_repeats(docs, 13, group_windows=limit, chunk_bytes=4000), "doc_id", "n_words", "n_removed", "text")
    assert got == want and any(v[1] for v in want.values())


def test_repeats_odd(odd, none, data):
    assert repeats.drop_repeats(odd).count() == len(data) + 4
    assert repeats.drop_repeats(none).count() == 0


def test_prefixes_are_split_until_groups_fit():
    counts = np.zeros((len(repeats.LENGTHS), repeats.CELLS, repeats.FINE), np.int64)
    counts[:, 3, :] = 50
    counts[0, 3] = 0
    counts[0, 3, 1] = 50 * repeats.FINE
    plan = repeats.Plan(counts, 100)
    assert plan.length[3] == 1 and plan.parts[3] > 1 and plan.length[4] == 0


def test_sharding(docs, odd, none, data):
    for df, n in ((docs, len(data)), (odd, len(data) + 4)):
        rows = sharding.shard(df, 7).collect()
        sizes = {}
        for r in rows:
            sizes.setdefault(r["shard"], []).append(r["slot"])
        assert len(rows) == n and max(map(len, sizes.values())) - min(map(len, sizes.values())) <= 1
        assert all(sorted(v) == list(range(len(v))) for v in sizes.values())
    texts = {i: t for i, t, *_ in data}
    for r in sharding.shard(docs, 7).collect():
        assert (r["size"], r["text_crc32"]) == (len((texts[r["doc_id"]] or "").encode()) + 1, brute.crc(texts[r["doc_id"]]))
    assert sharding.shard(none).count() == 0


def test_large_groups_fill_whole_shards(spark):
    df = spark.createDataFrame([(i, "hot" if i < 400 else f"t{i}" if i % 3 else f"p{i // 6}") for i in range(1000)], "doc_id long, text string")
    rows = sharding.shard(df, 10, buckets=16).collect()
    hot = [r["shard"] for r in rows if r["doc_id"] < 400]
    assert len(set(hot)) <= 8 and len({r["shard"] for r in rows}) == 10
    pairs = {}
    for r in rows:
        if r["doc_id"] >= 400 and r["doc_id"] % 3 == 0:
            pairs.setdefault(r["doc_id"] // 6, set()).add(r["shard"])
    assert sum(len(v) > 1 for v in pairs.values()) <= 0.25 * len(pairs)
    again = sharding.shard(df.repartition(5), 10, buckets=16).collect()
    assert sorted(rows) == sorted(again)


def test_mixing(docs, odd, none, data):
    rows = {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    size = {i: len(brute.WORD.findall(t or "")) for i, t, *_ in data}
    source = {i: s for i, _, _, s, _ in data}
    words, taken = {}, {}
    for i, r in rows.items():
        assert r["size"] == size[i] and r["taken"] <= 2 * size[i]
        words[source[i]] = words.get(source[i], 0) + size[i]
        taken[source[i]] = taken.get(source[i], 0) + r["taken"]
    want = brute.targets(words)
    for i, r in rows.items():
        assert r["source_size"] == words[source[i]] and abs(r["target"] - want[source[i]]) < 1e-6
    for s in words:  # near the target; the long document's source cannot come nearer than its other sizes allow
        assert abs(taken[s] - want[s]) <= 0.02 * want[s] + 5
    assert mixing.mix(odd).count() == len(data) + 4 and mixing.mix(none).count() == 0
    assert sorted(mixing.mix(docs.repartition(2)).collect()) == sorted(rows.values())


def test_tokens(docs, odd, none, data):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    listed = token_tables.write(docs, path, 2, shard_bytes=9000)
    got, start = by_id(token_tables.read(listed), "id", "start", "n_tokens", "tokens"), 0
    for i, t, *_ in data:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [2]
        assert got[i] == (start, len(ids), np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert listed.count() > 1
    found = token_tables.lookup(listed, [5, 10**9])
    assert np.array(found[5][0], "<u4").tobytes() == got[5][2] and found[10**9] == []
    assert token_tables.read(token_tables.write(odd, path, 2)).count() == len(data) + 4
    assert token_tables.read(token_tables.write(none, path, 2)).count() == 0


def test_pieces_give_the_library_s_ids():
    public = pytest.importorskip("public_tokenizers")
    import pyarrow as pa

    e = token_tables.Encoder(public.path("byte_bpe_50k.json"), store=3)
    texts = ["", "  a  b \n c", "a\n\nb c", " lead", "trail ", "it's don't x's 'll", "a\xa0b c", "x　y z", "tab\there", "<|endoftext|> hi", "a.\nB c.\n D", "é́ ñandú! ok?? 12.5% _x_", "a\x85b c", "a​b c d", "１２ ⅷ ²x"]
    for x, y in zip([*texts, ""], e.encode(pa.array([*texts, None])), strict=True):
        assert y.tolist() == e.tok.encode(x, add_special_tokens=False).ids


def test_warc(spark):
    a, b = "<p>é</p>" * 200, "x" * 999
    rows = [(1, "http://www.b.com/x?q=1", a), (2, "https://A.com:8080/y", a), (5, "http://b.com/x?q=1", a), (3, None, b), (4, "no url at all", b), (6, "http://a.com/", None), (7, "http://a.com/", ""), (8, "http://[bad", "z" * 2000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    listed = warc.write(pages, block_lines=2)
    got = {r["page_id"]: r for r in warc.read(listed, keep_html=True).collect()}
    for i, _, h in rows:
        raw = (h or "").encode()
        visit = i in (1, 2)
        assert (got[i]["payload_bytes"], got[i]["payload_digest"], got[i]["record_type"], got[i]["refers_to"]) == (len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if visit else "response", 5 if visit else None)
        assert got[i]["html"] == (None if visit else h or "")
    assert sorted(r.page_id for r in warc.lookup(listed, "http://b.com/x?q=1")) == [1, 5]
    assert sorted(r.page_id for r in warc.lookup(listed, "http://a.com/")) == [6, 7] and warc.lookup(listed, "http://c.com/") == []
    odd = [*rows, (None, "http://n.com/", a), (None, "http://m.com/", a), (5, "http://b.com/x?q=1", a), (None, None, "n" * 1500), (None, "u", "n" * 1500)]
    back = warc.read(warc.write(spark.createDataFrame(odd, "page_id long, url string, html string"))).collect()
    assert sorted(r["record_type"] for r in back if r["page_id"] == 5) == ["response", "revisit"] and len(back) == len(odd)
    assert all((r["record_type"], r["refers_to"]) == ("revisit", 5) for r in back if r["page_id"] in (1, 2))
    assert sorted((r["record_type"], r["refers_to"]) for r in back if r["page_id"] is None and r["payload_bytes"] > 1500) == [("revisit", 5)] * 2
    assert [r["record_type"] for r in back if r["page_id"] is None and r["payload_bytes"] == 1500] == ["response"] * 2
    more = spark.createDataFrame([*rows, rows[0], (None, None, None)], "page_id long, url string, html string").withColumn("n", pages_n()).withColumn("digest", pages_n())
    assert warc.read(warc.write(more)).count() == len(rows) + 2
    assert warc.read(warc.write(pages.limit(0))).count() == 0


def pages_n():
    from pyspark.sql import functions as F

    return F.lit("other")


def test_leaks(spark, docs, odd, none, data):
    items = [(1, "alpha beta gamma delta epsilon zeta eta theta? iota kappa lambda mu nu."), (2, "the answer is of course forty two"), (3, None), (4, ""), (5, "solo"), (6, " ".join(f"w{i}" for i in range(300)) + ".")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    filler = " ".join(f"f{i}" for i in range(150))
    planted = [(1000, f"{filler} ALPHA beta gamma, delta epsilon zeta eta theta? Iota kappa lambda mu nu. {filler}"), (1001, "so the answer is of course forty two"), (1002, "alpha beta gamma mu nu eta"), (1003, filler + " " + items[5][1]), (1004, "solo"), (1005, None)]
    df = spark.createDataFrame(planted, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(df, bench).collect()}
    assert got == {(1000, 1), (1001, 2), (1003, 6), (1004, 5)}
    whole = sorted(map(tuple, decontaminate.leaks(df, bench).collect()))
    assert whole == sorted(map(tuple, decontaminate.leaks(df, bench, block_bytes=40).collect()))  # scores, too
    assert decontaminate.leaks(docs, bench).count() == 0 and decontaminate.leaks(none, bench).count() == 0
    assert decontaminate.drop_leaks(odd, bench).count() == odd.count()
    assert decontaminate.leaks(df, bench.limit(0)).count() == 0
    assert {r["doc_id"] for r in decontaminate.drop_leaks(df, bench).collect()} == {1002, 1005}


def test_block_max_wand_equals_brute_force():
    import random

    rng = random.Random(2)
    vocab = [f"v{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(3, 40))), None) for i in range(300)]
    idx = decontaminate.Index(rows, 96)
    for _ in range(40):
        terms = np.array(sorted(rng.sample(range(len(idx.terms)), 200)))
        for least in (0.05, 0.2, 0.5):
            sums = {}
            for t in terms:
                for p in range(idx.first[t], idx.first[t + 1]):
                    sums[int(idx.seg[p])] = sums.get(int(idx.seg[p]), 0.0) + idx.impact[p]
            assert sorted(s for s, _ in idx.retrieve(terms, least)) == sorted(s for s, v in sums.items() if v >= least - 1e-9)


def test_licenses(docs, odd, none, data):
    import re

    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    phrases = {tuple(p.split()): x for p, x in license_scan.BASE.items()}
    got = by_id(license_scan.scan(docs), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    for i, t, *_ in data:
        w = word.findall((t or "").translate(low))
        at = sorted((j, x) for p, x in phrases.items() for j in range(len(w)) if tuple(w[j : j + len(p)]) == p)
        want = (len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at})))
        assert got[i][:5] == want and 0 <= got[i][6] <= 1 and set(filter(None, got[i][4].split(","))) <= set(got[i][5].split(","))
    assert "cc-by-nc-4.0" in got[6][5]
    assert license_scan.scan(odd).count() == len(data) + 4 and license_scan.scan(none).count() == 0


def test_toxicity(spark, none):
    import random

    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(500)]
    rows = []
    for i in range(1500):
        bad = i % 5 == 0
        w = [rng.choice(vocab) for _ in range(60)] + (["you", "nasty", "fool"] if bad else [])
        rng.shuffle(w)
        rows.append((i, " ".join(w), int(bad)))
    rows += [(5000, None, 0), (5001, "", 0)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, eligible=None)
    assert 3 <= model.count() < 5000
    got = by_id(toxicity.score(docs, model), "doc_id", "score")
    wrong = sum((got[i][0] >= 0.7) != bool(y) for i, _, y in rows)
    assert wrong <= 15 and all(0 <= v[0] <= 1 for v in got.values()) and got[5000] == got[5001]
    assert toxicity.score(docs, toxicity.train(none, labels)).filter("score > 0.01").count() == 0


def test_crc_is_unsigned(spark):
    from pyspark.sql import functions as F

    assert spark.range(1).select(F.crc32(F.lit("abc"))).first()[0] == zlib.crc32(b"abc")
