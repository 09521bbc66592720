"""Sequential rules against plain loops, sources and sinks on small files."""

import datetime as dt
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.config import Risk
from tapeloom.functions import scoring
from tapeloom.functions import text as tx
from tapeloom.functions.windows import percentile
from tapeloom.operators import asof, patterns, simulate, state
from tapeloom.sources import bars as src
from tapeloom.sources import files
from tapeloom.streaming import streams


def slow_zigzag(high, low, pct):
    """State by state, as the rule is told."""
    out, way = [], "?"
    top = bottom = 0
    for i in range(1, len(high)):
        turned = False
        if way in "?u":
            top = i if high[i] > high[top] else top
            if (high[top] - low[i]) / high[top] * 100 >= pct:
                out.append((top, high[top], "high"))
                way, bottom, turned = "d", i, True
        if not turned and way in "?d":
            bottom = i if low[i] < low[bottom] else bottom
            if (high[i] - low[bottom]) / low[bottom] * 100 >= pct:
                out.append((bottom, low[bottom], "low"))
                way, top = "u", i
    if way == "d":
        out.append((bottom, low[bottom], "low"))
    elif way == "u":
        out.append((top, high[top], "high"))
    return out


def test_zigzag():
    rng = np.random.default_rng(3)
    for n in (0, 2, 3, 40, 300):
        for _ in range(20):
            c = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
            high, low = c * (1 + rng.uniform(0, 0.02, n)), c * (1 - rng.uniform(0, 0.02, n))
            assert patterns.zigzag(high, low, 5.0) == (slow_zigzag(high, low, 5.0) if n >= 3 else [])


def test_vcp_on_a_made_base():
    # Falls of 20 and 8 per cent, then dry volume: valid; the other way round: not.
    def leg(parts):
        out = [100.0]
        for target, n in parts:
            out += list(np.linspace(out[-1], target, n + 1)[1:])
        return np.array(out)

    shrinking = leg([(110, 20), (88, 15), (108, 20), (99.4, 15), (104, 19)])
    vol = np.concatenate([np.full(80, 1000.0), np.full(10, 300.0)])
    assert patterns.vcp(shrinking, shrinking, vol)[0]
    assert not patterns.vcp(shrinking, shrinking, np.full(90, 1000.0))[0]
    growing = leg([(110, 20), (101, 15), (108, 20), (88, 15), (100, 19)])
    assert not patterns.vcp(growing, growing, vol)[0]


def slow_path(at, entry, stop, bar, r):
    n, risk, level, out = len(bar["close"]), entry - stop, stop, {}
    moved = taken = False
    for i in range(at + 1, n):
        for lot in ("trading", "core"):
            if lot not in out and bar["low"][i] <= level:
                out[lot] = (i, level, "stop_loss")
        if "trading" in out and "core" in out:
            break
        if "trading" not in out and not taken and bar["high"][i] >= entry + r.partial_r * risk:
            taken, out["partial"] = True, (i, entry + r.partial_r * risk)
        if not moved and bar["close"][i] >= entry + r.breakeven_r * risk:
            moved, level = True, max(level, entry)
        if "trading" not in out and taken and bar["close"][i] < bar["trail"][i]:
            out["trading"] = (i, bar["close"][i], "trend_break_50dma")
        if "core" not in out and bar["week_end"][i] and bar["close"][i] < bar["core"][i]:
            out["core"] = (i, bar["close"][i], "weekly_close_below_30wk_ma")
        if "trading" in out and "core" in out:
            break
    for lot in ("trading", "core"):
        out.setdefault(lot, (n - 1, bar["close"][-1], "backtest_end"))
    return out | {"partial": out.get("partial")}


def test_paths_equal_the_bar_by_bar_rule():
    rng = np.random.default_rng(11)
    for trial in range(300):
        n = 150
        c = 100 * np.exp(np.cumsum(rng.normal(0.002, 0.025, n)))
        bar = {"close": c, "open": c, "high": c * (1 + rng.uniform(0, 0.02, n)), "low": c * (1 - rng.uniform(0, 0.02, n)), "trail": np.convolve(c, np.ones(10) / 10)[:n], "core": np.convolve(c, np.ones(30) / 30)[:n], "week_end": np.arange(n) % 5 == 4}
        at = int(rng.integers(5, 60))
        stop = c[at] * (1 - rng.uniform(0.02, 0.12))
        got, want = simulate.path(at, c[at], stop, bar), slow_path(at, c[at], stop, bar, Risk())
        assert {k: v and tuple(v) for k, v in got.items()} == {k: want[k] and tuple(want[k]) for k in got}, trial


def test_percentile_is_the_mean_rank(spark):
    x = [3.0, 1.0, 1.0, None, 7.0]
    df = spark.createDataFrame([(v,) for v in x], "x double").select("x", percentile(F.col("x")).alias("p"))
    assert sorted((r["x"], r["p"]) for r in df.collect() if r["x"] is not None) == [(1.0, 37.5), (1.0, 37.5), (3.0, 75.0), (7.0, 100.0)]


def test_asof_against_a_loop(spark):
    rng = random.Random(4)
    left = [(rng.randint(0, 3), rng.randint(0, 40)) for _ in range(60)]
    right = sorted({(rng.randint(0, 3), rng.randint(0, 40)) for _ in range(30)})
    right = [(k, t, float(i)) for i, (k, t) in enumerate(right)]
    a, b = spark.createDataFrame(left, "k int, t int"), spark.createDataFrame(right, "k int, t int, v double")
    for exact in (True, False):
        got = asof.asof(a, b, ["k"], "t", "v", exact).select("k", "t", "v").collect()
        want = [(k, t, max(((t2, v) for k2, t2, v in right if k2 == k and (t2 <= t if exact else t2 < t)), default=(0, None))[1]) for k, t in left]
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_conviction_needs_known_weights():
    with pytest.raises(ValueError, match="unknown"):
        scoring.assess({"luck": F.lit(1.0)}, F.lit(False))


def test_bars_from_files(spark, tmp_path):
    (tmp_path / "AAA.csv").write_text("Date,Open,High,Low,Close,Volume\n2024-01-02,1,2,0.5,1.5,10\n2024-01-02,1,2,0.5,1.6,\n2024-01-03,1,2,1,,5\nbad,1,1,1,1,1\n2024-01-04,x,NaN,1,2,3\n")
    b = src.normalize(src.read_csv(spark, str(tmp_path)))
    rows = {r["date"]: r for r in b.collect()}
    assert set(rows) == {dt.date(2024, 1, 2), dt.date(2024, 1, 4)} and rows[dt.date(2024, 1, 2)]["close"] == 1.6 and rows[dt.date(2024, 1, 2)]["volume"] == 0.0
    assert rows[dt.date(2024, 1, 4)]["open"] is None and rows[dt.date(2024, 1, 4)]["high"] is None
    with pytest.raises(ValueError, match="lack"):
        src.normalize(b.drop("close"))


def test_exports_feeds_and_documents(spark, tmp_path):
    (tmp_path / "e.csv").write_text('Name,Market Cap,ROCE\nA,"1,200",12%\nB,,3%\nC,n/a,4\n')
    e = files.export(spark, f"{tmp_path}/e.csv", {"Name": "name", "Market Cap": "cap", "ROCE": "roce"}, ["cap", "roce"], ["cap", "roce"])
    assert [tuple(r) for r in e.collect()] == [("A", 1200.0, 12.0)]
    (tmp_path / "h.csv").write_text("Some bank\nreport of,today\nInstrument,Qty.,Avg. cost\nAAA,10,100.5\nBBB,3,20\nTotal,,\n")
    h = files.console_csv(spark, f"{tmp_path}/h.csv", {"symbol": ("instrument", "symbol"), "quantity": ("qty", "quantity"), "avg": ("avg",)})
    assert [tuple(r) for r in h.orderBy("symbol").collect()] == [("AAA", "10", "100.5"), ("BBB", "3", "20")]
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>Acme Ltd</title><description>bags order</description><pubDate>05-Jan-2024 10:11:12</pubDate><link>u</link></item></channel></rss>")
    f = files.feed(spark, f"{tmp_path}/f.xml").first()
    assert (f["company"], f["subject"], f["date"]) == ("Acme Ltd", "bags order", dt.datetime(2024, 1, 5, 10, 11, 12))
    doc = {"symbol": "A", "quarters": {"columns": ["Mar 2023", "Jun 2023", "TTM"], "rows": {"Sales": [1.0, 2.0], "Net Profit": [0.1, None, 3.0]}}}
    (tmp_path / "d.json").write_text(json.dumps(doc))
    t = files.section(files.documents(spark, f"{tmp_path}/d.json"), "quarters", 45)
    assert {(r["metric"], str(r["period_end"]), str(r["known_as_of"]), r["value"]) for r in t.collect()} == {("Sales", "2023-03-31", "2023-05-15", 1.0), ("Sales", "2023-06-30", "2023-08-14", 2.0), ("Net Profit", "2023-03-31", "2023-05-15", 0.1), ("Net Profit", "2023-06-30", "2023-08-14", None)}
    chart = {"chart": {"result": [{"meta": {"symbol": "A"}, "timestamp": [1704166200, 1704252600], "indicators": {"quote": [{"open": [1, 2], "high": [1, 2], "low": [1, 2], "close": [1, None], "volume": [5, 6]}]}}]}}
    c = files.chart_json(spark.createDataFrame([(json.dumps(chart),)], "value string")).collect()
    assert len(c) == 1 and str(c[0]["date"]) == "2024-01-02"


def test_journals_and_snapshots(spark, tmp_path):
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    schema = StructType([StructField("a", LongType()), StructField("b", StringType())])
    path = f"{tmp_path}/j"
    assert files.empty_if_missing(spark, lambda: spark.read.parquet(path), schema).count() == 0
    files.append(spark.createDataFrame([(1, 9)], "a long, other long"), path, schema)
    files.append(spark.createDataFrame([(2, "x")], "a long, b string"), path, schema)
    assert sorted(map(tuple, spark.read.parquet(path).collect()), key=str) == [(1, None), (2, "x")]
    files.replace_partitions(spark.createDataFrame([(1, "p"), (2, "q")], "v long, day string"), f"{tmp_path}/s", "day")
    files.replace_partitions(spark.createDataFrame([(3, "q")], "v long, day string"), f"{tmp_path}/s", "day")
    assert sorted(r["v"] for r in spark.read.parquet(f"{tmp_path}/s").collect()) == [1, 3]


def test_once_within_and_unseen(spark):
    d = spark.createDataFrame([("a", dt.date(2024, 1, n)) for n in (1, 2, 9)], "k string, day date")
    assert [r["day"].day for r in state.once_within(d, ["k"], "day", 3).orderBy("day").collect()] == [1, 9]
    new = spark.createDataFrame([("x",), ("x",), ("y",)], "link string")
    assert [r[0] for r in state.unseen(new, spark.createDataFrame([("y",)], "link string"), F.col("link")).collect()] == ["x"]


def test_merge_of_batches(spark, tmp_path):
    old = spark.createDataFrame([("A", dt.date(2024, 1, 1), 1.0), ("A", dt.date(2024, 1, 2), 2.0)], "symbol string, date date, close double")
    new = spark.createDataFrame([("A", dt.date(2024, 1, 2), 9.0), ("B", dt.date(2024, 1, 2), 5.0)], "symbol string, date date, close double")
    for b in (old, new):
        b.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    s = streams.follow(spark, f"{tmp_path}/in", old.schema)
    streams.merge_batches(s, f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["close"] for r in spark.read.parquet(f"{tmp_path}/out/v1").collect()) == [1.0, 5.0, 9.0]


def test_words_are_counted_once_and_with_endings(spark):
    t = spark.createDataFrame([("Haircuts and cuts; surging, surged, surges",)], "t string")
    r = t.select(tx.word_hits(F.col("t"), ["cuts", "surge", "fell"]).alias("n"), tx.sentiment(F.lit("Top gainers and losers surge")).alias("s"), tx.classify(F.lit("unit suspended; redemption of debenture"))["event"].alias("e")).first()
    assert (r["n"], r["s"], r["e"]) == (2, 0, None)


def test_entry_plans(spark):
    cases = [(115.0, 2.0, 110.5), (100.0, None, 80.0), (100.0, 2.0, None), (100.0, 6.0, None), (100.0, None, None)]
    df = spark.createDataFrame(cases, "e double, a double, s double")
    got = [r["p"] for r in df.select(scoring.entry_plan(F.col("e"), F.col("a"), F.col("s"), F.lit(1.0)).alias("p")).collect()]
    assert [p and p["stop"] for p in got] == [110.5, None, 95.0, None, 88.0]
    assert (got[2]["shares"], got[2]["trading"], got[2]["core"], got[2]["partial"], got[2]["breakeven"]) == (1500, 750, 750, 112.5, 107.5)


def test_point_in_time_scores(spark):
    from tapeloom.operators import pit

    ends = [dt.date(2020 + i // 4, 3 * (i % 4) + 3, 28) for i in range(9)]

    def section(lag, **metrics):
        rows = [("A", e, e + dt.timedelta(days=lag), m, float(v)) for m, vs in metrics.items() for e, v in zip(ends, vs, strict=False) if v is not None]
        return spark.createDataFrame([(s, e, k, m.replace("_", " "), v) for s, e, k, m, v in rows], "symbol string, period_end date, known_as_of date, metric string, value double")

    q = section(45, **{"Net_Profit": [1, 1, 1, 1, 2, 2, 2, 2, 2], "EPS_in_Rs": [1] * 9})
    bs = section(60, **{"Borrowings": [100, 90, 80, 50], "Equity_Capital": [10] * 4, "Reserves": [90] * 4})
    cf = section(60, **{"Cash_from_Operating_Activity": [5, 5, 5, 5]})
    sh = section(21, **{"FIIs": [1, 1, 1, 1, 4], "DIIs": [1, 1, 1, 1, 1], "Promoters": [50, 50, 50, 50, 47]})
    bars = spark.createDataFrame([("A", dt.date(2020, 1, 1) + dt.timedelta(days=i), 20.0) for i in range(1000)], "symbol string, date date, close double")
    none = spark.createDataFrame([], "symbol string")
    got = {r["date"]: r["fundamental_score"] for r in pit.on_bars(bars, pit.scores(bars, q, bs, cf, sh, none)).collect()}
    assert got[ends[0] + dt.timedelta(days=44)] is None or got[ends[0] + dt.timedelta(days=44)] >= 0
    # At the ninth quarter: profit 2 against 2 a year ago, 8 against 5 over a year, price 20 on earnings of 4 a share.
    earnings = 0.45 * 0.5 + 0.30 * 1.0 + 0.25 * 1.0
    strength = 0.4 * 1.0 + 0.4 * (1 - 0.5 / 1.5) + 0.2 * 0.8
    parts = {"earnings": earnings, "strength": strength, "smart_money": 1.0, "governance": 0.4, "valuation": 0.95}
    want = sum(pit.WEIGHTS[k] * v for k, v in parts.items()) / sum(pit.WEIGHTS.values())
    assert abs(got[ends[8] + dt.timedelta(days=46)] - want) < 2e-4
