"""As-of joins in both directions against loops, and the rules of positions, entries and the market's scale by hand."""

import datetime as dt
import random

import pytest

from tapeloom.operators import asof, indicators, metrics, state

DAY = dt.date(2024, 1, 1)


def day(n):
    return DAY + dt.timedelta(days=n)


def table(rng, n, keys, times):
    return [(rng.choice(keys), rng.choice(times), i) for i in range(n)]


@pytest.fixture(scope="module")
def sides(spark):
    rng = random.Random(5)
    times = [None, *range(0, 400, 3)]
    left, right = table(rng, 120, ["a", "b", None], times), table(rng, 90, ["a", "b", None], [*times, 1, 2, 50])
    return left, right, spark.createDataFrame(left, "k string, t long, i long"), spark.createDataFrame(right, "k string, t long, v long")


@pytest.mark.parametrize("exact", [True, False])
def test_forward(sides, exact):
    left, right, a, b = sides
    got = {r["i"]: r["v"] for r in asof.asof(a, b, ["k"], "t", "v", exact, forward=True).collect()}
    for k, t, i in left:
        after = [(u, -v, v) for q, u, v in right if None not in (k, t, q, u) and q == k and (u > t or exact and u == t)]
        assert got[i] == (min(after)[2] if after else None)


def test_nearest(sides):
    left, right, a, b = sides
    got = {r["i"]: r["v"] for r in asof.nearest(a, b, ["k"], "t", "v").collect()}
    for k, t, i in left:
        near = [(abs(u - t), v) for q, u, v in right if None not in (k, t, q, u) and q == k]
        assert got[i] == (min(near)[1] if near else None)


def test_within(spark, sides):
    left, right, _, _ = sides
    moved = lambda rows: [(k, None if t is None else day(t), i) for k, t, i in rows]
    a, b = spark.createDataFrame(moved(left), "k string, d date, i long"), spark.createDataFrame(moved(right), "k string, u date, v long")
    got = {r["i"]: r["v"] for r in asof.within(a, b, ["k"], "d", "u", 5, "v", "v").collect()}
    for k, t, i in left:
        near = [(u, v) for q, u, v in right if None not in (k, t, q, u) and q == k and t - 5 <= u <= t]
        assert got[i] == (max(near)[1] if near else None)


def test_outcomes_by_hand(spark):
    bars = [("a", day(i), h, low, c) for i, (h, low, c) in enumerate([(10, 9, 10), (12, 10, 11), (11, 8, 9), (30, 29, 30)])]
    signals = [(1, "a", day(0), 10.0, 8.0), (2, "a", day(2), 9.0, 8.5), (3, "a", day(3), 30.0, 28.0), (4, "z", day(0), 5.0, 4.0), (5, "a", day(0), 10.0, 10.0)]
    got = metrics.outcomes(spark.createDataFrame(signals, "id long, symbol string, date date, close double, stop double"), spark.createDataFrame([(s, d, float(h), float(low), float(c)) for s, d, h, low, c in bars], "symbol string, date date, high double, low double, close double"))
    rows = {r["id"]: tuple(r)[3:] for r in got.collect()}
    assert rows[1] == (1.0, -1.0, -1.0, "stopped")
    assert rows[2] == (42.0, 40.0, 42.0, "open")
    assert rows[3] == rows[4] == (None, None, None, "no data yet")
    assert rows[5] == (None, None, -1.0, "stopped")  # no risk: no multiple of it


POSITION = "symbol string, entry double, initial_stop double, stop double, trading_open boolean, core_open boolean, partial_taken boolean, breakeven_moved boolean"
LAST = "symbol string, date date, low double, high double, close double, sma_short double, week_close double, week_sma double"


@pytest.mark.parametrize(
    "flags, bar, events, after",
    [
        ((90.0, True, True, False, False), (89.0, 130.0, 120.0, 125.0, 1.0, 2.0), "stop", (90.0, False, False, False, False)),
        ((90.0, True, True, False, False), (99.0, 125.0, 116.0, 110.0, 5.0, 2.0), "partial,break even", (100.0, True, True, True, True)),
        ((90.0, True, True, False, False), (99.0, 126.0, 116.0, 118.0, 1.0, 2.0), "partial,break even,trail,core exit", (100.0, False, False, True, True)),
        ((90.0, True, True, True, True), (99.0, 126.0, 116.0, None, 1.0, None), "", (90.0, True, True, True, True)),
        ((90.0, False, True, False, True), (99.0, 126.0, 99.0, 118.0, 1.0, 2.0), "core exit", (90.0, False, False, False, True)),
        ((90.0, False, False, False, False), (80.0, 126.0, 99.0, 118.0, 1.0, 2.0), "", (90.0, False, False, False, False)),
        ((90.0, True, True, False, False), None, "", (90.0, True, True, False, False)),
    ],
)
def test_manage(spark, flags, bar, events, after):
    p = spark.createDataFrame([("a", 100.0, 90.0, *flags)], POSITION)
    row = state.manage(p, spark.createDataFrame([("a", DAY, *bar)] if bar else [], LAST)).collect()[0]
    assert row["events"] == events
    assert tuple(row)[2:] == after


def test_a_week_is_complete_by_its_friday_or_a_later_week(spark):
    # 1 January 2024 is a Monday.
    bars = [(s, day(i), float(i)) for s, last in (("thu", 10), ("fri", 11), ("mon", 14)) for i in range(last + 1) if i % 7 < 5 and not (s == "mon" and i == 11)]
    got = indicators.completed_week(spark.createDataFrame(bars, "symbol string, date date, close double")).collect()
    assert {r["symbol"]: r["week_close"] for r in got} == {"thu": 4.0, "fri": 11.0, "mon": 10.0}


def test_entries(spark):
    columns = "id string, symbol string, alerted boolean, stop double, fill_open double, half boolean, scale double"
    rows = [("1", "held", True, 90.0, 100.0, False, 1.0), ("2", "a", False, None, None, False, 1.0), ("3", "a", True, None, 100.0, False, 1.0), ("4", "a", True, 90.0, None, False, 1.0), ("5", "a", True, 100.0, 100.0, False, 1.0)]
    rows += [("6", "a", True, 1000.0, 99_000.0, False, 1.0), ("7", "a", True, 90.0, 100.0, False, 1.0), ("8", "a", True, 90.0, 100.0, True, 0.5), ("9", "a", True, 99.9, 100.0, False, 1.0)]
    got = state.entries(spark.createDataFrame(rows, columns), spark.createDataFrame([("held",), ("held",)], "symbol string")).orderBy("id").collect()
    assert [r["action"] for r in got] == ["already open", "no alert", "no stop", "pending", "gapped below stop", "too small", "buy", "buy", "buy"]
    assert [(r["shares_trading"], r["shares_core"]) for r in got[6:]] == [(625, 625), (156, 156), (750, 750)]


def test_market_scale(spark):
    bench = spark.createDataFrame([(day(i), float(100 - i)) for i in range(12)], "date date, bench double")
    snapshots = spark.createDataFrame([(day(1), 40.0, 120), (day(2), 49.97, 120), (day(11), 10.0, 99)], "date date, breadth_pct double, symbols long")
    got = indicators.market_scale(bench.select("date"), snapshots, bench, n=5).orderBy("date").collect()
    assert [(r["scale"], r["rule"]) for r in got] == [(1.0, "none"), (0.5, "breadth"), *[(1.0, "breadth")] * 8, (0.5, "benchmark"), (0.5, "benchmark")]
