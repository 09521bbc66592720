"""Lots and equity against a plain loop over days, on random bars with gaps."""

import datetime as dt
import random

import pytest

from tapeloom.config import Risk
from tapeloom.operators import indicators as ind
from tapeloom.operators import simulate

DAY = dt.date(2023, 1, 2)


def table(spark, seed):
    rng, rows, signals = random.Random(seed), [], []
    for s in range(6):
        px = 100.0
        for d in range(420):
            day = DAY + dt.timedelta(days=d)
            if day.weekday() > 4 or rng.random() < 0.15:
                continue
            o = px * (1 + rng.gauss(0, 0.01))
            px = o * (1 + rng.gauss(0.0015, 0.02))
            rows.append((f"S{s}", day, round(o, 2), round(max(o, px) * 1.008, 2), round(min(o, px) * 0.992, 2), round(px, 2), float(rng.randint(100, 900))))
            if d > 90 and rng.random() < 0.06:
                signals.append((f"S{s}", day, None, rng.choice([None, 0.1, 0.3, 0.5, 0.7, 0.9])))
    bars = spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, volume double")
    return bars, spark.createDataFrame(signals, "symbol string, date date, stop double, score double")


def plain(ready, signals, r, slots, pct, scale, gap_stops, patience_score, next_open, losses, size_on, min_score, rank_by, split):
    """Day by day: exits, entries, mark. ready: bars with averages as dicts; gives lots and equity."""
    by, order = {}, {}
    for x in ready:
        by[x["symbol"], x["date"]] = x
        order.setdefault(x["symbol"], []).append(x["date"])
    enter = {}
    for s, d, _, score in signals:
        if next_open:
            later = [x for x in order[s] if x > d]
            if not later:
                continue
            d = later[0]
        enter[s, d] = score
    cash, held, last, lots, closed, curve = r.capital, {}, {}, [], [], []

    def sell(t, lot, d, price, why, n=None):
        nonlocal cash
        n = lot["left"] if n is None else n
        cash += n * price
        lot["pnl"] += n * (price - t["entry"])
        lot["left"] -= n
        if not lot["left"]:
            lot.update(exit=d, price=price, why=why)

    for d in sorted({x["date"] for x in ready}):
        for s, t in list(held.items()):
            x = by.get((s, d))
            if not x:
                continue
            last[s] = x["close"]
            gain = x["close"] - t["entry"]
            for lot in t["lots"]:
                if lot["left"] and x["low"] <= lot["stop"]:
                    sell(t, lot, d, min(lot["stop"], x["open"]) if gap_stops else lot["stop"], "stop_loss")
            trading = t["lots"][0]
            if trading["left"] and not t["part"] and x["high"] >= t["entry"] + r.partial_r * t["risk"]:
                n = int(trading["n"] * r.partial_share)
                t["part"] = True
                if n:
                    sell(t, trading, d, t["entry"] + r.partial_r * t["risk"], "", n)
            if gain >= r.breakeven_r * t["risk"]:
                for lot in t["lots"]:
                    lot["stop"] = max(lot["stop"], t["entry"])
            if trading["left"] and t["part"] and x["sma_50"] is not None and x["close"] < x["sma_50"]:
                sell(t, trading, d, x["close"], "trend_break_50dma")
            core = t["lots"][1] if len(t["lots"]) > 1 else None
            if core and core["left"] and x["is_week_end"] and x["sma_150"] is not None:
                t["weeks"] = t["weeks"] + 1 if x["close"] < x["sma_150"] else 0
                if t["weeks"] >= 1 + (patience_score is not None and t["score"] is not None and t["score"] >= patience_score):
                    sell(t, core, d, x["close"], "weekly_close_below_30wk_ma")
            if not any(lot["left"] for lot in t["lots"]):
                closed.append(held.pop(s))
        today = []
        for (s, e), score in enter.items():
            x = by.get((s, e))
            if e != d or s in held or (min_score is not None and score is not None and score < min_score) or not x["atr"]:
                continue
            entry = x["open"] if next_open else x["close"]
            if r.stop_atr * x["atr"] / entry * 100 <= r.stop_cap_pct:
                key = (0.5 if score is None else score) if rank_by == "score" else (x["volume"] / x["avg_vol"] if x["avg_vol"] else 0.0)
                today.append((-key, s, entry, r.stop_atr * x["atr"], score))
        factor = scale(d)
        if losses and len(closed) >= 5:
            rs = [sum(lot["pnl"] for lot in t["lots"]) / (sum(lot["n"] for lot in t["lots"]) * t["risk"]) for t in closed[-10:]]
            factor *= 0.5 if sum(rs) / len(rs) < 0 else 1.0
        for _, s, entry, risk, score in sorted(today):
            if len(held) >= slots:
                break
            base = cash
            if size_on == "equity":
                base += sum(lot["left"] * last[y] for y, t in held.items() for lot in t["lots"])
            n = int(base * pct / 100 * factor // (entry - (entry - risk)))
            if n * entry > base * r.value_cap_pct / 100:
                n = int(base * r.value_cap_pct / 100 // entry)
            n = min(n, int(cash // entry))
            if n <= 0:
                continue
            share = r.lot_split if split == "fixed" else 0.7 if score is None or score < 0.45 else 0.4 if score >= 0.65 else r.lot_split
            a = int(n * share)
            cash -= n * entry
            sizes = [a, n - a] if a and n - a else [n]
            held[s] = {"entry": entry, "risk": entry - (entry - risk), "score": score, "part": False, "weeks": 0, "lots": [{"n": k, "left": k, "stop": entry - risk, "pnl": 0.0, "name": s, "in": d} for k in sizes]}
            last[s] = entry
            lots += [(kind, lot) for kind, lot in zip(("trading", "core"), held[s]["lots"], strict=False)]
        curve.append((d, cash + sum(lot["left"] * last[s] for s, t in held.items() for lot in t["lots"])))
    return [(x["name"], kind, x["in"], x["n"], x.get("exit"), x.get("why")) for kind, x in lots], curve


@pytest.mark.parametrize("options", [{}, {"next_open": True, "gap_stops": True, "patience_score": 0.6, "losses": True, "size_on": "equity", "min_score": 0.2, "rank_by": "score", "split": "score"}])
def test_lots_and_equity(spark, options):
    r = Risk()
    use = {"gap_stops": False, "patience_score": None, "next_open": False, "losses": False, "size_on": "cash", "min_score": None, "rank_by": "strength", "split": "fixed"} | options
    bars, signals = table(spark, 3)
    steps = [(DAY + dt.timedelta(days=60 * i), 1.0 if i % 2 else 0.5) for i in range(7)]
    scale = spark.createDataFrame(steps, "date date, scale double") if options else None
    found = simulate.paths(bars, signals, r, use["gap_stops"], 1, use["patience_score"], use["next_open"])
    lots = simulate.allocate(found, [("c", 3, 1.25)], r, scale, simulate.after_losses if use["losses"] else None, use["size_on"], use["min_score"], use["rank_by"], use["split"]).cache()
    curve = {x["date"]: x["equity"] for x in simulate.equity(lots, bars, ["c"], r).collect()}
    ready = ind.with_volume_average(ind.with_week_end(ind.with_atr(ind.with_averages(bars, (r.trail_bars, r.core_bars)), r.atr_bars))).orderBy("date", "symbol").collect()
    at = (lambda d: ([1.0] + [v for day, v in steps if day <= d])[-1]) if options else (lambda d: 1.0)
    want, days = plain([x.asDict() for x in ready], [tuple(x) for x in signals.collect()], r, 3, 1.25, at, **use)
    got = {(x["name"], x["lot"], x["entry_date"]): x for x in lots.collect()}
    assert sorted(got) == sorted((s, kind, d) for s, kind, d, *_ in want) and len(want) > 8 and any(x["partial_shares"] for x in got.values())
    for s, kind, d, n, out, why in want:
        x = got[s, kind, d]
        assert x["shares"] == n and (out is None or (x["exit_date"], x["exit_reason"]) == (out, why))
    assert sorted(curve) == [d for d, _ in days]
    for d, v in days:
        assert curve[d] == pytest.approx(v, rel=1e-9), d


def test_partial_sales_and_missing_days(spark):
    """1,250 shares at 100, 206 sold at 125, then a close at 130 and a day that only another symbol has."""
    d = [DAY + dt.timedelta(days=i) for i in range(5)]
    bars = spark.createDataFrame([("A", d[0], 100.0), ("A", d[1], 125.0), ("A", d[2], 130.0), ("B", d[3], 1.0), ("A", d[4], 130.0)], "symbol string, date date, close double")
    lot = [("c", "A", "trading", d[0], 100.0, d[4], 130.0, "backtest_end", 625, 10.0, 17720.0, 0.0, d[1], 125.0, 206), ("c", "A", "core", d[0], 100.0, d[4], 130.0, "backtest_end", 625, 10.0, 18750.0, 0.0, None, None, 0)]
    got = {x["date"]: x["equity"] for x in simulate.equity(spark.createDataFrame(lot, simulate.LOTS), bars, ["c"]).collect()}
    assert [got[x] for x in d] == [1_000_000.0, 1_031_250.0, 1_036_470.0, 1_036_470.0, 1_036_470.0]


def test_exposure_counts_trades(spark):
    rows = [("c", f"S{i}", lot, DAY, 10.0, DAY + dt.timedelta(days=i + 1), 9.0, "x", 10, 1.0, -5.0, -0.5, None, None, 0) for i in range(6) for lot in ("trading", "core")]
    got = sorted(tuple(x) for x in simulate.exposure(spark.createDataFrame(rows, simulate.LOTS)).select("name", "scale").collect())
    assert got == [(f"S{i}", 1.0 if i < 4 else 0.5) for i in range(6)]
