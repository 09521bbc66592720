"""Portfolio simulation in three phases.

When a lot is sold depends on its entry and on its symbol's later bars alone, never on the rest of the portfolio. So the
paths of all candidate trades are found in parallel, by symbol; then one ordered pass a configuration deals slots, cash
and shares to candidates (rows: signals, not bars); then holdings are priced on every date by joins.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable
from datetime import date

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeloom.config import Risk

from . import indicators as ind
from .asof import asof

PATHS = "symbol string, date date, entry double, stop double, strength double, trading_date date, trading_price double, trading_reason string, core_date date, core_price double, core_reason string, partial_date date, partial_price double, score double, mark_dates array<date>, mark_closes array<double>"


def _first(mask: np.ndarray, after: int) -> int:
    """First place beyond `after` where the mask holds; its length if none."""
    hit = np.flatnonzero(mask[after + 1 :])
    return after + 1 + int(hit[0]) if len(hit) else len(mask)


def path(at: int, entry: float, stop: float, bar: dict[str, np.ndarray], r: Risk = Risk(), gap_stops: bool = False, patience: int = 1) -> dict:
    """Exits of a trade's two lots, as places in the bars; the end of the bars closes what is open.

    On one bar the stop comes first, then the partial sale, the move to break even, the trail and the weekly exit.
    """
    n, risk = len(bar["close"]), entry - stop
    even = _first(bar["close"] >= entry + r.breakeven_r * risk, at)
    hit = _first(bar["low"] <= stop, at)
    level = stop
    if hit > even:
        level = max(stop, entry)
        hit = _first(bar["low"] <= level, even)
    partial = _first(bar["high"] >= entry + r.partial_r * risk, at)
    trail = _first(bar["close"] < bar["trail"], partial - 1) if partial < n else n
    below, weeks, broke, core = bar["close"] < bar["core"], np.flatnonzero(bar["week_end"] & ~np.isnan(bar["core"])), 0, n
    for w in weeks[weeks > at]:
        broke = broke + 1 if below[w] else 0
        if broke >= patience:
            core = int(w)
            break
    fill = min(level, bar["open"][hit]) if hit < n and gap_stops else level

    def leave(other: int, why: str) -> tuple[int, float, str]:
        if hit <= other and hit < n:
            return hit, float(fill), "stop_loss"
        return (other, float(bar["close"][other]), why) if other < n else (n - 1, float(bar["close"][-1]), "backtest_end")

    t, c = leave(trail, "trend_break_50dma"), leave(core, "weekly_close_below_30wk_ma")
    sold = partial if partial < n and partial < hit and partial <= t[0] else None
    return {"trading": t, "core": c, "partial": None if sold is None else (sold, entry + r.partial_r * risk)}


def paths(bars: DataFrame, signals: DataFrame, r: Risk = Risk(), gap_stops: bool = False, patience: int = 1, patience_score: float | None = None, next_open: bool = False) -> DataFrame:
    """Trade paths of the signals (symbol, date, stop null or given, score if any): entry at the close, or with next_open
    at the next bar's open; stop by ATR unless given. With patience_score, a core lot whose score is that or more stays
    for one weekly close below its average more. mark_dates, mark_closes: what the trade is
    worth on each day, at first its entry."""
    ready = ind.with_week_end(ind.with_atr(ind.with_averages(bars, (r.trail_bars, r.core_bars)), r.atr_bars))
    score = F.col("score") if "score" in signals.columns else F.lit(None).cast("double")
    ready = ind.with_volume_average(ready).join(signals.select("symbol", "date", F.lit(True).alias("signal"), F.col("stop").alias("own_stop"), score.alias("score")), ["symbol", "date"], "left")

    def of(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("date").reset_index(drop=True)
        bar = {k: df[c].to_numpy(float) for k, c in (("open", "open"), ("high", "high"), ("low", "low"), ("close", "close"), ("trail", f"sma_{r.trail_bars}"), ("core", f"sma_{r.core_bars}"))}
        bar["week_end"] = df["is_week_end"].to_numpy(bool)
        days, rows = df["date"].tolist(), []
        for s in np.flatnonzero(df["signal"].notna().to_numpy()):
            i = int(s) + next_open
            if i == len(df):
                continue
            entry, atr, own, score = bar["open" if next_open else "close"][i], df["atr"].iat[i], df["own_stop"].iat[s], df["score"].iat[s]
            stop = own if pd.notna(own) and 0 < own < entry else entry - r.stop_atr * atr
            if not (pd.notna(atr) and atr > 0 and entry > 0) or (entry - stop) / entry * 100 > r.stop_cap_pct:
                continue
            more = patience_score is not None and pd.notna(score) and score >= patience_score
            p = path(i, entry, stop, bar, r, gap_stops, patience + more)
            usual, part, end = df["avg_vol"].iat[i], p["partial"], max(p["trading"][0], p["core"][0])
            rows.append((df["symbol"].iat[0], days[i], entry, stop, df["volume"].iat[i] / usual if usual else 0.0, days[p["trading"][0]], *p["trading"][1:], days[p["core"][0]], *p["core"][1:], days[part[0]] if part else None, part[1] if part else None, score, days[i : end + 1], [float(entry), *bar["close"][i + 1 : end + 1].tolist()]))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in PATHS.split(", ")])

    return ready.withColumn("volume", F.col("volume").cast("double")).groupBy("symbol").applyInPandas(of, PATHS)


LOTS = "config string, name string, lot string, entry_date date, entry_price double, exit_date date, exit_price double, exit_reason string, shares long, risk_per_share double, realized_pnl double, r_multiple double, partial_date date, partial_price double, partial_shares long"
#: What allocate returns: whole numbers of shares as doubles, as they pass 64 bits where prices grow without bound.
ALLOCATED = LOTS.replace("shares long", "shares double")


def after_losses(rs: list[float], n: int = 10, least: int = 5) -> float:
    """Half while the mean R of the last n closed trades is negative, once there are enough of them."""
    return 0.5 if len(rs) >= least and np.mean(rs[-n:]) < 0 else 1.0


def lot_share(score: float | None, usual: float) -> float:
    """Share of the trading lot by score: less for strong ones, more for weak or unknown ones."""
    if score is None or pd.isna(score) or score < 0.45:
        return 0.7
    return 0.4 if score >= 0.65 else usual


def allocate(found: DataFrame, grid: list[tuple[str, int, float]], r: Risk = Risk(), scale: DataFrame | None = None, scale_of: Callable[[list[float]], float] | None = None, size_on: str = "cash", min_score: float | None = None, rank_by: str = "strength", split: str = "fixed") -> DataFrame:
    """Lots that a portfolio takes of the paths, for each (config, slots, risk_pct) of the grid: best first on a day, one
    position a symbol, exits before entries, sized by the risk and bounded by value and by cash.

    scale: (date, scale) of the risk, the last at or before a day counts. scale_of: a factor from the R of the trades closed
    so far. size_on "equity": risk and value are shares of cash and positions at their last closes, not of cash alone.
    min_score: candidates below go, those without a score stay. rank_by "score": ranked by score (0.5 without one) instead
    of volume. split "score": lots by `lot_share`. One task a configuration reads all its candidates in order of time:
    what a portfolio takes depends on what it holds. Their number is bounded by symbols and days.
    """

    def of(df: pd.DataFrame) -> pd.DataFrame:
        name, slots, pct = df["config"].iat[0], int(df["slots"].iat[0]), float(df["risk_pct"].iat[0])
        cash, held, due, rows, done, closed = r.capital, {}, [], [], [], []  # held: symbol -> (last sale, marks); due: (day, money, symbol, shares)
        df = df.assign(rank=df["score"].fillna(0.5) if rank_by == "score" else df["strength"])
        for day, today in df.sort_values(["date", "rank", "symbol"], ascending=[True, False, True]).groupby("date", sort=True):
            held = {s: x for s, x in held.items() if x[0] > day}
            cash += sum(x[1] for x in due if x[0] <= day)
            due = [x for x in due if x[0] > day]
            closed += [x[2] for x in sorted((x for x in done if x[0] <= day), key=lambda x: x[:2])]
            done = [x for x in done if x[0] > day]
            factor = float(today["scale"].iat[0]) * (scale_of(closed) if scale_of else 1.0)
            for c in today.itertuples():
                if len(held) >= slots:
                    break
                risk = c.entry - c.stop
                if c.symbol in held or risk <= 0 or (min_score is not None and c.score < min_score):
                    continue
                base = cash
                if size_on == "equity":
                    base += sum(n * held[s][2][bisect_right(held[s][1], day) - 1] for _, _, s, n in due)
                shares = int(base * pct / 100 * factor // risk)
                if shares * c.entry > base * r.value_cap_pct / 100:
                    shares = int(base * r.value_cap_pct / 100 // c.entry)
                shares = min(shares, int(cash // c.entry))
                if shares <= 0:
                    continue
                trading = int(shares * (lot_share(c.score, r.lot_split) if split == "score" else r.lot_split))
                lots = {"trading": trading, "core": shares - trading} if trading and shares - trading else {"trading": shares}
                cash -= shares * c.entry
                until, gain = day, 0.0
                for lot, n in lots.items():
                    end, price, why = (getattr(c, f"{lot}_{x}") for x in ("date", "price", "reason"))
                    early = int(n * r.partial_share) if lot == "trading" and pd.notna(c.partial_price) else 0
                    if early:
                        due.append((c.partial_date, early * c.partial_price, c.symbol, early))
                    free = date.max if why == "backtest_end" else end  # what the end of the bars closes makes room for nothing
                    due.append((free, (n - early) * price, c.symbol, n - early))
                    pnl = (n - early) * (price - c.entry) + (early * (c.partial_price - c.entry) if early else 0.0)
                    rows.append((name, c.symbol, lot, day, c.entry, end, price, why, float(n), risk, pnl, round(pnl / (n * risk), 3), c.partial_date if early else None, c.partial_price if early else None, float(early)))
                    until, gain = max(until, free), gain + pnl
                held[c.symbol] = until, list(c.mark_dates), list(c.mark_closes)
                done.append((until, len(rows), gain / (shares * risk)))
        return pd.DataFrame(rows, columns=[x.split()[0] for x in LOTS.split(", ")])

    if scale is None:
        scaled = found.withColumn("scale", F.lit(1.0))
    else:
        one = scale.select("date", F.lit(1).alias("__k"), "scale")
        days = asof(found.select("date").distinct().withColumn("__k", F.lit(1)), one, ["__k"], "date", "scale")
        scaled = found.join(days.select("date", F.coalesce("scale", F.lit(1.0)).alias("scale")), "date")
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("config"), F.lit(n).alias("slots"), F.lit(p).alias("risk_pct")) for c, n, p in grid]))
    return scaled.withColumn("__c", each).select("*", "__c.*").drop("__c").groupBy("config").applyInPandas(of, ALLOCATED)


def equity(lots: DataFrame, bars: DataFrame, configs: list[str], r: Risk = Risk()) -> DataFrame:
    """(config, date, equity): cash in plus gains of shares sold and of those held at their symbol's last close.

    On its first day a lot is worth what it cost. It is one span of days with all its shares and, after a partial sale, one with the rest. Days are numbered, a span
    becomes its days, and the last close of a symbol comes by an as-of join: no pairs of rows beyond the days held.
    """
    days = bars.select("date").distinct()
    number = days.withColumn("n", F.row_number().over(Window.orderBy("date")))  # as many rows as trading days
    sold = F.coalesce("partial_shares", F.lit(0))
    first = F.struct(F.col("entry_date").alias("a"), F.when(sold > 0, F.col("partial_date")).otherwise(F.col("exit_date")).alias("b"), F.col("shares").alias("held"), F.lit(1).alias("wait"), F.when(sold > 0, sold * (F.col("partial_price") - F.col("entry_price"))).otherwise(F.col("realized_pnl")).alias("gain"))
    rest = F.struct(F.col("partial_date").alias("a"), F.col("exit_date").alias("b"), (F.col("shares") - sold).alias("held"), F.lit(0).alias("wait"), ((F.col("shares") - sold) * (F.col("exit_price") - F.col("entry_price"))).alias("gain"))
    spans = lots.select("config", F.col("name").alias("symbol"), "entry_price", F.explode(F.when(sold > 0, F.array(first, rest)).otherwise(F.array(first))).alias("s")).select("config", "symbol", "entry_price", "s.*")
    at = spans.join(F.broadcast(number.select(F.col("date").alias("a"), F.col("n").alias("na"))), "a").join(F.broadcast(number.select(F.col("date").alias("b"), F.col("n").alias("nb"))), "b")
    held = at.filter("na + wait < nb").withColumn("n", F.explode(F.sequence(F.col("na") + F.col("wait"), F.col("nb") - 1))).groupBy("config", "symbol", "n").agg(F.sum("held").alias("held"), F.sum(F.col("held") * F.col("entry_price")).alias("cost")).join(F.broadcast(number), "n")
    marked = asof(held.select("symbol", "date", "config", "held", "cost"), bars.select("symbol", "date", "close"), ["symbol"], "date", "close")
    marks = marked.groupBy("config", "date").agg(F.sum(F.col("close") * F.col("held") - F.col("cost")).alias("open_gain"))
    closed = spans.groupBy("config", F.col("b").alias("date")).agg(F.sum("gain").alias("pnl"))
    every = days.withColumn("config", F.explode(F.array(*[F.lit(c) for c in configs])))
    total = closed.withColumn("done", F.sum("pnl").over(_by_config())).select("config", "date", "done")
    out = asof(every.select("config", "date"), total, ["config"], "date", "done").join(marks, ["config", "date"], "left")
    return out.select("config", "date", (F.lit(r.capital) + F.coalesce("done", F.lit(0.0)) + F.coalesce("open_gain", F.lit(0.0))).alias("equity"))


def _by_config():
    return Window.partitionBy("config").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)


def exposure(lots: DataFrame, n: int = 10, least: int = 5) -> DataFrame:
    """Scale of the next entry after each closed trade (its lots together): half while the mean R of the last n is negative."""
    trade = lots.groupBy("config", "name", "entry_date").agg(F.max("exit_date").alias("exit_date"), (F.sum("realized_pnl") / F.sum(F.col("shares") * F.col("risk_per_share"))).alias("r"))
    w = Window.partitionBy("config").orderBy("exit_date", "entry_date", "name").rowsBetween(-(n - 1), 0)
    seen = F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return trade.select("config", "exit_date", "name", "entry_date", F.when((seen >= least) & (F.avg("r").over(w) < 0), 0.5).otherwise(1.0).alias("scale"))
