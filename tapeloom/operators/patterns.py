"""Swing patterns: zigzag pivots, contractions, volatility contraction, breakouts; one grouped map by symbol.

A symbol's bars are at most its trading days, so that a group fits into memory at any size of the market.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.config import Technical

from . import indicators as ind


def _turn(extreme: np.ndarray, against: np.ndarray, start: int, pct: float, up: bool) -> tuple[int, int] | None:
    """(bar of the extreme, bar that confirms it) of the leg that starts at a bar: the first later bar whose opposite
    price lies pct or more from the leg's extreme so far."""
    run = np.maximum.accumulate(extreme[start:]) if up else np.minimum.accumulate(extreme[start:])
    with np.errstate(divide="ignore", invalid="ignore"):
        move = np.where(run != 0, (run - against[start:]) / run * 100 * (1 if up else -1), 0.0)
    hit = np.flatnonzero(move[1:] >= pct)
    if not len(hit):
        return None
    end = int(hit[0]) + 1
    return start + int(np.argmax(run[: end + 1] == run[end])), start + end


def zigzag(high: np.ndarray, low: np.ndarray, pct: float) -> list[tuple[int, float, str]]:
    """Pivots (bar, price, 'high' or 'low'): swings that were reversed by pct, then the one that is still forming."""
    n, out, start, up = len(high), [], 0, None
    if n < 3:
        return out
    tops, bottoms = _turn(high, low, 0, pct, True), _turn(low, high, 0, pct, False)
    if tops is None and bottoms is None:
        return out
    # The first leg may go either way; at the same bar a fall from the top counts.
    up = bottoms is None or (tops is not None and tops[1] <= bottoms[1])
    turn = tops if up else bottoms
    while turn is not None:
        at, start = turn
        out.append((at, float(high[at] if up else low[at]), "high" if up else "low"))
        up = not up
        turn = _turn(high, low, start, pct, True) if up else _turn(low, high, start, pct, False)
    part = high[start:] if up else low[start:]
    at = start + int(np.argmax(part) if up else np.argmin(part))
    out.append((at, float(part[at - start]), "high" if up else "low"))
    return out


def contractions(high: np.ndarray, low: np.ndarray, pct: float) -> list[tuple[float, float, float]]:
    """(peak, trough, depth in per cent, rounded) of each fall between neighbouring pivots; none in under 10 bars."""
    if len(high) < 10:
        return []
    p = zigzag(high, low, pct)
    return [(a[1], b[1], round((a[1] - b[1]) / a[1] * 100, 2)) for a, b in zip(p[:-1], p[1:], strict=True) if a[2] == "high" and b[2] == "low" and a[1] > 0]


def vcp(high: np.ndarray, low: np.ndarray, volume: np.ndarray, t: Technical = Technical()) -> tuple[bool, float | None, list[float]]:
    """(valid, pivot price, depths) of a window: shrinking falls, the first not too deep, on drying volume."""
    legs = contractions(high, low, t.zigzag_pct)
    if len(legs) < 2:
        return False, None, [d for _, _, d in legs]
    first, last = legs[-2][2], legs[-1][2]
    usual = volume.mean()
    dry = bool(usual) and volume[-10:].mean() / usual <= t.dry_up
    return first > last and first <= t.vcp_depth_pct and dry, legs[-1][0], [d for _, _, d in legs]


SIGNALS = "symbol string, date date, close double, atr double, volume double, avg_vol double, vcp_valid boolean, pivot_price double, n_contractions int, breakout boolean"


def signals(bars: DataFrame, t: Technical = Technical()) -> DataFrame:
    """VCP and breakout of every bar that passes the trend template."""
    ready = ind.with_volume_average(ind.with_atr(ind.with_template(bars, t)))

    def of(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("date")
        high, low, vol, close = (df[c].to_numpy(float) for c in ("high", "low", "volume", "close"))
        usual = df["avg_vol"].to_numpy(float)
        rows = []
        for i in np.flatnonzero(df["template"].fillna(False).to_numpy(bool)):
            if i < t.vcp_bars:
                continue
            w = slice(i - t.vcp_bars + 1, i + 1)
            valid, pivot, depths = vcp(high[w], low[w], vol[w], t)
            out = valid and close[i] > pivot and vol[i] >= t.breakout_volume * usual[i]
            rows.append((df["symbol"].iat[i], df["date"].iat[i], close[i], df["atr"].iat[i], vol[i], usual[i], valid, pivot, len(depths), bool(out)))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in SIGNALS.split(", ")])

    return ready.select("symbol", "date", "high", "low", "close", F.col("volume").cast("double").alias("volume"), "atr", "avg_vol", "template").groupBy("symbol").applyInPandas(of, SIGNALS)


def pivots(bars: DataFrame, pct: float = Technical.zigzag_pct) -> DataFrame:
    """Zigzag pivots of each symbol's whole history."""

    def of(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("date")
        found = zigzag(df["high"].to_numpy(float), df["low"].to_numpy(float), pct)
        return pd.DataFrame([(df["symbol"].iat[0], df["date"].iat[i], p, k) for i, p, k in found], columns=["symbol", "date", "price", "kind"])

    return bars.select("symbol", "date", "high", "low").groupBy("symbol").applyInPandas(of, "symbol string, date date, price double, kind string")
