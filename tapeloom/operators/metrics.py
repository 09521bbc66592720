"""Statistics of trades, lots and equity curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeloom.functions.windows import ratio, rounded


def trade_stats(pnl: Column, r: Column) -> list[Column]:
    won, lost = F.avg(F.when(pnl > 0, r)), F.avg(F.when(pnl <= 0, r))
    return [
        F.count(F.lit(1)).alias("trades"),
        F.round(F.avg(F.when(pnl > 0, 100.0).otherwise(0.0)), 4).alias("win_pct"),
        F.round(won, 4).alias("avg_win_r"),
        F.round(lost, 4).alias("avg_loss_r"),
        F.round(F.abs(won / F.nullif(lost, F.lit(0.0))), 4).alias("payoff"),
        F.round(F.avg(r), 4).alias("expectancy_r"),
        F.round(F.sum(r), 2).alias("total_r"),
        F.max(r).alias("max_r"),
        F.min(r).alias("min_r"),
    ]


def apply_costs(df: DataFrame, pct: float = 0.15) -> DataFrame:
    """Costs on the value at entry and at exit of the lot's full shares."""
    cost = (F.col("entry_price") + F.col("exit_price")) * F.col("shares") * pct / 100
    net = F.col("pnl") - cost
    return df.withColumn("net_pnl", net).withColumn("net_r", net / F.nullif(F.col("risk") * F.col("shares"), F.lit(0.0)))


def equity_stats(eq: DataFrame, *by: str) -> DataFrame:
    """Total return, drawdown and yearly growth of (date, equity), for each group."""
    top = F.max("equity").over(Window.partitionBy(*by).orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    first, last = F.min_by("equity", "date"), F.max_by("equity", "date")
    years = F.greatest(F.date_diff(F.max("date"), F.min("date")) / 365.25, F.lit(1e-6))
    return eq.withColumn("__dd", ratio(F.col("equity"), top) - 1).groupBy(*by).agg(F.round((ratio(last, first) - 1) * 100, 4).alias("return_pct"), F.round(F.min("__dd") * 100, 4).alias("max_drawdown_pct"), F.round((F.pow(ratio(last, first), 1 / years) - 1) * 100, 3).alias("cagr_pct"))


def corrected_cagr(eq: DataFrame, start: Column, *by: str, least_years: float = 0.5) -> DataFrame:
    """Yearly growth of (date, equity) counted from start on where the curve begins before it, for each group."""
    years = F.greatest(F.date_diff(F.max("date"), F.greatest(F.min("date"), F.min(start))) / 365.25, F.lit(least_years))
    return eq.groupBy(*by).agg(F.round((F.pow(ratio(F.max_by("equity", "date"), F.min_by("equity", "date")), 1 / years) - 1) * 100, 3).alias("cagr_pct"))


def outcomes(signals: DataFrame, bars: DataFrame, by_zero: bool = False) -> DataFrame:
    """What became of signals (id, symbol, date, close, stop): highs and lows in units of risk up to the day the stop
    was hit, the return to date, and -1 R where it was hit. Bars come as one array a symbol (as long as its trading days),
    cut at the day of the signal and at the hit, so that no row is made for a pair of signal and bar.
    Without risk the values are null, with by_zero infinite or NaN."""
    day = F.struct(F.col("date").alias("d"), "high", "low", F.col("close").alias("c"))
    series = bars.groupBy("symbol").agg(F.sort_array(F.collect_list(day)).alias("__bars"))
    later = signals.join(series, "symbol", "left").withColumn("__bars", F.filter("__bars", lambda x: x["d"] > F.col("date")))
    hit = F.array_position(F.transform("__bars", lambda x: x["low"] <= F.col("stop")), True)
    risk = F.col("close") - F.col("stop")
    risk = risk if by_zero else F.nullif(risk, F.lit(0.0))
    seen = later.withColumn("__hit", F.coalesce(hit, F.lit(0)).cast("int"))
    seen = seen.withColumn("__bars", F.when(F.col("__hit") > 0, F.slice("__bars", F.lit(1), F.greatest("__hit", F.lit(1)))).otherwise(F.col("__bars")))
    best = F.array_max(F.transform("__bars", lambda x: ratio(x["high"] - F.col("close"), risk)))
    worst = F.array_min(F.transform("__bars", lambda x: ratio(x["low"] - F.col("close"), risk)))
    now = ratio(F.try_element_at("__bars", F.lit(-1))["c"] - F.col("close"), risk)
    status = F.when(F.coalesce(F.size("__bars"), F.lit(0)) <= 0, "no data yet").when(F.col("__hit") > 0, "stopped").otherwise("open")
    return seen.select("id", "symbol", "date", rounded(best, 4).alias("max_favorable_r"), rounded(worst, 4).alias("max_adverse_r"), rounded(F.when(F.col("__hit") > 0, -1.0).otherwise(now), 4).alias("r_to_date"), status.alias("status"))
