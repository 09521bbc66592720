"""Panels and rankings over the results of other queries; their SQL goes on from those queries' SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeloom.operators import indicators as ind
from tapeloom.operators import metrics as mt

from .base import ORACLE, QUERIES, bars, query
from .market import mean_sql, r

D = F.col


def over(name: str) -> str:
    return f"({ORACLE[name]})"


def at(name: str, spark, sf):
    return QUERIES[name](spark, sf)


def ranked(df, *order):
    """With the place of each row: of all rows as the order has them, by a bounded table's single window."""
    return df.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))


@query(f"SELECT symbol, date, date >= DATE '1995-01-01' AS breakout FROM {over('breakout_over_pivot')}")
def breakouts_from_date(spark, sf):
    """Breakouts before the window are no signals."""
    return at("breakout_over_pivot", spark, sf).select("symbol", "date", (D("date") >= F.lit("1995-01-01").cast("date")).alias("breakout"))


@query(f"SELECT symbol, date, CASE WHEN v.pivot_price IS NOT NULL THEN 'vcp' ELSE 'ep' END AS setup, e.gap_pct IS NOT NULL AS on_gap, coalesce(v.pivot_price*0.92, e.stop) AS stop FROM {over('breakout_over_pivot')} v FULL JOIN {over('episodic_pivots')} e USING (symbol, date)")
def vcp_and_gap_signals(spark, sf):
    """Breakouts and gap entries together; where both are, the breakout's stop counts; the rest are gap entries alone."""
    v, e = at("breakout_over_pivot", spark, sf).drop("close"), at("episodic_pivots", spark, sf)
    both = v.join(e, ["symbol", "date"], "full")
    return both.select("symbol", "date", F.when(D("pivot_price").isNotNull(), "vcp").otherwise("ep").alias("setup"), D("gap_pct").isNotNull().alias("on_gap"), F.coalesce(D("pivot_price") * 0.92, "stop").alias("stop"))


@query(f"SELECT 'sector' || (substr(symbol, 7)::int % 5) AS industry, round(avg(rs_pctile), 6) AS mean_rs, count(*) AS stocks FROM {over('rs_percentile')} GROUP BY 1 HAVING count(*) >= 3 ORDER BY 2 DESC, 1 LIMIT 18")
def industry_rs_heat(spark, sf):
    """The 18 strongest industries by the mean strength percentile of their stocks, of three at least."""
    x = at("rs_percentile", spark, sf).groupBy(F.concat(F.lit("sector"), F.expr("int(substr(symbol, 7)) % 5")).alias("industry"))
    return x.agg(F.round(F.avg("rs_pctile"), 6).alias("mean_rs"), F.count(F.lit(1)).alias("stocks")).filter("stocks >= 3").orderBy(F.desc("mean_rs"), "industry").limit(18)


@query(f"SELECT tag, count(*) AS n, count(DISTINCT symbol) AS symbols FROM {over('watchlist_tags')} GROUP BY 1")
def tag_counts(spark, sf):
    return at("watchlist_tags", spark, sf).groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("symbol").alias("symbols"))


@query(f"SELECT id, composite, listed, row_number() OVER (ORDER BY listed DESC, composite DESC, id) AS place FROM {over('shortlist_composite')} ORDER BY place LIMIT 50")
def shortlist_order(spark, sf):
    """The first 50: what is listed before what is not, then by score."""
    best = at("shortlist_composite", spark, sf).orderBy(F.desc("listed"), F.desc("composite"), "id").limit(50)
    return ranked(best, F.desc("listed"), F.desc("composite"), "id")


@query(f"SELECT id, score, label, row_number() OVER (ORDER BY score DESC NULLS LAST, id) AS place FROM {over('conviction_assess')} ORDER BY place LIMIT 20")
def ranked_candidates(spark, sf):
    """The 20 candidates of a run by conviction."""
    order = F.desc_nulls_last("score"), D("id")
    return ranked(at("conviction_assess", spark, sf).select("id", "score", "label").orderBy(*order).limit(20), *order)


@query(f"SELECT symbol, date, volume_times, row_number() OVER (PARTITION BY date ORDER BY volume_times DESC, symbol) AS place FROM {over('episodic_pivots')}")
def gaps_by_volume(spark, sf):
    """The gap entries of each day, most unusual volume first."""
    w = Window.partitionBy("date").orderBy(F.desc("volume_times"), "symbol")
    return at("episodic_pivots", spark, sf).select("symbol", "date", "volume_times", F.row_number().over(w).cast("long").alias("place"))


@query("t AS (SELECT symbol, date, close, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS newest FROM bars) SELECT * FROM t WHERE newest <= 5", on_bars=True)
def last_bars_newest_first(spark, sf):
    w = Window.partitionBy("symbol").orderBy(F.desc("date"))
    return bars(spark, sf).select("symbol", "date", "close", F.row_number().over(w).cast("long").alias("newest")).filter("newest <= 5")


def flag_missing(df, required):
    """The rows that lack any of the required columns."""
    return df.filter(reduce(lambda a, b: a | b, [D(c).isNull() for c in required]))


@query(f"s AS (SELECT symbol, date, {mean_sql('close', 50)} AS sma_50, {mean_sql('close', 200)} AS sma_200 FROM bars) SELECT symbol, date, sma_50 IS NULL AS lacks_short FROM s WHERE sma_50 IS NULL OR sma_200 IS NULL", on_bars=True)
def bars_with_missing_averages(spark, sf):
    found = flag_missing(ind.with_averages(bars(spark, sf), (50, 200)), ["sma_50", "sma_200"])
    return found.select("symbol", "date", D("sma_50").isNull().alias("lacks_short"))


@query(
    f"""WITH l AS (SELECT symbol, tag, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS n FROM {over('watchlist_tags')}),
    j AS (SELECT symbol, tag, rs_pctile FROM l LEFT JOIN {over('rs_percentile')} p USING (symbol) WHERE n = 1 AND tag <> 'BROKEN')
    SELECT symbol, tag, rs_pctile, row_number() OVER (ORDER BY rs_pctile DESC NULLS LAST, symbol) AS place FROM j"""
)
def screener_table(spark, sf):
    """The last tag of each symbol without the broken ones, strongest first, those without a percentile last."""
    last = ind.last_bar(at("watchlist_tags", spark, sf)).filter("tag <> 'BROKEN'").select("symbol", "tag")
    joined = last.join(at("rs_percentile", spark, sf).select("symbol", "rs_pctile"), "symbol", "left")
    return ranked(joined, F.desc_nulls_last("rs_pctile"), D("symbol"))


CAGR = "SELECT symbol, round((pow(arg_max(close, date)/arg_min(close, date), 1/greatest(date_diff('day', greatest(min(date), DATE '1996-01-01'), max(date))/365.25, 0.5))-1)*100, 3) AS cagr_pct FROM bars WHERE date >= DATE '1995-07-01' GROUP BY 1"


@query(CAGR, on_bars=True)
def corrected_cagr(spark, sf):
    """Yearly growth from the start of the trading window on, of half a year at least; the curve may begin before it."""
    start = F.lit("1996-01-01").cast("date")
    return mt.corrected_cagr(bars(spark, sf).filter("date >= DATE'1995-07-01'").select("symbol", "date", D("close").alias("equity")), start, "symbol")
