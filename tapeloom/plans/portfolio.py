"""Queries of patterns, simulation, point-in-time tables, state and audits."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeloom.functions.windows import clip01, ratio
from tapeloom.operators import indicators as ind
from tapeloom.operators import metrics as mt
from tapeloom.operators import patterns, simulate, state

from .base import bars, query, table
from .market import r
from .screen import c01

D = F.col
GRID = [("slots12", 12, 1.25), ("slots5", 5, 1.25), ("slots12_risk2", 12, 2.0)]


@query()
def zigzag_pivots(spark, sf):
    return patterns.pivots(bars(spark, sf))


@query()
def generate_signals(spark, sf):
    return patterns.signals(bars(spark, sf))


def candidates(b):
    """Closes above the 60-bar high on volume, as entries of the simulation."""
    x = ind.with_volume_average(b, 50, 50).withColumn("top", F.max("high").over(Window.partitionBy("symbol").orderBy("date").rowsBetween(-60, -1)))
    return x.filter("close > top and volume >= 1.2 * avg_vol").select("symbol", "date", F.lit(None).cast("double").alias("stop"))


@query()
def trade_paths(spark, sf):
    b = bars(spark, sf)
    return simulate.paths(b, candidates(b))


def lots(spark, sf):
    b = bars(spark, sf)
    return b, simulate.allocate(simulate.paths(b, candidates(b)), GRID)


@query()
def backtest_lots(spark, sf):
    return lots(spark, sf)[1]


@query()
def equity_curve(spark, sf):
    b, found = lots(spark, sf)
    return simulate.equity(found, b, [g[0] for g in GRID])


@query()
def config_grid(spark, sf):
    found = lots(spark, sf)[1]
    return found.groupBy("config").agg(*mt.trade_stats(D("realized_pnl"), D("r_multiple")))


@query()
def backtest_options(spark, sf):
    """Lots under all options: next open, gap stops, a scale by breadth, halving after losses, sizes by equity, scores."""
    b = bars(spark, sf)
    x = D("breadth_pct")
    scale = ind.breadth(b, least=10).select("date", F.when(x < 50, 0.5).otherwise(1.0).alias("scale"))
    scored = candidates(b).withColumn("score", F.pmod(F.xxhash64("symbol", "date"), F.lit(101)) / 100.0)
    found = simulate.paths(b, scored, gap_stops=True, patience_score=0.6, next_open=True)
    return simulate.allocate(found, GRID, scale=scale, scale_of=simulate.after_losses, size_on="equity", min_score=0.2, rank_by="score", split="score")


@query()
def progressive_exposure(spark, sf):
    return simulate.exposure(lots(spark, sf)[1])


Q_SQL = """WITH q AS (SELECT c_mktsegment AS segment, last_day((date_trunc('quarter', o_orderdate::date) + INTERVAL 2 MONTH)::date) AS period_end, sum(round(o_totalprice*100)::bigint)::bigint AS cents FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
 g AS (SELECT *, cents/lag(cents, 4) OVER (PARTITION BY segment ORDER BY period_end)::double - 1 AS growth FROM q)"""


@query(f"{Q_SQL} SELECT segment, period_end, period_end + 45 AS known_as_of, round(growth, 8) AS growth, round({c01('0.5+least(greatest(growth,-1.0),2.0)/2')}, 8) AS score FROM g WHERE growth IS NOT NULL")
def pit_score_events(spark, sf):
    """Quarterly growth of a segment, known 45 days after the quarter's end."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    end = F.last_day(F.add_months(F.trunc(F.to_date("o_orderdate"), "quarter"), 2))
    q = o.join(c, o.o_custkey == c.c_custkey).groupBy(D("c_mktsegment").alias("segment"), end.alias("period_end")).agg(F.sum(F.round(D("o_totalprice") * 100).cast("long")).alias("cents"))
    g = q.withColumn("growth", D("cents") / F.lag("cents", 4).over(Window.partitionBy("segment").orderBy("period_end")) - 1).filter("growth is not null")
    score = clip01(0.5 + F.least(F.greatest("growth", F.lit(-1.0)), F.lit(2.0)) / 2)
    return g.select("segment", "period_end", F.date_add("period_end", 45).alias("known_as_of"), r(D("growth")).alias("growth"), r(score).alias("score"))


@query("WITH e AS (SELECT user_id || '|' || event_type || '|' || props AS k, ts FROM events) SELECT DISTINCT k FROM e WHERE ts >= TIMESTAMP '2024-01-16' AND k NOT IN (SELECT k FROM e WHERE ts < TIMESTAMP '2024-01-16' AND k IS NOT NULL)")
def archive_anti_join(spark, sf):
    """What happened since the middle of the month that the archive of the days before lacks."""
    e = table(spark, sf, "events").select(F.concat_ws("|", D("user_id").cast("string"), "event_type", "props").alias("k"), "ts")
    return state.unseen(e.filter("ts >= '2024-01-16'").select("k"), e.filter("ts < '2024-01-16'").select("k"), D("k"))


@query("SELECT event_id, CASE WHEN ts::date >= DATE '2024-01-20' THEN value + 1 ELSE value END AS value FROM events")
def snapshot_replace_by_key(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.to_date("ts").alias("day"), "value")
    return state.replace_by_key(e, e.filter("day >= DATE'2024-01-20'").withColumn("value", D("value") + 1), "day").select("event_id", "value")


@query("WITH d AS (SELECT DISTINCT user_id, ts::date AS day FROM events WHERE event_type = 'purchase'), p AS (SELECT *, lag(day) OVER (PARTITION BY user_id ORDER BY day) AS before FROM d) SELECT user_id, day FROM p WHERE before IS NULL OR date_diff('day', before, day) > 3")
def ep_alert_dedupe(spark, sf):
    d = table(spark, sf, "events").filter("event_type = 'purchase'").select("user_id", F.to_date("ts").alias("day")).distinct()
    return state.once_within(d, ["user_id"], "day", 3)


@query("WITH a AS (SELECT DISTINCT user_id FROM events WHERE ts < TIMESTAMP '2024-01-03'), b AS (SELECT DISTINCT user_id FROM events WHERE ts >= TIMESTAMP '2024-01-28'), x AS (SELECT count(*) AS was, count(b.user_id) AS stayed FROM a LEFT JOIN b USING (user_id)) SELECT was, stayed, was-stayed AS \"left\", round(100.0*(was-stayed)/was, 4) AS churn_pct FROM x")
def constituent_churn(spark, sf):
    e = table(spark, sf, "events")
    return state.churn(e.filter("ts < '2024-01-03'"), e.filter("ts >= '2024-01-28'"), "user_id")


@query("WITH a AS (SELECT c_custkey AS k, c_acctbal AS score, (c_custkey % 10)/10.0::double AS coverage FROM customer WHERE c_custkey % 2 = 0), w AS (SELECT c_custkey AS k, -c_acctbal AS score, (c_custkey % 7)/10.0::double AS coverage FROM customer WHERE c_custkey % 3 = 0) SELECT k, CASE WHEN w.coverage IS NULL OR a.coverage >= w.coverage THEN a.score ELSE w.score END AS score, CASE WHEN w.coverage IS NULL OR a.coverage >= w.coverage THEN a.coverage ELSE w.coverage END AS coverage FROM a FULL JOIN w USING (k)")
def detail_merge(spark, sf):
    c = table(spark, sf, "customer").withColumn("k", D("c_custkey"))
    a = c.filter("k % 2 = 0").select("k", D("c_acctbal").alias("score"), (D("k") % 10 / 10.0).alias("coverage"))
    w = c.filter("k % 3 = 0").select("k", (-D("c_acctbal")).alias("score"), (D("k") % 7 / 10.0).alias("coverage"))
    return state.merge_details(a, w, "k")


@query("WITH p AS (SELECT c_custkey AS symbol, c_custkey % 20 AS shares FROM customer WHERE c_custkey % 2 = 0), h AS (SELECT c_custkey AS symbol, c_custkey % 40 AS quantity FROM customer WHERE c_custkey % 3 = 0) SELECT symbol, shares, quantity, CASE WHEN quantity IS NULL THEN 'not held' WHEN shares IS NULL THEN 'not tracked' WHEN shares <> quantity THEN 'quantity differs' ELSE 'equal' END AS state FROM p FULL JOIN h USING (symbol)")
def holdings_reconcile(spark, sf):
    c = table(spark, sf, "customer").withColumn("symbol", D("c_custkey"))
    return state.reconcile(c.filter("symbol % 2 = 0").withColumn("shares", D("symbol") % 20), c.filter("symbol % 3 = 0").withColumn("quantity", D("symbol") % 40))


POS = "x AS (SELECT *, avg(close) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS trail, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS n, lag(close, 30) OVER (PARTITION BY symbol ORDER BY date) AS entry FROM bars), p AS (SELECT *, entry*0.95 AS stop, symbol < 'Brand#3' AS pt, symbol < 'Brand#2' AS bm FROM x WHERE n = 1)"


@query(f"{POS} SELECT symbol, date, CASE WHEN low <= stop THEN 'stop' WHEN NOT pt AND high >= entry+2.5*(entry-stop) THEN 'partial' WHEN NOT bm AND close >= entry+1.5*(entry-stop) THEN 'break even' WHEN pt AND close < trail THEN 'trail' ELSE 'hold' END AS event FROM p", on_bars=True)
def position_check(spark, sf):
    w = Window.partitionBy("symbol").orderBy("date")
    x = ind.last_bar(bars(spark, sf).withColumns({"trail": F.avg("close").over(w.rowsBetween(-49, 0)), "entry": F.lag("close", 30).over(w)}))
    p = x.select("symbol", "entry", (D("entry") * 0.95).alias("stop"), (D("symbol") < "Brand#3").alias("partial_taken"), (D("symbol") < "Brand#2").alias("breakeven_moved"))
    return state.check_positions(p, x.drop("entry"))


CAP = "w(days) AS (VALUES (7), (30), (91), (365)), e AS (SELECT max(date) AS today FROM bars), z AS (SELECT days, symbol, arg_min(close, date) AS a, arg_max(close, date) AS b, max(high) AS top FROM bars, w, e WHERE date >= today - days GROUP BY 1, 2)"


@query(f"{CAP} SELECT days, symbol, round((b/a-1)*100, 8) AS return_pct, round((top/a-1)*100, 8) AS peak_pct FROM z", on_bars=True)
def capture_windows(spark, sf):
    """Return and peak of each symbol over the last 7, 30, 91 and 365 days, in one pass of the bars."""
    b = bars(spark, sf)
    x = b.withColumn("today", b.agg(F.max("date")).scalar())
    each = x.withColumn("days", F.explode(F.array(*[F.lit(n) for n in (7, 30, 91, 365)]))).filter(D("date") >= F.date_sub("today", D("days")))
    g = each.groupBy("days", "symbol").agg(F.min_by("close", "date").alias("a"), F.max_by("close", "date").alias("b"), F.max("high").alias("top"))
    return g.select("days", "symbol", r((ratio(D("b"), D("a")) - 1) * 100).alias("return_pct"), r((ratio(D("top"), D("a")) - 1) * 100).alias("peak_pct"))
