"""Positions, fills, the market's scale of risk, ranked filings and what is kept between runs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeloom.functions import scoring as sc
from tapeloom.functions import text as tx
from tapeloom.operators import asof as aj
from tapeloom.operators import indicators as ind
from tapeloom.operators import patterns, state
from tapeloom.sources.bars import benchmark

from .base import bars, query, table
from .market import BENCH_CTE, BREADTH, W, mean_sql, tags
from .texts import HEAD, KIND, headlines

D = F.col
FRIDAY = "CAST((12 - isodow({d})) % 7 AS INTEGER)"

# The fixture's positions: entered 30 bars ago, flags by the symbol's number.
NUMBER = "substr(symbol, 7)::int"
MANAGED = f"""x AS (SELECT *, {mean_sql('close', 50)} AS sma_short, {mean_sql('close', 150)} AS sma_150, lag(close, 30) {W} AS entry, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS n,
   max(date) OVER (PARTITION BY symbol) AS newest, {NUMBER} AS no FROM bars),
 wk AS (SELECT symbol, arg_max(close, date) AS week_close, arg_max(CASE WHEN sma_150 IS NULL THEN 'NaN'::double ELSE sma_150 END, date) AS week_sma FROM x
   WHERE date + {FRIDAY.format(d='date')} < newest + {FRIDAY.format(d='newest')} OR isodow(date) = 5 GROUP BY 1),
 p AS (SELECT x.*, week_close, nullif(week_sma, 'NaN'::double) AS week_sma, entry*0.95 AS first_stop, entry*(CASE WHEN no % 2 = 0 THEN 0.95 ELSE 0.9 END) AS stop, no % 3 <> 0 AS t, no % 4 <> 0 AS c, no % 5 = 0 AS pt, no % 7 = 0 AS bm FROM x LEFT JOIN wk USING (symbol) WHERE n = 1),
 e AS (SELECT *, coalesce((t OR c) AND entry-first_stop > 0, false) AS live FROM p), f AS (SELECT *, coalesce(live AND low <= stop, false) AS s FROM e),
 g AS (SELECT *, coalesce(live AND NOT s AND t AND NOT pt AND high >= entry+(entry-first_stop)*2.5, false) AS pa, coalesce(live AND NOT s AND NOT bm AND close >= entry+(entry-first_stop)*1.5, false) AS be,
   coalesce(live AND NOT s AND c AND week_close < week_sma, false) AS co FROM f),
 h AS (SELECT *, coalesce(live AND NOT s AND t AND (pt OR pa) AND close < sma_short, false) AS tr FROM g)"""


@query(
    f"""{MANAGED} SELECT symbol, concat_ws(',', CASE WHEN s THEN 'stop' END, CASE WHEN pa THEN 'partial' END, CASE WHEN be THEN 'break even' END, CASE WHEN tr THEN 'trail' END, CASE WHEN co THEN 'core exit' END) AS events,
    round(CASE WHEN be THEN greatest(stop, entry) ELSE stop END, 8) AS stop, t AND NOT s AND NOT tr AS trading_open, c AND NOT s AND NOT co AS core_open, pt OR pa AS partial_taken, bm OR be AS breakeven_moved FROM h""",
    on_bars=True,
)
def managed_positions(spark, sf):
    """Events of each position at its last bar and its flags after them, the weekly exit of the core lot included."""
    b = bars(spark, sf)
    w = Window.partitionBy("symbol").orderBy("date")
    last = ind.last_bar(ind.with_averages(b, (50,)).withColumn("entry", F.lag("close", 30).over(w)))
    no = F.substr("symbol", F.lit(7)).cast("int")
    flags = {"trading_open": no % 3 != 0, "core_open": no % 4 != 0, "partial_taken": no % 5 == 0, "breakeven_moved": no % 7 == 0}
    stop = D("entry") * F.when(no % 2 == 0, 0.95).otherwise(0.9)
    positions = last.select("symbol", "entry", (D("entry") * 0.95).alias("initial_stop"), stop.alias("stop"), *[f.alias(k) for k, f in flags.items()])
    now = last.select("symbol", "date", "low", "high", "close", D("sma_50").alias("sma_short")).join(ind.completed_week(b), "symbol", "left")
    return state.manage(positions, now).withColumn("stop", F.round("stop", 8))


@query(
    f"""v AS (SELECT symbol || '@' || date AS id, symbol, date, {NUMBER} AS no, close, month(date) AS m FROM bars WHERE day(date) = 15),
 q AS (SELECT v.*, b.open AS fill, CASE WHEN no % 7 <> 0 THEN v.close*(CASE WHEN m % 3 = 0 THEN 1.0 ELSE 0.9 END) END AS stop FROM v ASOF LEFT JOIN bars b ON v.symbol = b.symbol AND v.date < b.date),
 z AS (SELECT *, least(floor(12500.0*(CASE WHEN m % 2 = 0 THEN 0.5 ELSE 1.0 END)/(fill-stop)), floor(150000.0/fill)) AS n FROM q),
 a AS (SELECT *, CASE WHEN no % 11 = 0 THEN 'already open' WHEN m = 4 THEN 'no alert' WHEN stop IS NULL THEN 'no stop' WHEN fill IS NULL THEN 'pending' WHEN fill <= stop THEN 'gapped below stop' WHEN n < 2 THEN 'too small' ELSE 'buy' END AS action FROM z)
 SELECT id, symbol, action, CASE WHEN action = 'buy' THEN floor(n*0.5)::bigint END AS shares_trading, CASE WHEN action = 'buy' THEN n::bigint - floor(n*0.5)::bigint END AS shares_core FROM a""",
    on_bars=True,
)
def paper_entries(spark, sf):
    """Verdicts at the closes of the 15th, filled at the open of the next bar, sized and split into two lots."""
    b, no = bars(spark, sf), F.substr("symbol", F.lit(7)).cast("int")
    m = F.month("date")
    stop = F.when(no % 7 != 0, D("close") * F.when(m % 3 == 0, 1.0).otherwise(0.9))
    v = b.filter(F.dayofmonth("date") == 15).select(F.concat("symbol", F.lit("@"), D("date").cast("string")).alias("id"), "symbol", "date", (m != 4).alias("alerted"), stop.alias("stop"), (m % 2 == 0).alias("half"), F.lit(1.0).alias("scale"))
    filled = aj.asof(v, b.select("symbol", "date", D("open").alias("fill_open")), ["symbol"], "date", "fill_open", exact=False, forward=True)
    return state.entries(filled, b.select("symbol").distinct().filter(no % 11 == 0))


@query(
    f"""{BREADTH}, {BENCH_CTE}, sn AS (SELECT date AS sd, symbols, round(breadth, 1) AS pct FROM br WHERE day(date) <= 14),
 bb AS (SELECT date, CASE WHEN count(*) OVER w >= 150 THEN bench < sum(round(bench*10000)::bigint) OVER w/1500000.0::double END AS below FROM bench WINDOW w AS (ORDER BY date ROWS BETWEEN 149 PRECEDING AND CURRENT ROW)),
 j AS (SELECT bb.date, below, pct, coalesce(date_diff('day', sd, bb.date) <= 7 AND symbols >= 15, false) AS fresh FROM bb ASOF LEFT JOIN sn ON bb.date >= sn.sd)
 SELECT date, CASE WHEN CASE WHEN fresh THEN pct < 50 ELSE coalesce(below, false) END THEN 0.5::double ELSE 1.0::double END AS scale, CASE WHEN fresh THEN 'breadth' WHEN below IS NOT NULL THEN 'benchmark' ELSE 'none' END AS rule FROM j""",
    on_bars=True,
)
def market_risk_scale(spark, sf):
    """The scale in force on each day; snapshots are taken in the first half of a month and grow old in the second."""
    b = bars(spark, sf)
    bench = benchmark(b)
    snapshots = ind.breadth(b, least=10).filter(F.dayofmonth("date") <= 14)
    return ind.market_scale(bench.select("date"), snapshots, bench, least=15)


@query(
    f"""{HEAD}, k AS (SELECT id, name, date, {KIND} AS kind, title FROM h), n AS (SELECT name, split_part(kind, ': ', 1) AS polarity, substr(kind, strpos(kind, ': ')+2) AS event, count(*) AS n, max(date) AS latest FROM k WHERE kind IS NOT NULL GROUP BY 1, 2, 3),
 t AS (SELECT *, CASE length(name) % 3 WHEN 0 THEN 'CONFIRMED' WHEN 1 THEN 'WATCH' ELSE 'ANTICIPATION' END AS tag, length(name) % 2 = 0 AS held, length(name)*3 % 100 AS rs FROM n),
 u AS (SELECT *, polarity = 'neg' AND held AS urgent, polarity = 'pos' AND tag IN ('CONFIRMED', 'ANTICIPATION') AS confluence FROM t)
 SELECT name, polarity, event, n, latest, urgent, confluence, row_number() OVER (ORDER BY CASE WHEN urgent THEN 0 WHEN confluence THEN 1 WHEN polarity = 'pos' THEN 2 WHEN polarity = 'neg' THEN 3 ELSE 4 END, rs DESC, name, polarity, event) AS place FROM u"""
)
def radar_ranked(spark, sf):
    """Filings of a name, kind and event as one row, with the flags of urgency and confluence and their place."""
    k = headlines(spark, sf).withColumn("k", tx.classify(D("title"))).filter("k is not null")
    found = k.groupBy("name", D("k.polarity").alias("polarity"), D("k.event").alias("event")).agg(F.count(F.lit(1)).alias("n"), F.max("date").alias("latest"))
    size = F.length("name")
    tag = F.when(size % 3 == 0, "CONFIRMED").when(size % 3 == 1, "WATCH").otherwise("ANTICIPATION")
    rank = sc.radar(D("polarity"), tag, size % 2 == 0)
    ranked = found.withColumns({"rank": rank, "rs": size * 3 % 100})
    place = F.row_number().over(Window.orderBy("rank", F.desc("rs"), "name", "polarity", "event")).cast("long")  # a row a name and event
    return ranked.select("name", "polarity", "event", "n", "latest", (D("rank") == 0).alias("urgent"), (D("rank") == 1).alias("confluence"), place.alias("place"))


@query()
def validated_entries(spark, sf):
    """Confirmed bars that also break out of a valid base with volume: what the backtest would enter."""
    b = bars(spark, sf)
    found = patterns.signals(b).filter("breakout").select("symbol", "date").withColumn("entry", F.lit(True))
    confirmed = tags(b).filter("tag = 'CONFIRMED'").select("symbol", "date", "tag")
    return confirmed.join(found, ["symbol", "date"], "left").select("symbol", "date", F.coalesce("entry", F.lit(False)).alias("validated_entry"))


@query("WITH d AS (SELECT DISTINCT o_orderdate::date AS day FROM orders ORDER BY 1 DESC LIMIT 90) SELECT o_orderkey, o_orderdate::date AS day FROM orders WHERE o_orderdate::date IN (SELECT day FROM d)")
def snapshots_kept(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return state.keep_newest(o, "day", 90)


@query("SELECT event_id, ts::date AS day FROM events WHERE ts::date >= (SELECT max(ts::date) FROM events) - 7")
def details_unexpired(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.to_date("ts").alias("day"))
    return state.unexpired(e, "day", e.agg(F.max("day")).scalar(), 7)
