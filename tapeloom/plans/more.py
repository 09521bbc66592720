"""Further queries: comparisons, cohorts, audits, labels, rankings, unions and documents."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window


from tapeloom.functions import scoring as sc
from tapeloom.functions import text as tx
from tapeloom.functions import vocabulary as v
from tapeloom.functions.windows import back, by_symbol, price_sum, ratio
from tapeloom.operators import asof as aj
from tapeloom.operators import indicators as ind
from tapeloom.operators import metrics as mt
from tapeloom.sources.bars import benchmark

from .base import bars, query, table
from .market import ATR_CTE, BENCH_CTE, TAGS, W, mean_sql, r, tags
from .screen import EARN, FIG_SQL, SANE, SMART, STRONG, TRADES, V1, dims, figures, trades, v1
from .texts import HEAD, ROUND, headlines, hits, lst

D = F.col


@query(f"{BENCH_CTE}, s AS (SELECT symbol, min(date) AS a, max(date) AS z, arg_min(close, date) AS c0, arg_max(close, date) AS c1 FROM bars GROUP BY 1) SELECT symbol, round((c1/c0-1)*100, 8) AS return_pct, round((y.bench/x.bench-1)*100, 8) AS bench_pct FROM s JOIN bench x ON x.date = a JOIN bench y ON y.date = z", on_bars=True)
def benchmark_compare(spark, sf):
    b = bars(spark, sf)
    m = b.join(benchmark(b), "date").groupBy("symbol").agg(*[f(c, "date").alias(n) for c, s in (("close", "c"), ("bench", "b")) for f, n in ((F.min_by, s + "0"), (F.max_by, s + "1"))])
    return m.select("symbol", r((ratio(D("c1"), D("c0")) - 1) * 100).alias("return_pct"), r((ratio(D("b1"), D("b0")) - 1) * 100).alias("bench_pct"))


@query("s AS (SELECT symbol, date, close AS equity FROM bars WHERE date >= DATE '1999-01-01'), d AS (SELECT *, equity/max(equity) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)-1 AS dd FROM s) SELECT symbol, round((arg_max(equity, date)/arg_min(equity, date)-1)*100, 4) AS return_pct, round(min(dd)*100, 4) AS max_drawdown_pct FROM d GROUP BY 1", on_bars=True)
def segment_stats(spark, sf):
    s = bars(spark, sf).filter("date >= DATE'1999-01-01'").select("symbol", "date", D("close").alias("equity"))
    return mt.equity_stats(s, "symbol").drop("cagr_pct")


@query(f"{TRADES}, c AS (SELECT name, exit_reason, count(*) AS n, avg(r) AS a, median(r) AS m, max(r) AS x, avg(CASE WHEN r < 0 THEN 100.0 ELSE 0 END) AS s FROM u GROUP BY 1, 2) SELECT name, exit_reason, n, CASE WHEN n >= 300 THEN round(a, 6) END AS avg_r, CASE WHEN n >= 300 THEN round(m, 6) END AS median_r, CASE WHEN n >= 300 THEN x END AS best_r, CASE WHEN n >= 300 THEN round(s, 6) END AS stopped_pct FROM c")
def forensics_cohorts(spark, sf):
    """Statistics of cohorts; those of small cohorts are suppressed."""
    g = trades(spark, sf).groupBy("name", "exit_reason").agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("a"), F.median("r").alias("m"), F.max("r").alias("x"), F.avg(F.when(D("r") < 0, 100.0).otherwise(0.0)).alias("s"))
    enough = lambda c: F.when(D("n") >= 300, c)
    return g.select("name", "exit_reason", "n", enough(F.round("a", 6)).alias("avg_r"), enough(F.round("m", 6)).alias("median_r"), enough(D("x")).alias("best_r"), enough(F.round("s", 6)).alias("stopped_pct"))


@query("SELECT event_type, count_if(value >= 50)::bigint AS caught, count(value) AS eligible FROM events GROUP BY 1")
def recall_by_group(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count_if(D("value") >= 50).alias("caught"), F.count("value").alias("eligible"))


SALES = "WITH p AS (SELECT o_custkey, array_agg(o_totalprice ORDER BY o_orderdate, o_orderkey) AS v FROM orders GROUP BY 1)"


@query(f"{SALES} SELECT o_custkey, v[-1] AS latest, v[-5] AS year_ago, round(v[-1]/v[-5]-1, 8) AS yoy, len(v) AS n FROM p")
def flatten_latest_and_yoy(spark, sf):
    """Last value of a series and its change against the fifth last; null where the series is short."""
    s = table(spark, sf, "orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey", "o_totalprice"))), lambda x: x["o_totalprice"]).alias("v"))
    last, ago = F.try_element_at("v", F.lit(-1)), F.try_element_at("v", F.lit(-5))
    return s.select("o_custkey", last.alias("latest"), ago.alias("year_ago"), r(last / ago - 1).alias("yoy"), F.size("v").cast("long").alias("n"))


@query("WITH q AS (SELECT o_custkey AS name, o_totalprice AS holding, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders), k AS (SELECT * FROM q WHERE n <= 4) SELECT name, count(*) AS quarters, arg_max(holding, n) AS first, arg_min(holding, n) AS last, arg_min(holding, n) < arg_max(holding, n)*0.9 AS falling FROM k GROUP BY 1 HAVING count(*) >= 2")
def holding_trend(spark, sf):
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    k = table(spark, sf, "orders").withColumn("n", n).filter("n <= 4")
    g = k.groupBy(D("o_custkey").alias("name")).agg(F.count(F.lit(1)).alias("quarters"), F.max_by("o_totalprice", "n").alias("first"), F.min_by("o_totalprice", "n").alias("last"))
    return g.filter("quarters >= 2").withColumn("falling", D("last") < D("first") * 0.9)


@query(TAGS + ", f AS (SELECT symbol, min(CASE WHEN tag = 'CONFIRMED' THEN date END) AS seen, count_if(tag = 'CONFIRMED')::bigint AS confirmed, count_if(tag = 'BROKEN')::bigint AS broken FROM tagged GROUP BY 1) SELECT f.symbol, seen, confirmed, broken, max(b.high) AS peak FROM f LEFT JOIN bars b ON f.symbol = b.symbol AND b.date >= seen GROUP BY 1, 2, 3, 4", on_bars=True)
def exemplar_capture(spark, sf):
    """First day a symbol was confirmed, its peak from there, and how often it had which tag."""
    b = bars(spark, sf)
    f = tags(b).groupBy("symbol").agg(F.min(F.when(D("tag") == "CONFIRMED", D("date"))).alias("seen"), F.count_if(D("tag") == "CONFIRMED").alias("confirmed"), F.count_if(D("tag") == "BROKEN").alias("broken"))
    return b.select("symbol", "date", "high").join(f, "symbol", "right").groupBy("symbol", "seen", "confirmed", "broken").agg(F.max(F.when(D("date") >= D("seen"), D("high"))).alias("peak"))


LABELS = {"view": "looked at", "click": "followed", "purchase": "bought"}


@query("SELECT event_type, CASE event_type WHEN 'view' THEN 'looked at' WHEN 'click' THEN 'followed' WHEN 'purchase' THEN 'bought' ELSE event_type END AS label, count(*) AS n FROM events GROUP BY 1")
def vocabulary_labels(spark, sf):
    """Labels by a map; what the map lacks is its own label."""
    names = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    return table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).select("event_type", F.coalesce(F.try_element_at(names, D("event_type")), D("event_type")).alias("label"), "n")


@query(f"{BENCH_CTE}, j AS (SELECT symbol, date, close/lag(close, 125) {W} - 1 AS s, bench/lag(bench, 125) {W} - 1 AS m FROM bars JOIN bench USING (date)) SELECT symbol, date, round((1+s)/(1+m), 8) AS rs_raw FROM j WHERE s IS NOT NULL", on_bars=True)
def rs_raw_125(spark, sf):
    b = bars(spark, sf)
    j = b.join(benchmark(b), "date")
    s, m = (ratio(D(c), back(D(c), 125)) - 1 for c in ("close", "bench"))
    return j.select("symbol", "date", r(ratio(1 + s, 1 + m)).alias("rs_raw")).filter("rs_raw is not null")


@query(
    f"""{ATR_CTE}, u AS (SELECT *, lag(close) {W} AS before, row_number() {W} AS n, avg(volume) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING) AS usual, lag(close) {W}/lag(close, 64) {W}-1 AS quarter FROM atr),
    g(config, gap, vol, most) AS (VALUES ('A', 1.5, 1.5, NULL), ('B', 2.0, 1.5, NULL), ('C', 1.5, 1.5, 0.10)) SELECT config, symbol, date FROM u, g WHERE n > 60 AND (open/before-1)*100 >= gap AND volume >= vol*usual AND close > open AND (most IS NULL OR quarter <= most)""",
    on_bars=True,
)
def episodic_neglect(spark, sf):
    """Gap signals under three configurations; the third asks for neglect, a quarter without much rise."""
    w = by_symbol()
    x = bars(spark, sf).withColumns({"before": back(D("close")), "n": F.row_number().over(w), "usual": F.avg("volume").over(w.rowsBetween(-50, -1)), "quarter": ratio(back(D("close")), back(D("close"), 64)) - 1})
    grid = F.array(*[F.struct(F.lit(c).alias("config"), F.lit(g).alias("gap"), F.lit(v).alias("vol"), F.lit(m).cast("double").alias("most")) for c, g, v, m in (("A", 1.5, 1.5, None), ("B", 2.0, 1.5, None), ("C", 1.5, 1.5, 0.10))])
    e = x.filter((D("n") > 60) & (D("close") > D("open"))).withColumn("g", F.explode(grid))
    fits = ((ratio(D("open"), D("before")) - 1) * 100 >= D("g.gap")) & (D("volume") >= D("g.vol") * D("usual")) & (D("g.most").isNull() | (D("quarter") <= D("g.most")))
    return e.filter(fits).select("g.config", "symbol", "date")


@query(
    """wk AS (SELECT symbol, date + CAST((12 - isodow(date)) % 7 AS INTEGER) AS week, arg_max(close, date) AS c, max(high) AS h FROM bars GROUP BY 1, 2),
    w AS (SELECT *, sum(round(c*10000)::bigint) OVER (PARTITION BY symbol ORDER BY week ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)/300000.0::double AS ma, count(*) OVER (PARTITION BY symbol ORDER BY week ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS n, max(h) OVER (PARTITION BY symbol ORDER BY week ROWS BETWEEN 51 PRECEDING AND CURRENT ROW) AS top FROM wk),
    x AS (SELECT *, ma/lag(ma, 8) OVER (PARTITION BY symbol ORDER BY week)-1 AS slope, c/lag(c, 13) OVER (PARTITION BY symbol ORDER BY week)-1 AS q1, c/lag(c, 26) OVER (PARTITION BY symbol ORDER BY week)-1 AS q2 FROM w)
    SELECT symbol, week FROM x WHERE n = 30 AND abs(slope) <= 0.03 AND (top-c)/top <= 0.25 AND q1 > q2""",
    on_bars=True,
)
def anticipation_weekly(spark, sf):
    """Weeks of a flat base near its high whose strength improves."""
    wk = ind.weekly(bars(spark, sf))
    o = Window.partitionBy("symbol").orderBy("week")
    w = wk.withColumns({"ma": price_sum(D("close"), o.rowsBetween(-29, 0)) / F.lit(300_000.0), "n": F.count(F.lit(1)).over(o.rowsBetween(-29, 0)), "top": F.max("high").over(o.rowsBetween(-51, 0))})
    x = w.withColumns({"slope": ratio(D("ma"), F.lag("ma", 8).over(o)) - 1, "q1": ratio(D("close"), F.lag("close", 13).over(o)) - 1, "q2": ratio(D("close"), F.lag("close", 26).over(o)) - 1})
    return x.filter((D("n") == 30) & (F.abs("slope") <= 0.03) & (ratio(D("top") - D("close"), D("top")) <= 0.25) & (D("q1") > D("q2"))).select("symbol", "week")


@query(f"{FIG_SQL}, s AS (SELECT id, ({V1})::double AS f, CASE WHEN id % 3 = 0 THEN 0.7*(id % 101)/100.0+0.3*(id % 2) ELSE 0 END::double AS t, (id % 7)/6.0::double AS c FROM f), x AS (SELECT id, round(0.5*f+0.35*t+0.15*c, 8) AS composite FROM s) SELECT id, composite, composite >= 0.6 AS listed FROM x")
def shortlist_composite(spark, sf):
    k = D("id")
    technical = F.when(k % 3 == 0, 0.7 * (k % 101) / 100.0 + 0.3 * (k % 2)).otherwise(0.0)
    x = figures(spark, sf).select("id", r(0.5 * v1() + 0.35 * technical + 0.15 * (k % 7 / 6.0)).alias("composite"))
    return x.withColumn("listed", D("composite") >= 0.6)


@query(f"{FIG_SQL}, d AS (SELECT id, [{{'k': 'earnings', 's': {EARN}}}, {{'k': 'strength', 's': {STRONG}}}, {{'k': 'valuation', 's': {SANE}}}, {{'k': 'smart_money', 's': {SMART}}}] AS a FROM f), u AS (SELECT id, unnest(a) AS x FROM d), n AS (SELECT id, x.k AS k, row_number() OVER (PARTITION BY id ORDER BY round(x.s, 8) DESC, x.k) AS n FROM u WHERE x.s IS NOT NULL) SELECT id, string_agg(k, ',' ORDER BY n) AS best FROM n WHERE n <= 2 GROUP BY 1")
def top_dimensions(spark, sf):
    """The two best live dimensions of each row, without leaving the row."""
    names = ("earnings", "strength", "valuation", "smart_money")
    d = dims()
    live = F.filter(F.array(*[F.struct((-F.round(d[n], 8)).alias("s"), F.lit(n).alias("k")) for n in names]), lambda x: x["s"].isNotNull())
    best = F.transform(F.slice(F.array_sort(live), 1, 2), lambda x: x["k"])
    return figures(spark, sf).select("id", F.array_join(best, ",").alias("best")).filter("best <> ''")


@query("WITH a AS (SELECT n_nationkey AS k, n_name AS name, 1 AS p FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT n_nationkey, 'second ' || n_name, 2 FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT r_regionkey, 'third ' || r_name, 3 FROM region), n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY p) AS n FROM a) SELECT k, name, p FROM n WHERE n = 1")
def universe_union(spark, sf):
    """Three lists in order of priority; a key keeps its first."""
    from tapeloom.sources.files import preferred

    n, g = table(spark, sf, "nation"), table(spark, sf, "region")
    one = n.filter("n_nationkey % 2 = 0").select(D("n_nationkey").alias("k"), D("n_name").alias("name"), F.lit(1).alias("p"))
    two = n.filter("n_nationkey % 3 = 0").select(D("n_nationkey").alias("k"), F.concat(F.lit("second "), "n_name").alias("name"), F.lit(2).alias("p"))
    three = g.select(D("r_regionkey").alias("k"), F.concat(F.lit("third "), "r_name").alias("name"), F.lit(3).alias("p"))
    return preferred(one.unionByName(two).unionByName(three), "k", D("p"), "name")


@query("SELECT event_type, count(*) AS n, sum((props->>'$.k')::bigint)::bigint AS total, count_if(props IS NULL)::bigint AS without FROM events GROUP BY 1")
def json_fields(spark, sf):
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("total"), F.count_if(D("props").isNull()).alias("without"))


@query(f"{FIG_SQL} SELECT id, CASE WHEN sales < 20 THEN false ELSE profit > 0 END AS enters, CASE WHEN moved IS NULL THEN true ELSE NOT (moved < 1) END AS heat_open FROM f")
def entry_gates(spark, sf):
    """A gate that a missing score passes: only a score below it closes it."""
    f = figures(spark, sf)
    return f.select("id", (~F.coalesce(D("sales") < 20, F.lit(False)) & (D("profit") > 0)).alias("enters"), (~F.coalesce(D("moved") < 1, F.lit(False))).alias("heat_open"))


@query(f"c AS (SELECT symbol, date, volume/nullif({mean_sql('volume', 50)}, 0) AS s FROM bars), n AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY s DESC, symbol) AS place FROM c WHERE s IS NOT NULL) SELECT date, symbol, place FROM n WHERE place <= 3", on_bars=True)
def entry_queue(spark, sf):
    """The three strongest candidates of each day."""
    c = ind.with_volume_average(bars(spark, sf), 50, 50).withColumn("s", D("volume") / F.nullif("avg_vol", F.lit(0.0))).filter("s is not null")
    place = F.row_number().over(Window.partitionBy("date").orderBy(F.desc("s"), "symbol"))
    return c.withColumn("place", place).filter("place <= 3").select("date", "symbol", "place")


@query("""WITH v AS (SELECT event_id, user_id, ts::date AS day FROM events WHERE event_type = 'signup'), b AS (SELECT user_id, ts::date AS day, arg_min(value, (ts, event_id)) AS open FROM events WHERE event_type = 'view' GROUP BY 1, 2) SELECT v.event_id, min(b.day) AS fill_day, arg_min(b.open, b.day) AS fill_price FROM v LEFT JOIN b ON v.user_id = b.user_id AND b.day > v.day GROUP BY 1""")
def first_bar_after(spark, sf):
    """Fill of a verdict: the open of the first bar after its day."""
    e = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    v = e.filter("event_type = 'signup'").select("event_id", "user_id", "day")
    b = e.filter("event_type = 'view'").groupBy("user_id", "day").agg(F.struct("day", F.min_by("value", F.struct("ts", "event_id")).alias("open")).alias("bar"))
    j = aj.asof(v, b, ["user_id"], "day", "bar", exact=False, forward=True)
    return j.select("event_id", D("bar.day").alias("fill_day"), D("bar.open").alias("fill_price"))


@query("""WITH t AS (SELECT user_id, event_type, value, event_id FROM events), s AS (SELECT user_id, sum(CASE WHEN event_type = 'purchase' THEN value END) AS realised, sum(CASE WHEN event_type = 'click' THEN 100-value END) AS unrealised, count_if(event_type = 'signup')::bigint AS pending FROM t GROUP BY 1) SELECT user_id, round(coalesce(realised, 0), 4) AS realised, round(coalesce(unrealised, 0), 4) AS unrealised, pending FROM s""")
def paper_summary(spark, sf):
    s = table(spark, sf, "events").groupBy("user_id").agg(F.sum(F.when(D("event_type") == "purchase", D("value"))).alias("a"), F.sum(F.when(D("event_type") == "click", 100 - D("value"))).alias("b"), F.count_if(D("event_type") == "signup").alias("pending"))
    return s.select("user_id", F.round(F.coalesce("a", F.lit(0.0)), 4).alias("realised"), F.round(F.coalesce("b", F.lit(0.0)), 4).alias("unrealised"), "pending")


@query("l AS (SELECT symbol, max(date) AS last FROM bars GROUP BY 1), m AS (SELECT max(date) AS today FROM bars), x AS (SELECT count(*) AS symbols, count_if(date_diff('day', last, today) > 5)::bigint AS stale, min(date_diff('day', last, today)) AS freshest FROM l, m) SELECT symbols, stale, stale*1.0::double/symbols > 0.2 AS many_stale, freshest > 5 AS benchmark_old FROM x", on_bars=True)
def health_flags(spark, sf):
    last = bars(spark, sf).groupBy("symbol").agg(F.max("date").alias("last"))
    age = F.date_diff(last.agg(F.max("last")).scalar(), D("last"))
    x = last.agg(F.count(F.lit(1)).alias("symbols"), F.count_if(age > 5).alias("stale"), F.min(age).alias("freshest"))
    return x.select("symbols", "stale", (D("stale") / D("symbols") > 0.2).alias("many_stale"), (D("freshest") > 5).alias("benchmark_old"))


@query(
    TAGS + """, zz AS (SELECT b.symbol, arg_min(b.close, b.date) AS a, max(b.high) AS peak, min(CASE WHEN t.tag = 'CONFIRMED' THEN b.date END) AS seen, arg_min(CASE WHEN t.tag = 'CONFIRMED' THEN b.close END, CASE WHEN t.tag = 'CONFIRMED' THEN b.date END) AS px, count_if(t.tag = 'EXTENDED') AS ext, count_if(t.tag = 'ANTICIPATION') AS ant
    FROM bars b JOIN tagged t USING (symbol, date) WHERE b.date >= DATE '1998-01-01' GROUP BY 1)
    SELECT symbol, seen, CASE WHEN seen IS NOT NULL AND (peak-px)/nullif(peak-a, 0) >= 0.5 THEN 'CAUGHT EARLY' WHEN seen IS NOT NULL AND (peak-px)/nullif(peak-a, 0) >= 0.15 THEN 'CAUGHT' WHEN seen IS NOT NULL THEN 'LATE' WHEN ext > 0 THEN 'EXTENDED' WHEN ant > 0 THEN 'ANTICIPATION' ELSE 'MISSED' END AS label FROM zz""",
    on_bars=True,
)
def capture_labels(spark, sf):
    """How much of a symbol's rise was left when it was first confirmed."""
    b = bars(spark, sf)
    t = tags(b).select("symbol", "date", "tag").join(b.select("symbol", "date", D("close").alias("c"), "high"), ["symbol", "date"]).filter("date >= DATE'1998-01-01'")
    day = F.when(D("tag") == "CONFIRMED", D("date"))
    z = t.groupBy("symbol").agg(F.min_by("c", "date").alias("a"), F.max("high").alias("peak"), F.min(day).alias("seen"), F.min_by("c", day).alias("px"), F.count_if(D("tag") == "EXTENDED").alias("ext"), F.count_if(D("tag") == "ANTICIPATION").alias("ant"))
    left, seen = (D("peak") - D("px")) / F.nullif(D("peak") - D("a"), F.lit(0.0)), D("seen").isNotNull()
    label = F.when(seen & (left >= 0.5), "CAUGHT EARLY").when(seen & (left >= 0.15), "CAUGHT").when(seen, "LATE").when(D("ext") > 0, "EXTENDED").when(D("ant") > 0, "ANTICIPATION").otherwise("MISSED")
    return z.select("symbol", "seen", label.alias("label"))


@query(f"{FIG_SQL} SELECT id, round((0.40*coalesce(CASE WHEN id % 4 <> 0 THEN (id % 100)/100.0 END, CASE WHEN id % 8 <> 0 THEN least(greatest(((id % 17)/10.0-0.8)/0.7, 0.0), 1.0) END, 0.5)+0.30*((id % 9)/8.0)+0.15*(CASE id % 5 WHEN 2 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.0 END)+0.15*(CASE WHEN id % 6 = 0 THEN 1.0 ELSE 0.0 END))::double, 8) AS score FROM f")
def rs_and_stage_scores(spark, sf):
    k = D("id")
    s = sc.rs_and_stage(F.when(k % 4 != 0, (k % 100).cast("double")), F.when(k % 8 != 0, k % 17 / 10.0), k % 9, k % 5, k % 6 == 0)
    return figures(spark, sf).select("id", r(s).alias("score"))


ALERTS = "WITH a AS (SELECT event_id AS id, ['ACTIONABLE', 'RAN AWAY', 'FADED', 'VETOED'][event_id % 4 + 1] AS status, CASE WHEN event_id % 7 = 0 THEN 'EPISODIC PIVOT' ELSE 'BUY CANDIDATE' END AS kind, CASE WHEN event_id % 3 = 0 THEN 'VALIDATED' WHEN event_id % 5 = 0 THEN 'AWAITING TRIGGER' ELSE 'NO VCP BASE' END AS trigger, value AS conv FROM events), d AS (SELECT *, CASE WHEN status = 'VETOED' THEN 'veto' WHEN kind = 'EPISODIC PIVOT' AND status <> 'FADED' THEN 'ep' WHEN status = 'FADED' THEN 'mute' WHEN status = 'RAN AWAY' THEN 'warn' WHEN trigger = 'VALIDATED' THEN 'act' WHEN trigger = 'AWAITING TRIGGER' THEN 'watch' ELSE 'weak' END AS action, CASE WHEN conv < 50 THEN '<50' WHEN conv < 60 THEN '50-60' WHEN conv < 70 THEN '60-70' WHEN conv IS NOT NULL THEN '70+' END AS band FROM a)"


def alerts(spark, sf):
    k = D("event_id")
    a = table(spark, sf, "events").select(k.alias("id"), F.get(F.array(*[F.lit(x) for x in ("ACTIONABLE", "RAN AWAY", "FADED", "VETOED")]), (k % 4).cast("int")).alias("status"), F.when(k % 7 == 0, "EPISODIC PIVOT").otherwise("BUY CANDIDATE").alias("kind"), sc.entry_status(k % 3 == 0, k % 5 == 0).alias("trigger"), D("value").alias("conv"))
    return a.withColumns({"action": sc.action(D("status"), D("kind"), D("trigger")), "band": sc.conviction_band(D("conv"))})


@query(f"{ALERTS} SELECT id, status, kind, trigger, action, band FROM d")
def action_labels(spark, sf):
    return alerts(spark, sf).drop("conv")


@query(f"{ALERTS} SELECT id, action FROM d ORDER BY CASE status WHEN 'ACTIONABLE' THEN 0 WHEN 'RAN AWAY' THEN 1 WHEN 'FADED' THEN 2 ELSE 3 END, CASE WHEN kind = 'EPISODIC PIVOT' OR trigger = 'VALIDATED' THEN 0 WHEN trigger = 'AWAITING TRIGGER' THEN 1 ELSE 2 END, conv DESC NULLS LAST, id LIMIT 25")
def actionable_top25(spark, sf):
    """The first 25 alerts by status, trigger and conviction."""
    status = F.when(D("status") == "ACTIONABLE", 0).when(D("status") == "RAN AWAY", 1).when(D("status") == "FADED", 2).otherwise(3)
    trigger = F.when((D("kind") == "EPISODIC PIVOT") | (D("trigger") == "VALIDATED"), 0).when(D("trigger") == "AWAITING TRIGGER", 1).otherwise(2)
    return alerts(spark, sf).orderBy(status, trigger, D("conv").desc_nulls_last(), "id").limit(25).select("id", "action")


@query(
    f"""{HEAD}, x AS (SELECT *, list_filter({lst(v.THEMES)}, lambda s: contains(lower(title), lower(s))) AS th, list_filter({lst(v.EVENTS)}, lambda s: contains(lower(title), lower(s))) AS ev, len(list_filter({lst(v.RED_FLAGS)}, lambda s: contains(lower(title), lower(s)))) AS red,
    len(list_filter({lst(v.TRUSTED)}, lambda s: contains(lower(source), s))) > 0 AND NOT {ROUND} AS ok, CASE WHEN {ROUND} THEN 0 ELSE sign({hits(v.UP)} - {hits(v.DOWN)})::int END AS mood FROM h),
    g AS (SELECT name, count_if(ok)::bigint AS items, sum(red)::bigint AS red_flags, round(avg(CASE WHEN ok THEN mood END), 2) AS mood, max(CASE WHEN ok AND len(th) > 0 THEN date END) AS latest, len(list_distinct(flatten(list(th) FILTER (ok)))) AS themes, len(list_distinct(flatten(list(ev) FILTER (ok)))) AS events FROM x GROUP BY 1),
    b AS (SELECT *, CASE WHEN themes > 0 THEN 0.5*least(themes/3.0, 1.0)+0.3*greatest(1-date_diff('day', latest, DATE '2024-06-30')/60.0, 0.0)+0.2*least(items/10.0, 1.0) ELSE 0 END AS base FROM g),
    c AS (SELECT *, least(0.5*least(events/3.0, 1.0)+0.5*base+CASE WHEN items >= 5 THEN 0.1 ELSE 0 END, 1.0) AS cat FROM b)
    SELECT name, items, red_flags, round((CASE WHEN mood < -0.3 THEN greatest(cat-0.2, 0.0) ELSE cat END)::double, 6) AS catalyst, round((CASE WHEN themes > 0 THEN least(0.3+0.35*least(themes, 2), 1.0) ELSE 0.3 END)::double, 6) AS theme FROM c"""
)
def news_enrichment(spark, sf):
    """Catalyst and theme scores of a company from trusted headlines that are no roundups; red flags from all."""
    t = D("title")
    x = headlines(spark, sf).withColumns({"ok": tx.is_trusted(D("source")) & ~tx.is_roundup(t), "mood": tx.sentiment(t), "th": tx.keyword_hits(t, v.THEMES), "ev": tx.keyword_hits(t, v.EVENTS), "red": F.size(tx.keyword_hits(t, v.RED_FLAGS))})
    among = lambda c: F.size(F.array_distinct(F.flatten(F.collect_set(F.when(D("ok"), D(c))))))
    latest = F.max(F.when(D("ok") & (F.size("th") > 0), D("date")))
    g = x.groupBy("name").agg(F.count_if("ok").alias("items"), F.sum("red").alias("red_flags"), F.round(F.avg(F.when(D("ok"), D("mood"))), 2).alias("mood"), latest.alias("latest"), among("th").alias("themes"), among("ev").alias("events"))
    base = tx.catalyst(D("themes"), D("items"), F.date_diff(F.lit("2024-06-30").cast("date"), "latest"))
    return g.select("name", "items", "red_flags", F.round(sc.catalyst_with_events(base, D("events"), D("items"), D("mood")), 6).alias("catalyst"), F.round(sc.theme_tailwind(D("themes")), 6).alias("theme"))
