"""Indicators over bars (symbol, date, open, high, low, close, volume): one shuffle by symbol serves them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeloom.config import Gap, Stage, Technical
from tapeloom.functions.windows import back, by_symbol, last_bars, percentile, price_sum, ratio, roll_max, roll_mean, roll_min, roll_price_mean

from .asof import asof


def with_averages(bars: DataFrame, lengths=(50, 150, 200)) -> DataFrame:
    return bars.withColumns({f"sma_{n}": roll_price_mean(F.col("close"), n) for n in lengths})


def true_range() -> Column:
    before = back(F.col("close"))
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def with_atr(bars: DataFrame, n: int = 14) -> DataFrame:
    """atr: plain mean of the true ranges of n bars."""
    return bars.withColumn("__tr", true_range()).withColumn("atr", roll_mean(F.col("__tr"), n)).drop("__tr")


def with_extremes(bars: DataFrame, n: int = 252, least: int = 20) -> DataFrame:
    return bars.withColumns({"low_52w": roll_min(F.col("low"), n, least), "high_52w": roll_max(F.col("high"), n, least)})


def with_volume_average(bars: DataFrame, n: int = 50, least: int = 10) -> DataFrame:
    return bars.withColumn("avg_vol", roll_mean(F.col("volume").cast("double"), n, least))


def with_week_end(bars: DataFrame) -> DataFrame:
    """is_week_end: last bar of its ISO week; the last bar of the series is one."""
    week = F.extract(F.lit("YEAROFWEEK"), F.col("date")) * 100 + F.weekofyear("date")
    return bars.withColumn("is_week_end", ~week.eqNullSafe(F.lead(week).over(by_symbol())))


def week_label() -> Column:
    """The Friday on or after the date."""
    return F.next_day(F.date_sub("date", 1), "FRI")


def weekly(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol", week_label().alias("week")).agg(F.max_by("close", "date").alias("close"), F.max("high").alias("high"), F.min("low").alias("low"))


def monthly(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol", F.last_day("date").alias("month")).agg(F.max_by("close", "date").alias("close"))


def with_template(bars: DataFrame, t: Technical = Technical(), shift: int = 20, least: int = 20) -> DataFrame:
    """Eight trend checks and whether all hold; shift: bars back of the long average's comparison."""
    out = with_extremes(with_averages(bars, (t.short, t.middle, t.long)), t.year, least)
    s, m, g = (F.col(f"sma_{n}") for n in (t.short, t.middle, t.long))
    c = F.col("close")
    out = out.withColumn("long_before", back(g, shift))
    checks = F.array(c > s, c > m, c > g, m > g, (s > m) & (s > g), g > F.col("long_before"), c >= t.off_low * F.col("low_52w"), c >= t.off_high * F.col("high_52w"))
    passed = F.size(F.filter(checks, lambda x: x))
    return out.withColumn("checks_passed", passed).withColumn("template", passed == 8)


def last_bar(bars: DataFrame) -> DataFrame:
    return bars.withColumn("__n", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))).filter("__n = 1").drop("__n")


def gaps(bars: DataFrame, g: Gap = Gap(), n: int = 50) -> DataFrame:
    """Bars that open on a gap with volume and hold it, with the stop of such an entry."""
    out = with_atr(bars).withColumns({"before": back(F.col("close")), "n": F.row_number().over(by_symbol()), "usual": F.avg(F.col("volume")).over(by_symbol().rowsBetween(-n, -1)), "n_usual": F.count("volume").over(by_symbol().rowsBetween(-n, -1))})
    gap = (ratio(F.col("open"), F.col("before")) - 1) * 100
    fits = (F.col("n") > g.min_bars) & (F.col("n_usual") >= 10) & (F.col("close") >= g.price_min) & (F.col("usual") * F.col("close") >= g.value_min)
    fits = fits & (gap >= g.gap_pct) & (F.col("volume") >= g.volume_times * F.col("usual")) & (F.col("close") > F.col("open")) & (F.col("close") >= F.col("before") * (1 + g.gap_pct / 100))
    stop = F.least(F.col("low"), F.col("close") - g.stop_atr * F.col("atr"))
    return out.filter(fits).select("symbol", "date", gap.alias("gap_pct"), ratio(F.col("volume"), F.col("usual")).alias("volume_times"), stop.alias("stop"))


def strength(bars: DataFrame, bench: DataFrame, spans=(63, 126, 252)) -> DataFrame:
    """Adds the ratio of a symbol's return to the benchmark's over bars of the joined series, the blend and whether it
    improves. The benchmark has a row a trading day and is broadcast, so that bars keep their partitioning by symbol."""
    both = bars.join(F.broadcast(bench), "date")
    for n in spans:
        both = both.withColumn(f"rs_{n}", ratio(ratio(F.col("close"), back(F.col("close"), n)), ratio(F.col("bench"), back(F.col("bench"), n))))
    a, b, c = (F.col(f"rs_{n}") for n in spans)
    return both.withColumn("rs_blend", 0.6 * b + 0.4 * c).withColumn("improving", a > b)


def stages(bars: DataFrame, s: Stage = Stage()) -> DataFrame:
    """Adds the stage, 1 to 4, of each bar: its close closes the running week, the earlier weeks are complete. Bars before
    enough weeks go.

    Weeks are numbered; sums over completed weeks come from the weekly closes, joined to the bars of the next week.
    """
    w = Window.partitionBy("symbol").orderBy("week")
    k, n = s.ma_weeks, s.slope_weeks
    weeks = weekly(bars).select("symbol", "week", "close").withColumns({"done": F.row_number().over(w) - 1, "rest": price_sum(F.col("close"), w.rowsBetween(-(k - 1), -1)) / F.lit(10_000.0), "then": price_sum(F.col("close"), w.rowsBetween(-(n + k - 1), -n)) / F.lit(10_000.0)})
    t = bars.withColumns({"week": week_label(), "lo": F.min("low").over(last_bars(s.base_bars)), "hi": F.max("high").over(last_bars(s.base_bars))}).join(weeks.drop("close"), ["symbol", "week"])
    ma, old, c = (F.col("rest") + F.col("close")) / k, F.col("then") / k, F.col("close")
    slope = ratio(ma, old) - 1
    place = F.when(F.col("hi") > F.col("lo"), (c - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.5)
    stage = F.when((c > ma) & (slope > s.band), 2).when((c < ma) & (slope < -s.band), 4).when(place < 0.5, 1).otherwise(3)
    return t.filter(F.col("done") + 1 >= s.min_weeks).select(*bars.columns, ma.alias("ma"), slope.alias("slope"), place.alias("place"), stage.alias("stage"))


def base(bars: DataFrame, n: int = 252) -> DataFrame:
    """Last bar's base: the first highest high of the last n bars, the lowest low from there, and depths from it."""
    tail = bars.withColumn("__n", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))).filter(F.col("__n") <= n)
    top = tail.groupBy("symbol").agg(F.max(F.struct("high", "__n")).alias("top"), F.min_by("close", "__n").alias("close"))
    low = tail.join(top, "symbol").filter(F.col("__n") <= F.col("top.__n")).groupBy("symbol").agg(F.first("top.high").alias("base_high"), F.min("low").alias("base_low"), F.first(top["close"]).alias("close"))
    return low.select("symbol", "base_high", "base_low", (ratio(F.col("base_high") - F.col("base_low"), F.col("base_high")) * 100).alias("depth_pct"), (ratio(F.col("base_high") - F.col("close"), F.col("base_high")) * 100).alias("below_high_pct"))


def with_base(bars: DataFrame, n: int = 252) -> DataFrame:
    """Adds top, the first highest high of the last n bars, and depth_pct, how far the lowest low since lies below it."""
    w = last_bars(n)
    rows = bars.withColumn("__k", F.row_number().over(by_symbol()))
    rows = rows.withColumn("__top", F.max(F.struct("high", (-F.col("__k")).alias("k"))).over(w)).withColumn("__lows", F.collect_list("low").over(w))
    since = F.col("__k") + F.col("__top")["k"] + 1  # bars from the top up to this one
    low = F.array_min(F.slice("__lows", -since, since))
    return rows.withColumns({"top": F.col("__top")["high"], "depth_pct": ratio(F.col("__top")["high"] - low, F.col("__top")["high"]) * 100}).drop("__k", "__top", "__lows")


def extended(bars: DataFrame, s: Stage = Stage()) -> DataFrame:
    out = with_atr(with_averages(bars, (50,)))
    over = (ratio(F.col("close"), F.col("sma_50")) - 1) * 100
    atrs = F.when(F.col("atr") > 0, (F.col("close") - F.col("sma_50")) / F.col("atr"))
    return out.withColumns({"over_pct": over, "over_atr": atrs}).withColumn("extended", F.coalesce((F.col("over_pct") > s.extended_pct) | (F.col("over_atr") > s.extended_atr), F.lit(False)))


def breadth(bars: DataFrame, n: int = 200, least: int = 100) -> DataFrame:
    """Share of symbols above their n-bar average on each date with enough symbols."""
    a = with_averages(bars, (n,)).filter(F.col(f"sma_{n}").isNotNull())
    return a.groupBy("date").agg(F.count(F.lit(1)).alias("symbols"), F.count_if(F.col("close") > F.col(f"sma_{n}")).alias("above")).filter(F.col("symbols") >= least).withColumn("breadth_pct", 100.0 * F.col("above") / F.col("symbols"))


def heat(bars: DataFrame, groups: DataFrame, months: int = 6, stocks: int = 3, industries: int = 5) -> DataFrame:
    """Per month and industry: median strength against the mean of all, ranked among the industries of the month.

    Months without a bar count: the months of a symbol are laid out without holes before looking back.
    """
    m = monthly(bars)
    span = m.groupBy("symbol").agg(F.min("month").alias("a"), F.max("month").alias("b"))
    grid = span.select("symbol", F.explode(F.sequence(F.trunc("a", "month"), F.trunc("b", "month"), F.expr("interval 1 month"))).alias("d")).select("symbol", F.last_day("d").alias("month"))
    w = Window.partitionBy("symbol").orderBy("month")
    ret = grid.join(m, ["symbol", "month"], "left").withColumn("ret", ratio(F.col("close"), F.lag("close", months).over(w))).filter("ret is not null")
    market = ret.groupBy("month").agg(F.avg("ret").alias("market"))
    per = ret.join(market, "month").join(groups, "symbol").groupBy("month", "industry").agg(F.median(ratio(F.col("ret"), F.col("market"))).alias("rs"), F.count(F.lit(1)).alias("stocks")).filter(F.col("stocks") >= stocks)
    enough = per.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("month"))).filter(F.col("n") >= industries)
    return enough.withColumn("heat", percentile(F.col("rs"), "month")).drop("n")


def completed_week(bars: DataFrame, n: int = 150) -> DataFrame:
    """(symbol, week_close, week_sma): the last bar of each symbol's last completed week, and its n-bar average. A week is
    complete when a bar of a later week is there or its Friday is."""
    newest = F.max("date").over(Window.partitionBy("symbol"))
    now = F.next_day(F.date_sub(newest, 1), "FRI")
    out = with_averages(bars, (n,)).withColumn("__done", (week_label() < now) | (F.col("date") == week_label()))
    return last_bar(out.filter("__done")).select("symbol", F.col("close").alias("week_close"), F.col(f"sma_{n}").alias("week_sma"))


def market_scale(dates: DataFrame, snapshots: DataFrame, bench: DataFrame, max_age: int = 7, least: int = 100, half_below: float = 50.0, n: int = 150) -> DataFrame:
    """(date, scale, rule) of each date: half the risk where the last breadth snapshot (date, breadth_pct, symbols) is below
    the bound; where it is older than max_age days or of fewer than least symbols, half where the benchmark (date, bench)
    stands below its n-bar average; full risk where neither is known. A row a trading day: one small window."""
    k = F.lit(1).alias("k")
    snap = snapshots.select(k, "date", F.struct("date", F.round("breadth_pct", 1).alias("pct"), "symbols").alias("snap"))
    w = Window.partitionBy("k").orderBy("date").rowsBetween(-(n - 1), 0)
    average = F.when(F.count("bench").over(w) >= n, price_sum(F.col("bench"), w) / F.lit(10_000.0 * n))
    below = bench.select(k, "date", "bench").withColumn("below", F.col("bench") < average).filter("below is not null")
    j = asof(asof(dates.select(k, "date"), snap, ["k"], "date", "snap"), below, ["k"], "date", "below")
    fresh = (F.date_diff("date", F.col("snap.date")) <= max_age) & (F.col("snap.symbols") >= least) & F.col("snap.pct").isNotNull()
    fresh = F.coalesce(fresh, F.lit(False))
    half = F.when(fresh, F.col("snap.pct") < half_below).otherwise(F.coalesce("below", F.lit(False)))
    rule = F.when(fresh, "breadth").when(F.col("below").isNotNull(), "benchmark").otherwise("none")
    return j.select("date", F.when(half, 0.5).otherwise(1.0).alias("scale"), rule.alias("rule"))
