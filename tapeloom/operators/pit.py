"""Point-in-time fundamentals: what was known of a company when, and the score that followed from it.

Sections are long tables (symbol, period_end, known_as_of, metric, value). They are pivoted once to a row a period; the
dimensions of a period come from it and earlier rows, by windows; scores change at the days on which something became
known, and are carried to the bars by as-of joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeloom.functions import scoring as sc
from tapeloom.functions.windows import clip01

from .asof import asof

#: Weights of the dimensions.
WEIGHTS = {"earnings": 20.0, "smart_money": 12.0, "strength": 10.0, "governance": 8.0, "valuation": 5.0}


def wide(section: DataFrame, metrics: dict[str, str]) -> DataFrame:
    """A row a period with the named metrics (label -> column), numbered from the first period as n."""
    cols = [F.max(F.when(F.col("metric") == label, F.col("value"))).alias(name) for label, name in metrics.items()]
    out = section.groupBy("symbol", "period_end", "known_as_of").agg(*cols)
    return out.withColumn("n", F.row_number().over(_periods()))


def _periods():
    return Window.partitionBy("symbol").orderBy("known_as_of", "period_end")


def _ago(c: str, k: int) -> Column:
    return F.lag(c, k).over(_periods())


def _total(c: str, first: int, last: int) -> Column:
    """Sum over periods first to last back; missing values count nothing."""
    return F.coalesce(F.sum(c).over(_periods().rowsBetween(-first, -last)), F.lit(0.0))


def quarters(q: DataFrame) -> DataFrame:
    """(symbol, known_as_of, earnings, eps_ttm, has_eps, growth_pct) at each quarter's knowledge."""
    w = wide(q, {"Net Profit": "np", "OPM %": "opm", "EPS in Rs": "eps"})
    ttm, prior = _total("np", 3, 0), _total("np", 7, 4)
    growth = F.when((F.col("n") >= 8) & (prior != 0), (ttm - prior) / F.abs(prior))
    w = w.withColumns({"ago": _ago("np", 4), "opm_ago": _ago("opm", 4), "g": growth, "eps_ttm": _total("eps", 3, 0)})
    pace = F.when(F.col("g") > 0.15, 1.0).when(F.col("g") > 0, 0.7).when(F.col("g").isNotNull(), 0.3).otherwise(0.5)
    level = F.coalesce(clip01(F.col("g") / 0.30), F.lit(0.5))
    score = 0.45 * sc.quarter(F.col("np"), F.col("ago"), F.coalesce(F.col("opm") > F.col("opm_ago"), F.lit(False))) + 0.30 * pace + 0.25 * level
    return w.select("symbol", "known_as_of", F.when(F.col("n") >= 5, F.round(score, 4)).alias("earnings"), F.when(F.col("n") >= 4, F.col("eps_ttm")).alias("eps_ttm"), (F.col("g") * 100).alias("growth_pct"))


def balances(bs: DataFrame, cf: DataFrame, financial: DataFrame) -> DataFrame:
    """(symbol, known_as_of, strength); financial: symbols that lend."""
    w = wide(bs, {"Borrowings": "debt", "Equity Capital": "eq", "Reserves": "res"})
    w = w.withColumns({"debt_ago": _ago("debt", 3), "eq_ago": _ago("eq", 3), "worth": F.coalesce("eq", F.lit(0.0)) + F.coalesce("res", F.lit(0.0))})
    cash = wide(cf, {"Cash from Operating Activity": "cfo"}).select("symbol", "known_as_of", "cfo")
    w = asof(w, cash, ["symbol"], "known_as_of", "cfo").join(F.broadcast(financial.select("symbol", F.lit(True).alias("fin"))), "symbol", "left")
    de = F.when(F.col("worth") > 0, F.col("debt") / F.col("worth"))
    s = sc.strength(F.coalesce("debt", F.lit(0.0)), F.col("debt_ago"), de, F.col("cfo"), F.col("eq"), F.col("eq_ago"), F.coalesce("fin", F.lit(False)))
    return w.select("symbol", "known_as_of", F.round(s, 4).alias("strength"))


def holdings(sh: DataFrame) -> DataFrame:
    """(symbol, known_as_of, smart_money, governance)."""
    w = wide(sh, {"FIIs": "fii", "DIIs": "dii", "Promoters": "own"})
    change = sum((F.coalesce(F.col(c) - _ago(c, 4), F.lit(0.0)) for c in ("fii", "dii")), F.lit(0.0))
    drop = _ago("own", 4) - F.col("own")
    rule = F.when(drop > 2, 0.4).when(drop < -1, 0.85).when(drop.isNotNull(), 0.7)
    w = w.withColumns({"change": change, "rule": rule})
    return w.select("symbol", "known_as_of", F.when(F.col("n") >= 5, F.round(clip01(0.5 + F.col("change") / 6.0), 4)).alias("smart_money"), F.when(F.col("n") >= 5, F.round("rule", 4)).alias("governance"))


def valuation(price: Column, eps: Column, growth: Column) -> Column:
    pe = price / eps
    peg = pe / F.when(growth > 0, growth)
    by_growth = F.when(peg < 1, 0.95).when(peg < 2, 0.7).when(peg.isNotNull(), 0.45).otherwise(0.55)
    return F.when(price.isNull() | eps.isNull(), None).when(eps <= 0, 0.35).when(pe > 90, 0.05).when(pe > 60, 0.25).otherwise(by_growth)


def scores(bars: DataFrame, q: DataFrame, bs: DataFrame, cf: DataFrame, sh: DataFrame, financial: DataFrame) -> DataFrame:
    """(symbol, date, fundamental_score): the weighted mean of the live dimensions at each knowledge event of quarters,
    balance sheets and holdings, at the price of that day."""
    parts = [quarters(q), balances(bs, cf, financial), holdings(sh)]
    days = reduce(DataFrame.unionByName, [p.select("symbol", F.col("known_as_of").alias("date")) for p in parts]).filter("date is not null").distinct()
    out = asof(days, bars.select("symbol", "date", "close"), ["symbol"], "date", "close")
    for p in parts:
        # One struct of a section is carried, so that its values stay those of one period, nulls included.
        fields = [c for c in p.columns if c not in ("symbol", "known_as_of")]
        one = p.groupBy("symbol", F.col("known_as_of").alias("date")).agg(F.max(F.struct(*fields)).alias("s"))
        out = asof(out, one, ["symbol"], "date", "s").select(*out.columns, *[F.col(f"s.{c}").alias(c) for c in fields])
    live = {"earnings": F.col("earnings"), "smart_money": F.col("smart_money"), "strength": F.col("strength"), "governance": F.col("governance"), "valuation": valuation(F.col("close"), F.col("eps_ttm"), F.col("growth_pct"))}
    weight = reduce(lambda a, b: a + b, [F.when(v.isNotNull(), WEIGHTS[k]).otherwise(0.0) for k, v in live.items()])
    total = reduce(lambda a, b: a + b, [F.coalesce(v * WEIGHTS[k], F.lit(0.0)) for k, v in live.items()])
    return out.select("symbol", "date", F.round(F.when(weight > 0, total / weight), 4).alias("fundamental_score"))


def on_bars(bars: DataFrame, scored: DataFrame) -> DataFrame:
    """bars with the score that was known on each day."""
    return asof(bars, scored.filter("fundamental_score is not null"), ["symbol"], "date", "fundamental_score")
