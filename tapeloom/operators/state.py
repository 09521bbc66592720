"""State between runs: differences, snapshots, merges and expiry, as joins of two tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeloom.config import Risk


def unseen(new: DataFrame, archive: DataFrame, key: Column, name: str = "__key") -> DataFrame:
    """New rows whose key the archive lacks, once each."""
    fresh = new.withColumn(name, key).join(archive.select(key.alias(name)).distinct(), name, "left_anti")
    return fresh.dropDuplicates([name]).drop(name)


def replace_by_key(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows without those whose key value new rows have, and the new rows."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def once_within(events: DataFrame, keys: list[str], time: str, days: int) -> DataFrame:
    """Events that have no other of their keys in the days before."""
    before = F.lag(time).over(Window.partitionBy(*keys).orderBy(time))
    return events.withColumn("__b", before).filter(F.col("__b").isNull() | (F.date_diff(F.col(time), F.col("__b")) > days)).drop("__b")


def churn(then: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """One row: how many were there, stayed, left, and the share that left."""
    both = then.select(key).distinct().withColumn("a", F.lit(1)).join(now.select(key).distinct().withColumn("b", F.lit(1)), key, "full")
    n = lambda c: F.count_if(c)
    was, stayed = F.col("a").isNotNull(), F.col("a").isNotNull() & F.col("b").isNotNull()
    return both.agg(n(was).alias("was"), n(stayed).alias("stayed"), (n(was) - n(stayed)).alias("left"), F.round(100.0 * (n(was) - n(stayed)) / n(was), 4).alias("churn_pct"))


def merge_details(alerts: DataFrame, watch: DataFrame, key: str) -> DataFrame:
    """One detail a key: the alert's if it covers as much as the watch list's, else that."""
    j = alerts.select(key, F.struct("score", "coverage").alias("a")).join(watch.select(key, F.struct("score", "coverage").alias("w")), key, "full")
    best = F.when(F.col("w").isNull() | (F.col("a.coverage") >= F.col("w.coverage")), F.col("a")).otherwise(F.col("w"))
    return j.select(key, F.coalesce(best, F.col("w")).alias("d")).select(key, "d.score", "d.coverage")


def reconcile(positions: DataFrame, holdings: DataFrame, key: str = "symbol") -> DataFrame:
    """What positions and holdings disagree on."""
    j = positions.select(key, F.col("shares").alias("p")).join(holdings.select(key, F.col("quantity").alias("h")), key, "full")
    what = F.when(F.col("h").isNull(), "not held").when(F.col("p").isNull(), "not tracked").when(F.col("p") != F.col("h"), "quantity differs").otherwise("equal")
    return j.select(key, F.col("p").alias("shares"), F.col("h").alias("quantity"), what.alias("state"))


def check_positions(positions: DataFrame, last: DataFrame) -> DataFrame:
    """What the last bar does to each position: stop, then partial, then break even, then trail; one event a row."""
    j = positions.join(last, "symbol")
    risk = F.col("entry") - F.col("stop")
    event = (
        F.when(F.col("low") <= F.col("stop"), "stop")
        .when(~F.col("partial_taken") & (F.col("high") >= F.col("entry") + 2.5 * risk), "partial")
        .when(~F.col("breakeven_moved") & (F.col("close") >= F.col("entry") + 1.5 * risk), "break even")
        .when(F.col("partial_taken") & (F.col("close") < F.col("trail")), "trail")
        .otherwise("hold")
    )
    return j.select("symbol", "date", event.alias("event"))


def manage(positions: DataFrame, last: DataFrame, r: Risk = Risk()) -> DataFrame:
    """Events of each open position at its symbol's last bar, in the order of the rules, and the flags after them.

    positions (symbol, entry, initial_stop, stop, trading_open, core_open, partial_taken, breakeven_moved); last (symbol,
    date, low, high, close, sma_short, week_close, week_sma). A stop ends both lots and asks nothing more. Partial sale and
    break even come once each; the trading lot goes below the short average after its partial sale, the core lot where the
    last completed week closed below its average. Positions without risk, bar or open lot have no events and stay as they
    are; unknown averages fire nothing.
    """
    c, no = F.col, F.lit(False)
    j = positions.join(last, "symbol", "left")
    risk = c("entry") - c("initial_stop")
    live = (c("trading_open") | c("core_open")) & (risk > 0) & c("date").isNotNull()
    j = j.withColumn("__stop", F.coalesce(live & (c("low") <= c("stop")), no)).withColumn("__on", F.coalesce(live & ~c("__stop"), no))
    j = j.withColumn("__part", F.coalesce(c("__on") & c("trading_open") & ~c("partial_taken") & (c("high") >= c("entry") + risk * r.partial_r), no))
    j = j.withColumn("__even", F.coalesce(c("__on") & ~c("breakeven_moved") & (c("close") >= c("entry") + risk * r.breakeven_r), no))
    j = j.withColumn("__trail", F.coalesce(c("__on") & c("trading_open") & (c("partial_taken") | c("__part")) & (c("close") < c("sma_short")), no))
    j = j.withColumn("__core", F.coalesce(c("__on") & c("core_open") & (c("week_close") < c("week_sma")), no))
    names = {"__stop": "stop", "__part": "partial", "__even": "break even", "__trail": "trail", "__core": "core exit"}
    events = F.concat_ws(",", *[F.when(c(k), name) for k, name in names.items()])
    return j.select(
        "symbol",
        events.alias("events"),
        F.when(c("__even"), F.greatest("stop", "entry")).otherwise(c("stop")).alias("stop"),
        (c("trading_open") & ~c("__stop") & ~c("__trail")).alias("trading_open"),
        (c("core_open") & ~c("__stop") & ~c("__core")).alias("core_open"),
        (c("partial_taken") | c("__part")).alias("partial_taken"),
        (c("breakeven_moved") | c("__even")).alias("breakeven_moved"),
    )


def entries(verdicts: DataFrame, held: DataFrame, r: Risk = Risk()) -> DataFrame:
    """What becomes of buy verdicts (id, symbol, alerted, stop, fill_open, half, scale): the first reason not to fill, or buy
    with shares in two lots. held: symbols with an open lot; verdicts of one run do not see each other's fills.

    fill_open is the open of the first bar after the verdict, null while there is none (pending: asked again next time).
    """
    c = F.col
    j = verdicts.join(held.select("symbol", F.lit(True).alias("__held")).distinct(), "symbol", "left")
    money = r.capital * r.risk_pct / 100 * c("scale") * F.when(c("half"), 0.5).otherwise(1.0)
    by_risk = F.floor(money / F.nullif(c("fill_open") - c("stop"), F.lit(0.0)))
    n = F.least(by_risk, F.floor(F.lit(r.capital * r.value_cap_pct / 100) / F.nullif(c("fill_open"), F.lit(0.0)))).cast("long")
    what = (
        F.when(c("__held"), "already open")
        .when(~c("alerted"), "no alert")
        .when(c("stop").isNull(), "no stop")
        .when(c("fill_open").isNull(), "pending")
        .when(c("fill_open") <= c("stop"), "gapped below stop")
        .when(n < 2, "too small")
        .otherwise("buy")
    )
    lots = j.select("id", "symbol", what.alias("action"), n.alias("n"))
    bought = F.when(c("action") == "buy", c("n"))
    trading = F.floor(bought * F.lit(r.lot_split)).cast("long")
    return lots.select("id", "symbol", "action", trading.alias("shares_trading"), (bought - trading).alias("shares_core"))


def keep_newest(snapshots: DataFrame, day: str, n: int = 90) -> DataFrame:
    """The rows of the n newest days; the days, n rows at most, are broadcast."""
    days = snapshots.select(day).distinct().orderBy(F.desc(day)).limit(n)
    return snapshots.join(F.broadcast(days), day, "left_semi")


def unexpired(details: DataFrame, time: str, now: Column, days: int = 30) -> DataFrame:
    """Details not older than the days; those without a time go."""
    return details.filter(F.col(time) >= F.date_sub(now, days))
