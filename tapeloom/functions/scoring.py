"""Scores of fundamentals as column expressions: null means that a dimension is not live, never that it is 0."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapeloom import config as cfg

from .windows import clip01


def ramp(x: Column, least: float) -> Column:
    return clip01(x / (2 * least))


def growth(sales: Column, profit: Column, least: float = 15.0) -> Column:
    return 0.4 * ramp(sales, least) + 0.6 * ramp(profit, least)


def quality(roce: Column, roe: Column, least: float = 15.0) -> Column:
    return 0.6 * ramp(roce, least) + 0.4 * ramp(roe, least)


def balance(debt_to_equity: Column, pledge: Column, holding: Column, change: Column, de_max: float = 0.5, pledge_max: float = 5.0, holding_min: float = 30.0) -> Column:
    moved = F.coalesce(clip01(0.5 + change / 10.0), F.lit(0.5))
    return 0.35 * clip01(1 - debt_to_equity / (2 * de_max)) + 0.30 * clip01(1 - pledge / (3 * pledge_max)) + 0.20 * clip01(holding / (1.5 * holding_min)) + 0.15 * moved


def valuation(peg: Column, most: float = 1.5) -> Column:
    return F.when(peg <= 0, 0.3).otherwise(clip01(1 - peg / (2 * most)))


def fundamental(parts: dict[str, Column], weights: dict[str, float] = cfg.FUNDAMENTAL) -> Column:
    """Weighted sum; a missing niche counts as half."""
    return reduce(lambda a, b: a + b, [weights[k] * (F.coalesce(clip01(v), F.lit(0.5)) if k == "niche" else v) for k, v in parts.items()])


def quarter(latest: Column, ago: Column, confirmed: Column) -> Column:
    """A quarter's profit against a year ago: a turn to profit counts fully if margins confirm it."""
    grown = F.least(F.greatest((latest - ago) / F.nullif(F.abs(ago), F.lit(0.0)), F.lit(-1.0)), F.lit(2.0))
    turned, lost, flat = F.when(confirmed, 1.0).otherwise(0.4), F.when(latest > ago, 0.3).otherwise(0.0), F.when(latest > 0, 0.75).otherwise(0.25)
    score = F.when((ago < 0) & (latest >= 0), turned).when((ago <= 0) & (latest < 0), lost).when(ago == 0, flat).otherwise(clip01(0.5 + grown / 2))
    return F.when(latest.isNotNull() & ago.isNotNull(), score)


def earnings(latest: Column, ago: Column, margin: Column, margin_ago: Column, short: Column, long: Column) -> Column:
    """Quarterly momentum, acceleration (growth of a year against that of three) and level of growth in per cent."""
    known = short.isNotNull() & long.isNotNull()
    faster = F.when((short > long) & (long > 0), 1.0).when(short > long, 0.7).otherwise(0.3)
    pace, level = F.when(known, faster).otherwise(0.5), F.when(known, clip01(short / 30.0)).otherwise(0.5)
    return 0.45 * quarter(latest, ago, F.coalesce(margin > margin_ago, F.lit(False))) + 0.30 * pace + 0.25 * level


def strength(debt: Column, debt_ago: Column, debt_to_equity: Column, cash_flow: Column, capital: Column, capital_ago: Column, financial: Column) -> Column:
    change = (debt - debt_ago) / F.when(debt_ago > 0, debt_ago)
    trend = F.when(change < -0.2, 1.0).when(change > 0.5, 0.15).otherwise(0.5)
    level = F.coalesce(clip01(1 - debt_to_equity / 1.5), F.lit(0.5))
    cash = F.when(cash_flow > 0, 0.8).when(cash_flow <= 0, 0.1).otherwise(0.5)
    diluted = F.coalesce(capital / F.when(capital_ago > 0, capital_ago) > 1.25, F.lit(False))
    extras = F.when(diluted, F.greatest(cash - 0.3, F.lit(0.0))).otherwise(cash)
    return F.when(financial, 0.5).when(debt.isNotNull() | debt_to_equity.isNotNull(), 0.4 * trend + 0.4 * level + 0.2 * extras)


def valuation_sanity(pe: Column, growth_3y: Column, growth_ttm: Column, latest: Column, ago: Column) -> Column:
    """Marks froth down; a price on earnings that have just recovered tells nothing yet."""
    recovering = F.coalesce((ago <= 0) & (latest > 0), F.lit(False)) | F.coalesce(growth_ttm > 150, F.lit(False))
    peg = pe / F.when(growth_3y > 0, growth_3y)
    priced = F.when(peg < 1, 0.95).when(peg < 2, 0.7).when(peg.isNotNull(), 0.45).otherwise(0.55)
    return F.when(pe.isNull(), 0.35).when(pe > cfg.VETO_PE, F.when(recovering, 0.5).otherwise(0.05)).when(pe > 60, F.when(recovering, 0.5).otherwise(0.25)).otherwise(priced)


def governance(pledge: Column, promoter: Column, promoter_ago: Column) -> Column:
    start = F.when(pledge.isNull() | (pledge == 0), 0.85).when(pledge <= 5, 0.5).when(pledge <= cfg.VETO_PLEDGE, 0.25).otherwise(0.05)
    drop = promoter_ago - promoter
    return F.when(drop > 2, F.greatest(start - 0.3, F.lit(0.0))).when(drop < -1, F.least(start + 0.1, F.lit(1.0))).otherwise(start)


def smart_money(fii: Column, fii_ago: Column, dii: Column, dii_ago: Column) -> Column:
    change = F.coalesce(fii - fii_ago, F.lit(0.0)) + F.coalesce(dii - dii_ago, F.lit(0.0))
    return F.when(fii.isNotNull() | dii.isNotNull(), clip01(0.5 + change / 6.0))


def vetoes(pledge: Column, debt_to_equity: Column, pe: Column) -> Column:
    flags = F.array(F.when(pledge > cfg.VETO_PLEDGE, "promoter_pledge"), F.when((debt_to_equity > cfg.VETO_DEBT) & (pe > cfg.VETO_PE), "leverage_plus_froth"))
    return F.filter(flags, lambda x: x.isNotNull())


def archetypes(latest: Column, ago: Column, margin: Column, margin_ago: Column, debt: Column, debt_ago: Column, financial: Column, roce: Column, debt_to_equity: Column, profit_3y: Column, sales_ttm: Column, sales_3y: Column) -> Column:
    swing = (ago < 0) & (latest >= 0) & (margin > margin_ago)
    paid = ~financial & ((debt - debt_ago) / F.when(debt_ago > 0, debt_ago) < -0.3)
    kinds = F.array(
        F.when(F.coalesce(swing, F.lit(False)) | F.coalesce(paid, F.lit(False)), "Turnaround"),
        F.when((roce >= 20) & (debt_to_equity.isNull() | (debt_to_equity <= 0.3)) & (profit_3y >= 15), "Quality"),
        F.when((sales_ttm >= 30) & (sales_3y >= 25), "Hyper-growth"),
    )
    return F.filter(kinds, lambda x: x.isNotNull())


def assess(dimensions: dict[str, Column], vetoed: Column, weights: dict[str, int] = cfg.CONVICTION) -> Column:
    """struct(score, coverage, label): the weighted mean of the live dimensions; vetoed scores stay low."""
    unknown = set(dimensions) - set(weights)
    if unknown or sum(weights.values()) != 100:
        raise ValueError(f"unknown dimensions {sorted(unknown)}, or weights that do not sum to 100")
    live = reduce(lambda a, b: a + b, [F.when(v.isNotNull(), weights[k]).otherwise(0) for k, v in dimensions.items()])
    total = reduce(lambda a, b: a + b, [F.coalesce(v * weights[k], F.lit(0.0)) for k, v in dimensions.items()])
    score = F.when(live > 0, total / live * 100)
    score = F.when(vetoed, F.least(score, F.lit(cfg.VETO_CAP))).otherwise(score)
    coverage = live / 100
    return F.struct(score.alias("score"), coverage.alias("coverage"), F.when(live == 0, "No data").when(coverage >= cfg.COVERAGE_MIN, "Conviction").otherwise("Technical Read").alias("label"))


def entry_plan(entry: Column, atr: Column, stop: Column, scale: Column, r: cfg.Risk = cfg.Risk()) -> Column:
    """struct(stop, shares, core, trading, partial, breakeven) of an entry; null where the stop is too wide.

    The stop is the event's own, else some ATRs below, else the cap. A stop wider than the cap is no trade, it is not
    moved. Too few shares for two lots are one trading lot.
    """
    cap = entry * (r.stop_cap_pct / 100)
    risk = F.when(stop.isNotNull(), entry - stop).when(atr > 0, r.stop_atr * atr).otherwise(cap)
    shares = F.least(F.floor(r.capital * r.risk_pct / 100 * scale / F.when(risk > 0, risk)), F.floor(r.capital * r.value_cap_pct / 100 / entry))
    half = F.floor(shares * r.lot_split)
    split = (half > 0) & (shares - half > 0)
    plan = F.struct(
        (entry - risk).alias("stop"), shares.alias("shares"), F.when(split, shares - half).otherwise(0).alias("core"), F.when(split, half).otherwise(shares).alias("trading"), (entry + r.partial_r * risk).alias("partial"), (entry + r.breakeven_r * risk).alias("breakeven")
    )
    return F.when((risk > 0) & (risk / entry * 100 <= r.stop_cap_pct), plan)


def rs_and_stage(percentile: Column, blend: Column, checks: Column, stage: Column, vcp: Column) -> Column:
    """Strength (its percentile, else the raw blend), trend checks, stage and a live base."""
    strong = F.coalesce(percentile / 100.0, clip01((blend - 0.8) / 0.7), F.lit(0.5))
    return 0.40 * strong + 0.30 * (F.coalesce(checks, F.lit(0)) / 8.0) + 0.15 * F.when(stage == 2, 1.0).when(stage == 1, 0.5).otherwise(0.0) + 0.15 * F.when(vcp, 1.0).otherwise(0.0)


def entry_status(validated: Column, vcp: Column) -> Column:
    return F.when(validated, "VALIDATED").when(vcp, "AWAITING TRIGGER").otherwise("NO VCP BASE")


def conviction_band(score: Column) -> Column:
    return F.when(score < 50, "<50").when(score < 60, "50-60").when(score < 70, "60-70").when(score.isNotNull(), "70+")


def action(status: Column, kind: Column, trigger: Column) -> Column:
    """What an alert asks for, as a style: veto, ep, mute, warn, act, watch or weak."""
    gap = kind == "EPISODIC PIVOT"
    return F.when(status == "VETOED", "veto").when(gap & (status != "FADED"), "ep").when(status == "FADED", "mute").when(status == "RAN AWAY", "warn").when(trigger == "VALIDATED", "act").when(trigger == "AWAITING TRIGGER", "watch").otherwise("weak")


def catalyst_with_events(base: Column, events: Column, items: Column, mood: Column) -> Column:
    """Events and the base score of themes; a clearly bad mood takes some of it."""
    score = F.least(0.5 * F.least(events / 3.0, F.lit(1.0)) + 0.5 * base + F.when(items >= 5, 0.1).otherwise(0.0), F.lit(1.0))
    return F.when(mood < -0.3, F.greatest(score - 0.2, F.lit(0.0))).otherwise(score)


def theme_tailwind(themes: Column) -> Column:
    return F.when(themes > 0, F.least(0.3 + 0.35 * F.least(themes, F.lit(2)), F.lit(1.0))).otherwise(0.3)


def radar(polarity: Column, tag: Column, held: Column) -> Column:
    """Class of a filing, 0 first: bad news of a held symbol, good news of one confirmed or forming, good, bad, other."""
    held, forming = F.coalesce(held, F.lit(False)), F.coalesce(tag.isin("CONFIRMED", "ANTICIPATION"), F.lit(False))
    good, bad = polarity == "pos", polarity == "neg"
    return F.when(bad & held, 0).when(good & forming, 1).when(good, 2).when(bad, 3).otherwise(4)
