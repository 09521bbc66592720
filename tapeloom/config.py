"""Thresholds of the rules, as frozen values; every function takes its own, and these are the defaults."""

from __future__ import annotations

from dataclasses import dataclass


# The rules' thresholds.
@dataclass(frozen=True)
class Risk:
    capital: float = 1_000_000.0
    risk_pct: float = 1.25
    atr_bars: int = 14
    stop_atr: float = 2.5
    stop_cap_pct: float = 12.0
    value_cap_pct: float = 15.0
    lot_split: float = 0.5
    partial_r: float = 2.5
    partial_share: float = 0.33
    breakeven_r: float = 1.5
    trail_bars: int = 50
    core_bars: int = 150
    slots: int = 12
    cost_pct_a_side: float = 0.15


@dataclass(frozen=True)
class Screen:
    cap_min: float = 200.0
    cap_max: float = 50_000.0
    turnover_min: float = 1.0
    price_min: float = 2.0
    turnover_bars: int = 20
    rs_min: float = 60.0


@dataclass(frozen=True)
class Stage:
    ma_weeks: int = 30
    slope_weeks: int = 8
    band: float = 0.015
    min_weeks: int = 45
    extended_pct: float = 25.0
    extended_atr: float = 3.5
    base_depth_pct: float = 40.0
    below_high_pct: float = 25.0
    base_bars: int = 252


@dataclass(frozen=True)
class Technical:
    short: int = 50
    middle: int = 150
    long: int = 200
    year: int = 252
    uptrend_bars: int = 20
    off_low: float = 1.30
    off_high: float = 0.75
    rs_bars: tuple[int, int, int] = (63, 126, 252)
    vcp_bars: int = 90
    vcp_depth_pct: float = 30.0
    dry_up: float = 0.7
    zigzag_pct: float = 5.0
    breakout_volume: float = 1.5


@dataclass(frozen=True)
class Gap:
    gap_pct: float = 8.0
    volume_times: float = 3.0
    stop_atr: float = 0.75
    min_bars: int = 60
    price_min: float = 20.0
    value_min: float = 1e7


#: Weights of the conviction dimensions; they sum to 100.
CONVICTION = {"earnings": 20, "rs_and_stage": 20, "theme": 15, "smart_money": 12, "strength": 10, "catalyst": 10, "governance": 8, "valuation": 5}
COVERAGE_MIN, VETO_CAP, VETO_PLEDGE, VETO_DEBT, VETO_PE = 0.60, 25.0, 10.0, 2.0, 90.0
FUNDAMENTAL = {"growth": 0.30, "quality": 0.25, "balance": 0.20, "valuation": 0.15, "niche": 0.10}
COMPOSITE = {"fundamental": 0.5, "technical": 0.35, "catalyst": 0.15}
COMPOSITE_CUT = 0.6
