"""Thresholds of the panel operators."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    """Defaults for daily panels. Nothing depends on how large a panel is."""

    universe_size: int = 500
    holdings: int = 30
    formation: int = 126
    min_trading_frac: float = 0.9
    min_turnover: float = 1e7
    warmup: int = 300
    long_momentum: int = 231
    short_momentum: int = 105
    skip: int = 21
    vol_window: int = 126
    vol_history: int = 63
    reversal: int = 21
    horizon: int = 21
    windows: tuple[int, ...] = (5, 21, 63, 126)
    year: int = 252
    z_minimum: int = 10
    winsor: float = 0.02
    return_cap: float = 0.5
    action_tolerance: float = 0.02
    action_low: float = 0.02
    action_high: float = 2.0
    cost_bps: float = 35.0
    max_weight: float = 0.10
    floor_vol: float = 0.10
    max_group: float = 0.25
    buffer: float = 1.5
    risk_free: float = 0.06
    ewma_lambda: float = 0.94
    filing_age: int = 400
    balance_age: int = 550


#: Weekly panels: the same sizes, with windows in weeks and thresholds for names that trade less often.
WEEKLY = Config(
    formation=26,
    min_trading_frac=0.6,
    min_turnover=1e4,
    warmup=60,
    long_momentum=48,
    short_momentum=22,
    skip=4,
    vol_window=26,
    vol_history=13,
    reversal=4,
    horizon=4,
    windows=(4, 13, 26, 52),
)
