"""Knobs of the trading simulation. Their values become literals in expressions, so that Spark folds what is off."""

from __future__ import annotations

from dataclasses import dataclass

# Fixed values that are not exposed as knobs.
ADV_WINDOW = 63
CORR_WINDOW = 5
CORR_BREAK = 0.5
BETA_DRIFT = 0.30
REGIME_FLOOR = 0.05
YEAR = 252
HISTORY = 3
MAINTENANCE_SHARE, NEW_SHARE = 0.65, 0.35
CLUSTER_CAP = 40
RETURN_WEIGHT = 0.5


@dataclass(frozen=True)
class Params:
    z_entry: float = 2.0
    z_exit: float = 0.5
    time_stop: int = 20
    hard_stop: float = 4.0
    roll_win: int = 63
    cost_bps: float = 3.0
    borrow_apr_bps: float = 0.0
    target_spread_vol_bps: float = 10.0
    portfolio_notional_usd: float = 1e7
    enable_adv_cap: bool = False
    adv_cap_pct: float = 0.01
    enable_impact: bool = False
    impact_k_bps: float = 15.0
    min_adv_usd: float = 0.0
    earnings_blackout_days: int = 0
    earnings_force_exit: bool = True
    use_kalman: bool = False
    kalman_delta: float = 1e-4
    kalman_beta_unc_cap: float = 0.30
    zero_cross_exit: bool = False
    month_end_forceclose: bool = False
    freeze_beta: bool = False
    no_entry_confirm: bool = False
    freeze_spread_stats: bool = False
    normalize_prices: bool = False
    cooldown_days: int = 0

    @property
    def history_rows(self) -> int:
        """Common rows a pair needs before it is looked at."""
        return self.roll_win + 21


@dataclass(frozen=True)
class Filters:
    """What a candidate pair must show over the formation window. maint_passes is our choice; so are the relaxed limits
    for pairs that were held before."""

    min_corr: float = 0.70
    min_hl: float = 5.0
    max_hl: float = 30.0
    adf_alpha: float = 0.05
    min_beta: float = 0.25
    max_beta: float = 4.0
    formation: int = 252
    top_k: int = 5
    cluster_cap: int = CLUSTER_CAP
    maint_passes: int = 2
    maint_corr_slack: float = 0.05
    maint_adf_alpha: float = 0.10
