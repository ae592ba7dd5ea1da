"""Command line: python -m quantloom.cli --prices P --factors F [options].

Tables are Parquet paths in long form (see sources.panels). A missing optional table turns its feature off with a
warning; a missing regime table, once asked for, is an error.
"""

from __future__ import annotations

import argparse
import logging
import sys
import time
from collections.abc import Sequence
from dataclasses import fields

from pyspark.sql import SparkSession

from quantloom.operators.clusters import METHODS, ClusterParams
from quantloom.params import Filters, Params
from quantloom.plans.walkforward import WalkForward, walk_forward
from quantloom.sources import panels, sinks

log = logging.getLogger("quantloom")

TABLES = ("prices", "factors", "earnings", "membership", "regimes")
#: Options: (flag, type, default). A default of None means the simulation's own.
VALUES = [
    ("start", str, None), ("end", str, None), ("top-k", int, 5), ("refit", int, 21), ("out-dir", str, ""), ("log-file", str, ""),
    ("z-entry", float, None), ("z-exit", float, None), ("hard-stop", float, None), ("time-stop", int, None), ("borrow-apr-bps", float, 0.0), ("cost-bps", float, None),
    ("impact-k-bps", float, None), ("adv-cap-pct", float, None), ("portfolio-notional", float, None), ("target-vol-bps", float, None), ("min-adv-usd", float, None),
    ("corr-window", int, 126), ("beta-window", int, 252), ("ridge-alpha", float, 10.0), ("pca-betas", int, None), ("ortho-factors", int, None), ("ari-thresh", float, 0.6),
    ("min-corr", float, 0.70), ("min-hl", float, 5.0), ("max-hl", float, 30.0), ("adf-alpha", float, 0.05), ("formation", int, 252),
    ("coint-weight", float, 0.5), ("coint-prefilter-corr", float, 0.70), ("coint-window", int, 252),
    ("kalman-delta", float, 1e-4), ("kalman-unc-cap", float, 0.30), ("earnings-blackout", int, 0),
    ("regime-w-calm", float, 1.0), ("regime-w-stressed", float, 0.5), ("regime-w-crisis", float, 0.0),
    ("roll-win", int, None), ("optics-xi", float, None), ("b-agglo-threshold", float, 0.4), ("cooldown-days", int, 0),
]
SWITCHES = ("enable-impact", "enable-adv-cap", "zero-cost", "neutralize", "use-kalman", "no-earnings-exit", "quiet", "zero-cross-exit", "month-end-forceclose", "freeze-beta", "no-factor-zscore", "c-use-ols", "no-entry-confirm", "freeze-spread-stats", "spx-membership", "normalize-prices")
CHOICES = [("method", METHODS, "fused"), ("factor-source", tuple(panels.FACTOR_SOURCES), "etf_only"), ("regime-overlay", ("none", "hmm_vix"), "none")]
#: Options whose name differs from the simulation's.
NAMES = {"portfolio_notional": "portfolio_notional_usd", "target_vol_bps": "target_spread_vol_bps", "kalman_unc_cap": "kalman_beta_unc_cap", "earnings_blackout": "earnings_blackout_days"}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="quantloom", description="Walk-forward pairs analytics on Spark")
    for t in TABLES:
        out.add_argument(f"--{t}", default=None, help=f"path of the {t} table")
    for name, choices, default in CHOICES:
        out.add_argument(f"--{name}", choices=choices, default=default)
    for name, kind, default in VALUES:
        out.add_argument(f"--{name}", type=kind, default=default)
    for name in SWITCHES:
        out.add_argument(f"--{name}", action="store_true")
    return out


def params(args: argparse.Namespace) -> Params:
    known = {f.name for f in fields(Params)}
    own = {NAMES.get(k, k): v for k, v in vars(args).items() if NAMES.get(k, k) in known and v is not None}
    own["earnings_force_exit"] = not args.no_earnings_exit
    if args.zero_cost:
        own |= {"cost_bps": 0.0, "enable_impact": False}
    return Params(**own)


def filters(args: argparse.Namespace) -> Filters:
    return Filters(min_corr=args.min_corr, min_hl=args.min_hl, max_hl=args.max_hl, adf_alpha=args.adf_alpha, formation=args.formation, top_k=args.top_k)


def cluster_params(args: argparse.Namespace) -> ClusterParams:
    xi = ClusterParams.optics_xi if args.optics_xi is None else args.optics_xi
    return ClusterParams(
        method=args.method, corr_window=args.corr_window, beta_window=args.beta_window, ridge_alpha=args.ridge_alpha, ari_threshold=args.ari_thresh, pca_betas=args.pca_betas,
        ortho_factors=args.ortho_factors, coint_weight=args.coint_weight, coint_prefilter_corr=args.coint_prefilter_corr, coint_window=args.coint_window, optics_xi=xi, c_use_ols=args.c_use_ols,
        agglo_threshold=args.b_agglo_threshold,
    )


def run(spark: SparkSession, args: argparse.Namespace) -> tuple[WalkForward, Params, float | None]:
    p = params(args)
    regime = mean = None
    if args.regime_overlay != "none":
        regime = panels.required_regime(spark, args.regimes or "", calm=args.regime_w_calm, stressed=args.regime_w_stressed, crisis=args.regime_w_crisis)
        mean = sinks.mean_scale(regime)
    earnings = panels.optional(spark, args.earnings, panels.earnings) if p.earnings_blackout_days > 0 else None
    if p.earnings_blackout_days > 0 and earnings is None:
        log.warning("no earnings table: the blackout is off")
    membership = panels.optional(spark, args.membership, panels.membership) if args.spx_membership else None
    if args.spx_membership and membership is None:
        log.warning("no membership table: all tickers are eligible")
    prices = panels.prices(panels.read(spark, args.prices))
    factors = panels.factor_returns(panels.read(spark, args.factors), args.factor_source)
    own = walk_forward(
        prices, factors, p, filters(args), cluster_params(args), args.refit, args.start, args.end, earnings, membership, regime,
        factor_zscores=not args.no_factor_zscore, neutralize=args.neutralize,
    )
    return own, p, mean


def metric_values(args: argparse.Namespace, p: Params, row: dict, mean: float | None) -> dict:
    """What metrics.json holds."""
    if_ = lambda ok, v: v if ok else None
    overlay = args.regime_overlay != "none"
    return {
        "method": args.method, "start": row["first_date"], "end": row["last_date"], "top_k": args.top_k, "refit": args.refit, "z_entry": p.z_entry, "z_exit": p.z_exit,
        "cost_bps": p.cost_bps, "zero_cost": args.zero_cost, "ann_mu_net": row["ann_mu"], "ann_sd": row["ann_sd"], "sharpe_net": row["sharpe"], "ann_mu_gross": row["ann_mu_gross"],
        "sharpe_gross": row["sharpe_gross"], "max_drawdown": row["max_drawdown"], "segments": row["planned_segments"], "unique_pairs_count": row["unique_pairs"],
        "overlap_rate": row["overlap_rate"], "cluster_persistence": row["cluster_persistence"], "total_round_trips": row["total_round_trips"], "avg_hold_days": row["avg_hold_days"],
        "avg_hit_rate": row["avg_hit_rate"], "corr_window": args.corr_window, "beta_window": args.beta_window, "ridge_alpha": args.ridge_alpha, "ari_thresh": args.ari_thresh,
        "factor_source": args.factor_source, "neutralize": args.neutralize, "earnings_blackout_days": args.earnings_blackout, "earnings_force_exit": p.earnings_force_exit,
        "use_kalman": p.use_kalman, "kalman_delta": if_(p.use_kalman, p.kalman_delta), "coint_weight": if_(args.method == "a_coint", args.coint_weight),
        "regime_overlay": args.regime_overlay, "regime_w_calm": if_(overlay, args.regime_w_calm), "regime_w_stressed": if_(overlay, args.regime_w_stressed),
        "regime_w_crisis": if_(overlay, args.regime_w_crisis), "regime_mean_scale": mean,
    }


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.WARNING if args.quiet else logging.INFO, format="%(message)s")
    if not args.prices or not args.factors:
        log.error("--prices and --factors are needed")
        return 2
    spark = spark or SparkSession.builder.appName("quantloom").getOrCreate()
    began = time.time()
    try:
        own, p, mean = run(spark, args)
    except FileNotFoundError as missing:
        log.error("%s", missing)
        return 1
    try:
        return report(spark, args, own, p, mean, began)
    finally:
        own.release()


def report(spark: SparkSession, args: argparse.Namespace, own: WalkForward, p: Params, mean: float | None, began: float) -> int:
    """What is said and written of a run."""
    own.result.keep()
    portfolio = own.result.portfolio
    if portfolio.isEmpty():
        log.warning("no trades: too few pairs or too little data")
        return 0
    row = own.summary().first().asDict()
    log.info("net: mean %.4f, deviation %.4f, Sharpe %s, drawdown %.4f", row["ann_mu"], row["ann_sd"] or 0.0, row["sharpe"], row["max_drawdown"])
    log.info("gross: mean %.4f, Sharpe %s; %s to %s; %s pairs, %s trips", row["ann_mu_gross"], row["sharpe_gross"], row["first_date"], row["last_date"], row["unique_pairs"], row["total_round_trips"])
    if args.out_dir:
        sinks.write_pnl(portfolio, args.out_dir)
        sinks.write_pairs(own.result.segment_pairs, args.out_dir)
        sinks.write_chart(portfolio, args.out_dir, f"Equity: method {args.method}, refit {args.refit}, top {args.top_k}")
        values = metric_values(args, p, row, mean)
        sinks.write_metrics(spark, values, args.out_dir)
        above, _, run_id = args.out_dir.rstrip("/").rpartition("/")
        if not sinks.append_log(spark, values, f"{above}/EXPERIMENTS.md" if above else "EXPERIMENTS.md", run_id):
            log.warning("the research log could not be written")
    if args.log_file:
        keys = ("ann_mu", "ann_sd", "sharpe", "max_drawdown")
        sinks.append_line(spark, {"method": args.method, "start": row["first_date"], "end": row["last_date"], "top_k": args.top_k, "refit": args.refit} | {k: row[k] for k in keys}, args.log_file)
    log.info("done in %.1f s", time.time() - began)
    return 0


if __name__ == "__main__":
    sys.exit(main())
