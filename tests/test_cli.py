import json

import numpy as np

from quantloom import cli
from quantloom.sources import sinks
from test_features import days
from test_selection import cointegrated


def write_inputs(spark, base):
    closes = cointegrated(420, 6)
    rows = [(d, t, float(c), 1e5) for t, own in closes.items() for d, c in zip(days(420), own)]
    spark.createDataFrame(rows, "date date, ticker string, close double, volume double").write.parquet(f"{base}/prices")
    mean = np.mean([np.log(v) for v in closes.values()], axis=0)
    spark.createDataFrame([(d, "SPY", float(x), "etf") for d, x in zip(days(420)[1:], np.diff(mean))], "date date, factor string, ret double, source string").write.parquet(f"{base}/factors")
    spark.createDataFrame([("T0", days(420)[300])], "ticker string, earnings_date date").write.parquet(f"{base}/earnings")
    spark.createDataFrame([(d, "calm") for d in days(420)], "date date, state string").write.parquet(f"{base}/regimes")
    return ["--prices", f"{base}/prices", "--factors", f"{base}/factors", "--min-corr", "0.3", "--min-hl", "1", "--max-hl", "60", "--adf-alpha", "0.1", "--refit", "63", "--method", "a", "--quiet"]


def test_a_run_writes_all_outputs(spark, tmp_path):
    args = write_inputs(spark, tmp_path)
    out, log = tmp_path / "runs" / "one", tmp_path / "log.jsonl"
    more = ["--earnings", f"{tmp_path}/earnings", "--earnings-blackout", "2", "--regimes", f"{tmp_path}/regimes", "--regime-overlay", "hmm_vix", "--out-dir", str(out), "--log-file", str(log)]
    assert cli.main(args + more, spark) == 0
    values = json.loads((out / "metrics.json").read_text())
    assert len(values) == 38 and values["regime_mean_scale"] == 1.0 and values["method"] == "a" and values["kalman_delta"] is None
    assert spark.read.option("header", True).csv(str(out / "pnl.csv")).columns == ["date", "segment_id", "pnl", "cost", "pnl_gross"]
    assert spark.read.option("header", True).csv(str(out / "pairs_by_segment.csv")).count() > 0
    assert any((out / f"equity.{k}").exists() for k in ("svg", "png"))
    assert json.loads(log.read_text().splitlines()[0])["refit"] == 63 and "method: a" in (tmp_path / "runs" / "EXPERIMENTS.md").read_text()


def test_missing_regime_is_an_error_and_other_tables_are_not(spark, tmp_path):
    args = write_inputs(spark, tmp_path)
    assert cli.main(args + ["--regime-overlay", "hmm_vix", "--regimes", f"{tmp_path}/none"], spark) == 1
    assert cli.main(args + ["--earnings-blackout", "3", "--spx-membership", "--z-entry", "50"], spark) == 0
    assert cli.main(["--quiet"], spark) == 2


def test_options_reach_the_parameters():
    args = cli.parser().parse_args(["--zero-cost", "--enable-impact", "--roll-win", "30", "--target-vol-bps", "12", "--portfolio-notional", "5", "--no-earnings-exit", "--kalman-unc-cap", "0.1", "--optics-xi", "0.04"])
    p = cli.params(args)
    assert (p.cost_bps, p.enable_impact, p.roll_win, p.target_spread_vol_bps, p.portfolio_notional_usd, p.earnings_force_exit, p.kalman_beta_unc_cap) == (0.0, False, 30, 12.0, 5.0, False, 0.1)
    assert cli.cluster_params(args).optics_xi == 0.04 and cli.params(cli.parser().parse_args([])) == type(p)()
    assert len([a for a in cli.parser()._actions if a.dest not in ("help", *cli.TABLES)]) == 60


def test_plain_values_and_chart():
    assert sinks.plain(float("nan")) is None and sinks.plain(days(1)[0]) == "2021-01-04" and sinks.plain(3) == 3
    assert "polyline" in sinks.equity_svg([(days(2)[0], 0.0, 0.1), (days(2)[1], 1.0, 1.2)], "t")
