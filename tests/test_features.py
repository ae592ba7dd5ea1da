import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.operators import calendar, context, features, hedge, signals
from quantloom.params import Params
from quantloom.plans import walkforward
from quantloom.sources import panels

DAY = datetime.date(2021, 1, 4)


def days(n):
    return [DAY + datetime.timedelta(days=i) for i in range(n)]


def panel(spark, closes, volume=100.0):
    rows = [(d, t, None if c is None else float(c), volume) for t, own in closes.items() for d, c in zip(days(len(own)), own)]
    return panels.prices(spark.createDataFrame(rows, "date date, ticker string, close double, volume double"))


def walk(seed, n, level=4.0):
    return np.exp(level + np.cumsum(np.random.default_rng(seed).normal(0, 0.01, n)))


def test_rolling_regression_and_scores_match_numpy(spark):
    n, win = 140, 20
    x, y = walk(1, n), walk(2, n)
    p = Params(roll_win=win)
    own = features.pair_features(features.align(features.ticker_features(panel(spark, {"A": x, "B": y})), spark.createDataFrame([("A", "B")], "a string, b string")), p)
    rows = own.orderBy("date").collect()
    lx, ly = np.log(x), np.log(y)
    beta = np.full(n, np.nan)
    s = np.full(n, np.nan)
    for t in range(win - 1, n):
        d = np.column_stack([np.ones(win), ly[t - win + 1 : t + 1]])
        a, b = np.linalg.lstsq(d, lx[t - win + 1 : t + 1], rcond=None)[0]
        beta[t], s[t] = b, lx[t] - b * ly[t] - a
    rp = np.concatenate([[np.nan], x[1:] / x[:-1] - 1 - beta[:-1] * (y[1:] / y[:-1] - 1)])
    for t, r in enumerate(rows):
        past = s[max(0, t - win) : t]
        z = (s[t] - past.mean()) / past.std(ddof=1) if t >= win and not np.isnan(past).any() else np.nan
        sd = rp[max(0, t - win) : t].std(ddof=1) if t >= win else np.nan
        for got, want in ((r.beta, beta[t]), (r.s, s[t]), (r.z, z), (r.rp, rp[t]), (r.sigma, sd)):
            assert (got is None) == np.isnan(want)
            assert got is None or got == pytest.approx(want, rel=1e-7, abs=1e-9)
    assert [r.z is not None for r in rows].index(True) == 2 * win - 1


def test_gaps_bridge_returns_and_leave_the_pair_calendar(spark):
    own = features.ticker_features(panel(spark, {"A": [10.0, None, 11.0, 12.0], "B": [5.0, 5.0, 5.0, 0.0]}), adv_window=2)
    a = own.where("ticker = 'A'").orderBy("date").collect()
    assert [r.ret for r in a] == [None, 0.0, pytest.approx(0.1), pytest.approx(12 / 11 - 1)]
    assert [r.adv is None for r in a] == [True, True, True, False]
    aligned = features.align(own, spark.createDataFrame([("A", "B"), ("A", "X")], "a string, b string")).collect()
    assert sorted(r.date for r in aligned) == [days(4)[0], days(4)[2]]


def test_the_last_known_close_is_found_in_one_pass(spark):
    """Over a long gap, and without a frame of bounded length, which costs the square of a ticker's rows."""
    own = features.ticker_features(panel(spark, {"A": [10.0] + [None] * 98 + [12.0], "B": [None] * 99 + [5.0]}))
    frames = own.select("ret")._jdf.queryExecution().optimizedPlan().toString()
    assert "unboundedpreceding" in frames and "-2147483648" not in frames
    got = {(r.ticker, r.date): r.ret for r in own.collect()}
    assert got["A", days(100)[98]] == 0.0 and got["A", days(100)[99]] == pytest.approx(0.2)
    assert got["A", days(100)[0]] is None and got["B", days(100)[99]] is None


def test_absent_days_of_the_calendar_count_as_missing(spark):
    """A ticker without rows on some days: its dollar volume needs every day of the calendar, its returns bridge the gap."""
    rows = [(d, "A", 10.0 + i, 2.0) for i, d in enumerate(days(8)) if i != 3] + [(d, "B", 5.0, 1.0) for d in days(8)]
    own = features.ticker_features(panels.prices(spark.createDataFrame(rows, "date date, ticker string, close double, volume double")), adv_window=3)
    got = {r.date: r for r in own.where("ticker = 'A'").collect()}
    assert [got[d].adv is not None for d in days(8) if d in got] == [False, False, True, False, False, True, True]
    assert got[days(8)[4]].ret == pytest.approx(14 / 12 - 1) and got[days(8)[6]].adv == pytest.approx(2 * 15.0)
    factors = spark.createDataFrame([(d, "X", float(i)) for i, d in enumerate(days(8)) if i % 2] + [(d, "Y", 1.0) for d in days(8)], "date date, factor string, ret double")
    z = {r.date: r.z for r in features.factor_zscore(factors, 4, 2).where("factor = 'X'").collect()}
    assert z[days(8)[7]] == pytest.approx((7 - 6) / (np.sqrt(2) + 1e-8)) and z[days(8)[1]] == 0.0


def test_a_segment_sees_only_what_is_before_its_end(spark):
    """The history gate and the filter's seed count rows up to the end of the segment."""
    x, y = walk(5, 300), walk(6, 300)
    prices = panel(spark, {"A": x, "B": y}, 1e5)
    chosen = spark.createDataFrame([(0, days(300)[40], days(300)[70], "A", "B"), (1, days(300)[90], days(300)[110], "A", "B"), (2, days(300)[280], days(300)[299], "A", "B")], "segment_id int, d0 date, d1 date, a string, b string")
    for p in (Params(), Params(freeze_beta=True), Params(use_kalman=True)):
        series, seeded = walkforward.pair_series(prices, chosen, p)
        assert sorted(r.segment_id for r in signals.segment_rows(series, seeded).select("segment_id").distinct().collect()) == [1, 2]  # 71 rows are less than 84
    series, seeded = walkforward.pair_series(prices, chosen, Params(use_kalman=True))
    assert {r.segment_id: r.seed for r in seeded.collect()} == {0: 20, 1: 27, 2: 63}
    rows = {(r.segment_id, r.date): r for r in signals.segment_rows(series, seeded).collect()}
    lx, ly = np.log(x), np.log(y)
    for segment, at, end in ((1, 100, 111), (2, 290, 300)):  # as if the segment's end were the last day there is
        assert rows[(segment, days(300)[at])].beta == pytest.approx(hedge.kalman_path(lx[:end], ly[:end], 1e-4)[0][at], rel=1e-9)


def test_constant_leg_has_no_score_and_no_error(spark):
    own = features.ticker_features(panel(spark, {"A": walk(1, 60), "B": [7.0] * 60}))
    out = features.pair_features(features.align(own, spark.createDataFrame([("A", "B")], "a string, b string")), Params(roll_win=10))
    assert out.where("beta IS NOT NULL OR z IS NOT NULL").count() == 0


def test_history_gate_counts_rows_up_to_the_end(spark):
    own = features.align(features.ticker_features(panel(spark, {"A": walk(1, 31), "B": walk(2, 31)})), spark.createDataFrame([("A", "B")], "a string, b string"))
    p = Params(roll_win=10)
    assert features.long_enough(own, p).count() == 31
    assert features.long_enough(features.capped(own, str(days(31)[29])), p).count() == 0


def test_no_look_ahead(spark):
    x, y = walk(3, 120), walk(4, 120)
    later = x.copy()
    later[90:] *= 2
    one, two = ({r.date: r for r in features.pair_features(features.align(features.ticker_features(panel(spark, {"A": v, "B": y})), spark.createDataFrame([("A", "B")], "a string, b string")), Params(roll_win=15)).collect()} for v in (x, later))
    assert all(one[d].z == two[d].z and one[d].sigma == two[d].sigma for d in days(90))
    scaled = {r.date: r for r in features.pair_features(features.align(features.ticker_features(panel(spark, {"A": x * 3, "B": y * 7})), spark.createDataFrame([("A", "B")], "a string, b string")), Params(roll_win=15)).collect()}
    assert all(one[d].z is None or scaled[d].z == pytest.approx(one[d].z, abs=1e-6) for d in days(120))


def test_factor_scores(spark):
    rows = [(d, "SPY", None if i == 70 else float(np.sin(i))) for i, d in enumerate(days(100))] + [(d, "FF_RF", 1.0) for d in days(3)]
    own = features.factor_zscore(panels.factor_returns(spark.createDataFrame(rows, "date date, factor string, ret double"))).orderBy("date").collect()
    assert len(own) == 100 and [r.z for r in own[:62]] == [0.0] * 62 and own[70].z == 0.0
    v = np.sin(np.arange(63))
    assert own[62].z == pytest.approx((v[-1] - v.mean()) / (v.std(ddof=1) + 1e-8))


def test_capacity_scales_weights(spark):
    df = spark.createDataFrame([(0.005, 1e6, 4e6), (0.005, None, 1e6), (0.005, None, None), (0.005, 0.0, 1e12)], "sigma double, adva double, advb double")
    got = [r.w for r in features.vol_weight(df, Params(enable_adv_cap=True)).collect()]
    assert got == pytest.approx([0.001, 0.001, 0.2, 0.2])


def kalman_by_matrices(y, x, delta):
    n = len(y)
    m = min(63, max(20, n // 4))
    scale = np.array([x[max(0, t - 29) : t + 1].mean() for t in range(n)])
    scale[np.abs(scale) < 1e-6] = 1.0
    d = np.stack([x[:m] / scale[:m], np.ones(m)], 1)
    state = np.linalg.lstsq(d, y[:m], rcond=None)[0]
    rest = y[:m] - d @ state
    cov = (rest.var() + 1e-8) * np.linalg.inv(d.T @ d + 1e-8 * np.eye(2))
    buffer, out = list(rest[-30:] ** 2), []
    for t in range(n):
        cov = cov + delta * np.eye(2)
        h = np.array([x[t] / scale[t], 1.0])
        gap = y[t] - h @ state
        buffer = (buffer + [gap**2])[-30:]
        gain = cov @ h / (h @ cov @ h + np.mean(buffer) + 1e-8)
        state = state + gain * gap
        cov = (np.eye(2) - np.outer(gain, h)) @ cov
        out.append((state[0] / scale[t], state[1], np.sqrt(max(cov[0, 0], 0)) / scale[t]))
    return np.array(out)


@pytest.mark.parametrize("n", [80, 251, 300])
def test_kalman_matches_matrix_form(n):
    x, y = np.log(walk(5, n)), np.log(walk(6, n))
    got = np.stack(hedge.kalman_path(y, x, 1e-4), 1)
    assert np.allclose(got, kalman_by_matrices(y, x, 1e-4), rtol=1e-7, atol=1e-9)


def test_kalman_and_frozen_features(spark):
    own = features.align(features.ticker_features(panel(spark, {"A": walk(1, 100), "B": walk(2, 100)})), spark.createDataFrame([("A", "B")], "a string, b string"))
    p = Params(roll_win=20, use_kalman=True)
    first = hedge.kalman_features(own, p).where("z IS NOT NULL AND sigma IS NOT NULL").agg(F.min("date")).first()[0]
    assert first == days(100)[p.roll_win + 1]
    chosen = spark.createDataFrame([(0, days(100)[50], "A", "B", None), (1, days(100)[3], "A", "B", 0.5)], "segment_id int, d0 date, a string, b string, beta double")
    out = hedge.frozen_features(own, chosen, Params(roll_win=20, freeze_beta=True, freeze_spread_stats=True))
    rows = {r.segment_id: r for r in out.where(F.col("date") == days(100)[60]).collect()}
    la, lb = np.log(walk(1, 100)), np.log(walk(2, 100))
    s = la - lb
    assert rows[0].beta == 1.0 and rows[0].mu == pytest.approx(s[:49].mean()) and rows[0].sd == pytest.approx(s[:49].std(ddof=1))
    assert rows[1].mu == 0.0 and rows[1].sd is None and rows[1].z is None


def test_segments_and_refit_rows(spark):
    own = calendar.calendar(spark.createDataFrame([(d,) for d in days(20)] * 2, "date date"))
    got = [tuple(r) for r in calendar.segments(own, refit=5, burn=8).orderBy("segment_id").collect()]
    d = days(20)
    assert got == [(0, d[8], d[13]), (1, d[13], d[18]), (2, d[18], d[19])]
    assert calendar.segments(own, 5, 8, str(d[10])).count() == 2
    assert calendar.burn_in() == 252


def test_blackout_membership_and_regime(spark):
    d = days(10)
    earnings = spark.createDataFrame([("A", d[3]), ("A", d[4]), ("A", None), ("Z", d[5]), ("B", datetime.date(2020, 12, 31))], "ticker string, earnings_date date")
    trading = spark.createDataFrame([(x,) for x in d if x.weekday() < 5], "date date")
    got = context.blackout(earnings, spark.createDataFrame([("A",), ("B",)], "ticker string"), trading, 2)
    assert sorted((r.ticker, r.date) for r in got.collect()) == [("A", x) for x in d[1:7] if x.weekday() < 5]
    rows = spark.createDataFrame([("A", "B", d[3]), ("B", "A", d[2]), ("A", "B", d[9])], "a string, b string, date date")
    assert [r.blk for r in context.with_blackout(rows, got).orderBy("date").collect()] == [True, True, False]
    labels = spark.createDataFrame([(0, d[5], t) for t in ("A", "B", "C", "D")] + [(0, d[5], None)], "segment_id int, refit_date date, ticker string")
    members = panels.membership(spark.createDataFrame([("A", d[5], None), ("B", d[0], d[5]), ("C", d[6], None), ("D", d[0], d[4]), (None, d[0], None)], "ticker string, start_date date, end_date date"))
    assert sorted(r.ticker for r in context.active(labels, members).collect()) == ["A", "B"]
    regime = panels.regime(spark.createDataFrame([(d[3], "crisis"), (d[9], "calm")], "date date, state string"))
    assert [r.rscale for r in context.with_regime(rows, regime).orderBy("date").collect()] == [1.0, 0.0, 1.0]
