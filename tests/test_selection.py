import itertools
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.operators import clusters, discovery, features, metrics
from quantloom.params import Filters
from quantloom.plans import walkforward
from test_features import days, panel, walk


def test_formation_statistics_match_numpy(spark):
    n = 150
    x, y = walk(1, n), walk(1, n) ** 0.8 * np.exp(np.random.default_rng(3).normal(0, 0.004, n))
    own = features.align(features.ticker_features(panel(spark, {"A": x, "B": y})), spark.createDataFrame([("A", "B")], "a string, b string"))
    cal = spark.createDataFrame([(d, i) for i, d in enumerate(days(n))], "date date, rn long")
    parts = spark.createDataFrame([(0, days(n)[129], days(n)[149])], "segment_id int, d0 date, d1 date")
    pairs = spark.createDataFrame([(0, 1, "A", "B")], "segment_id int, cluster int, a string, b string")
    r = discovery.formation_stats(discovery.formation_rows(own, cal, parts, 100), pairs).first()
    la, lb = np.log(x)[30:130], np.log(y)[30:130]
    d = np.column_stack([np.ones(100), lb])
    alpha, beta = np.linalg.lstsq(d, la, rcond=None)[0]
    e = la - alpha - beta * lb
    de, e1 = np.diff(e), e[:-1]
    c = np.column_stack([np.ones(99), e1])
    (k, rho), rest = np.linalg.lstsq(c, de, rcond=None)[0], None
    rest = de - c @ np.array([k, rho])
    se = np.sqrt(rest @ rest / 97 / ((e1 - e1.mean()) ** 2).sum())
    rx, ry = x[1:] / x[:-1] - 1, y[1:] / y[:-1] - 1
    assert r.n == 99 and r.beta == pytest.approx(beta, rel=1e-7) and r.alpha == pytest.approx(alpha, rel=1e-6)
    assert r.adf == pytest.approx(rho / se, rel=1e-6) and r.corr63 == pytest.approx(np.corrcoef(rx[66:129], ry[66:129])[0, 1], rel=1e-7)
    assert r.half_life is None if rho <= -1 else r.half_life == pytest.approx(-np.log(2) / np.log(1 + rho), rel=1e-5)


def test_pairs_by_cluster_equal_pairs_by_list(spark):
    """With missing prices, tickers that change or have no cluster, and windows that overlap."""
    n = 120
    closes = {f"T{i}": list(walk(i, n)) for i in range(7)}
    closes["T1"][60:80], closes["T2"][100] = [None] * 20, -1.0
    own = features.ticker_features(panel(spark, closes))
    cal = spark.createDataFrame([(d, i) for i, d in enumerate(days(n))], "date date, rn long")
    parts = spark.createDataFrame([(s, days(n)[i], days(n)[i + 1]) for s, i in enumerate((40, 90, 110))], "segment_id int, d0 date, d1 date")
    labels = [(s, f"T{i}", None if i == 6 and s else (i + s) % 2) for s in range(3) for i in range(7) if (s, i) != (1, 3)]
    labels = spark.createDataFrame(labels, "segment_id int, ticker string, cluster int")
    pairs = discovery.candidates(labels)
    old = discovery.formation_rows(features.align(own, pairs), cal, parts, discovery.CORR_ROWS, pairs)
    new = discovery.cluster_rows(own, labels, cal, parts, discovery.CORR_ROWS)
    key = lambda rows: sorted(map(tuple, rows.select("segment_id", "a", "b", "date", "age", "ra", "rb").collect()), key=str)
    assert key(new) == key(old) and new.count() > 500
    best = lambda rows, p: sorted(map(tuple, discovery.most_correlated(rows, p, Filters(cluster_cap=3)).select("segment_id", "cluster", "a", "b", "corr_rank").collect()))
    assert best(new, None) == best(old, pairs)


def test_cap_on_new_pairs(spark):
    """Pairs held over, and of the new ones at most so many, in the walk itself."""
    for held, most in ((0, 3), (1, 3), (13, 8), (26, 15)):
        assert discovery.most_new(held, 3) == most
    parts = spark.createDataFrame([(i, days(9)[i], days(9)[i + 1]) for i in range(3)], "segment_id int, d0 date, d1 date")
    rows = [(s, 0, f"H{i:02}", "Z", 1.0, 0.0, s < 2, True, i + 1) for s in range(3) for i in range(13)] + [(2, 1, f"N{i:02}", "Z", 1.0, 0.0, True, True, i // 10 + 1) for i in range(30)]
    ranking = spark.createDataFrame(rows, "segment_id int, cluster int, a string, b string, beta double, alpha double, passes boolean, passes_held boolean, pair_rank int")
    own = discovery.walk(ranking, parts, Filters(top_k=13, maint_passes=2)).selected.where("segment_id = 2")
    assert own.where("maintenance").count() == 13 and own.where("NOT maintenance").count() == 13  # top_k, as it is more than 8


def test_walk_holds_pairs_over(spark):
    parts = spark.createDataFrame([(i, days(9)[i], days(9)[i + 1]) for i in range(6)], "segment_id int, d0 date, d1 date")
    rows = []
    for s in (0, 1, 3, 4, 5):  # segment 2 has no candidates and leaves no mark
        for k in range(4):
            rows.append((s, 0, f"A{k}", "Z", 1.0, 0.0, s in (0, 1, 5) or k > 1, True, k + 1))
    ranking = spark.createDataFrame(rows, "segment_id int, cluster int, a string, b string, beta double, alpha double, passes boolean, passes_held boolean, pair_rank int")
    walked = discovery.walk(ranking, parts, Filters(top_k=2))
    got = walked.selected
    own = {s: sorted((r.a, r.maintenance) for r in got.collect() if r.segment_id == s) for s in range(6)}
    assert own[0] == own[1] == [("A0", False), ("A1", False)] and own[2] == []
    assert own[3] == [("A0", True), ("A1", True)]  # held by the looser test; no new pair ranks high enough
    assert [r.segment_id for r in metrics.pair_overlap(got).orderBy("segment_id").collect()] == [1, 3, 4, 5]
    own = {(r.segment_id, r.pair): (r.passed, r.passes, r.held_over) for r in walked.history.collect()}
    assert own[(3, "A0|Z")] == (True, 3, True) and own[(0, "A0|Z")] == (True, 1, False) and (2, "A0|Z") not in own


def test_agreement_and_matching_of_labels(spark):
    rng = np.random.default_rng(0)
    one, two = rng.integers(4, size=40), rng.integers(3, size=40)
    rows = [(0, f"t{i}", int(c)) for i, c in enumerate(one)] + [(1, f"t{i}", int(c)) for i, c in enumerate(two)]
    labels = spark.createDataFrame(rows, "segment_id int, ticker string, cluster int")
    want = clusters.rand_index({i: c for i, c in enumerate(one)}, {i: c for i, c in enumerate(two)})
    assert clusters.adjusted_rand(labels).first().ari == pytest.approx(want)
    table = pd.crosstab(one, two).to_numpy().astype(float)
    best = max(sum(table[i, j] for j, i in enumerate(p)) for p in itertools.permutations(range(4), 3))
    assert clusters.best_assignment(table) == pytest.approx(best)
    assert clusters.persistence(labels).first().persistence == pytest.approx(best / 40)
    assert clusters.rand_index({1: 0, 2: 0, 3: 1}, {1: 5, 2: 5, 3: 7}) == 1.0


def test_frozen_labels(spark):
    base = {f"t{i}": i % 3 for i in range(30)}
    rows = [(0, days(3)[0], t, c) for t, c in base.items()] + [(1, days(3)[1], t, (c + 1) % 3 if t != "t0" else 0) for t, c in base.items()] + [(2, days(3)[2], t, i // 10) for i, t in enumerate(base)]
    out = clusters.freeze(spark.createDataFrame(rows, "segment_id int, refit_date date, ticker string, cluster int"), 0.6).collect()
    own = {s: {r.ticker: r.cluster for r in out if r.segment_id == s} for s in range(3)}
    assert own[0] == own[1] == base and own[2] != base
    late = rows + [(1, days(3)[1], "new", 0)]
    out = clusters.freeze(spark.createDataFrame(late, "segment_id int, refit_date date, ticker string, cluster int"), 0.6)
    assert out.where("ticker = 'new'").count() == 0  # it has no label in the labelling that is held
    parts = spark.createDataFrame([(i, days(9)[i], days(9)[i + 1]) for i in range(4)], "segment_id int, d0 date, d1 date")
    with pytest.raises(KeyError, match=str(days(9)[3])):
        clusters.at_refit(out, parts)


@pytest.mark.parametrize("method", clusters.METHODS)
def test_methods_separate_clear_groups(method):
    rng = np.random.default_rng(1)
    market = rng.normal(0, 0.002, 260)
    f = rng.normal(0, 0.01, (260, 3))
    x = np.concatenate([np.outer(f[:, k], np.ones(6)) + rng.normal(0, 0.002, (260, 6)) for k in range(3)], axis=1) + market[:, None]
    own = clusters.cluster(x, f, market[:, None], np.cumsum(x, 0) + 4, clusters.ClusterParams(method=method))
    assert own.shape == (18,)
    for k in range(3):
        block = own[6 * k : 6 * k + 6]
        assert len(set(block[block >= 0])) <= 1
    assert len(set(own[own >= 0])) == 3


def test_average_linkage_matches_a_plain_version_and_is_quick():
    def plain(distance, threshold):
        groups = [[i] for i in range(len(distance))]
        while len(groups) > 1:
            d, i, j = min((distance[np.ix_(groups[i], groups[j])].mean(), i, j) for i, j in itertools.combinations(range(len(groups)), 2))
            if d > threshold:
                break
            groups[i] += groups.pop(j)
        return {frozenset(g) for g in groups}

    rng = np.random.default_rng(4)
    for n in (1, 2, 9, 30):
        x = rng.normal(size=(n, 3))
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
        for threshold in (0.3, 1.0, 2.5, 9.0):
            own = clusters.average_linkage(d, threshold)
            assert {frozenset(np.flatnonzero(own == k)) for k in set(own)} == plain(d, threshold)
    x = rng.normal(size=(500, 3))
    began = time.process_time()
    clusters.average_linkage(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), 9.0)
    assert time.process_time() - began < 10


def test_xi_areas_and_clusters_of_a_plot():
    r = np.array([9.0, 2.0, 1.0, 1.0, 1.1, 5.0, 1.0, 0.9, 1.0, 9.0])
    assert clusters.steep_areas(r, 0.3, 3, True) == [(0, 1), (5, 5)]
    assert clusters.steep_areas(r, 0.3, 3, False) == [(4, 4), (8, 8)]
    x = np.concatenate([np.random.default_rng(0).normal(c, 0.05, 8) for c in (0.0, 1.0, 5.0)] + [np.array([30.0])])
    own = clusters.optics(np.abs(x[:, None] - x[None]), 3, 0.3)
    assert [len(set(own[8 * k : 8 * k + 8])) for k in range(3)] == [1, 1, 1] and len(set(own[:24])) == 3 and own[24] == -1


@pytest.mark.parametrize("at", [0, 5, 8, 13])
def test_a_dent_in_a_deep_valley_does_not_break_it_up(at):
    # Two groups far apart, eight points each; three points of one are nearer to each other than to the rest, by a tenth.
    near = np.full((16, 16), 1.5)
    near[:8, :8] = near[8:, 8:] = 0.38
    near[at : at + 3, at : at + 3] = 0.34
    np.fill_diagonal(near, 0.0)
    own = clusters.optics(near, 3, 0.05)
    assert (own >= 0).all() and [len(set(own[:8])), len(set(own[8:])), len(set(own))] == [1, 1, 2]


def test_metrics(spark):
    rows = [(0, days(4)[0], -1.0, 0.5), (0, days(4)[1], 2.0, 0.0), (1, days(4)[1], -3.0, 0.1), (1, days(4)[2], 1.0, 0.0)]
    daily = spark.createDataFrame([(s, "A", "B", d, p, c, 1) for s, d, p, c in rows], "segment_id int, a string, b string, date date, pnl double, cost double, pos int")
    port = metrics.portfolio_daily(daily)
    assert port.count() == 4  # the boundary date stays twice
    r = metrics.performance(port).first()
    v = np.array([-1.0, 2.0, -3.0, 1.0])
    assert r.max_drawdown == -3.0 and r.ann_mu == pytest.approx(v.mean() * 252) and r.sharpe == pytest.approx(v.mean() * 252 / (v.std(ddof=1) * np.sqrt(252)))
    one = metrics.performance(port.where(F.col("pnl") == -1.0)).first()
    assert one.max_drawdown == 0.0 and one.sharpe is None  # the first value is the first peak
    assert metrics.with_defaults(port.select("segment_id", "date")).columns[-3:] == ["pnl", "cost", "pnl_gross"]
    empty = metrics.trade_totals(spark.createDataFrame([], "round_trips int, hit_rate double, avg_hold_days double")).first()
    assert tuple(empty) == (0, None, None)


def cointegrated(n=420, k=8):
    rng = np.random.default_rng(8)
    path = np.cumsum(rng.normal(0, 0.01, n))
    out = {}
    for i in range(k):
        noise = np.zeros(n)
        for t in range(1, n):
            noise[t] = 0.9 * noise[t - 1] + rng.normal(0, 0.004)
        out[f"T{i}"] = np.exp(4 + (0.8 + 0.05 * i) * path + noise)
    return out


def test_walk_forward_end_to_end(spark):
    closes = cointegrated()
    prices = panel(spark, closes, 1e5)
    mean = np.mean([np.log(v) for v in closes.values()], axis=0)
    factors = spark.createDataFrame([(d, f, float(x) * s) for f, s in (("SPY", 1.0), ("X", 0.5)) for d, x in zip(days(420)[1:], np.diff(mean))], "date date, factor string, ret double")
    f = Filters(min_corr=0.3, min_hl=1.0, max_hl=60.0, adf_alpha=0.10)
    c = clusters.ClusterParams(method="a", clusters=1)
    own = walkforward.walk_forward(prices, factors, f=f, c=c, refit=42)
    row = own.summary().first()
    assert row.planned_segments == 4 and row.pairs > 0 and row.total_round_trips > 0
    port = own.result.portfolio.collect()
    assert all(r.pnl_gross == pytest.approx(r.pnl + r.cost) for r in port)
    cut = str(days(420)[350])
    short = walkforward.walk_forward(prices, factors, f=f, c=c, refit=42, end=cut)
    key = lambda w: {(r.segment_id, r.a, r.b) for r in w.result.selected.collect() if r.segment_id < 2}
    assert key(own) == key(short)  # what came later changes nothing
    some = np.array([days(420)[350] >= r.d1 for r in own.segments.collect()])
    assert some.any()
    neutral = walkforward.walk_forward(prices, factors, f=f, c=c, refit=42, neutralize=True, factor_zscores=False)
    assert neutral.labels.count() == own.labels.count()


@pytest.mark.parametrize("more", [{"freeze_beta": True}, {"freeze_beta": True, "freeze_spread_stats": True, "normalize_prices": True}, {"use_kalman": True}, {"normalize_prices": True}, {"normalize_prices": True, "use_kalman": True}])
def test_hedge_modes_trade(spark, more):
    from quantloom.params import Params

    prices = panel(spark, cointegrated(260, 3), 1e5)
    chosen = spark.createDataFrame([(0, days(260)[200], days(260)[259], "T0", "T1", 0.95, 0.2), (1, days(260)[150], days(260)[200], "T0", "T1", 0.9, 0.4)], "segment_id int, d0 date, d1 date, a string, b string, beta double, alpha double")
    sim = walkforward.backtest(prices, chosen, Params(roll_win=30, **more)).sim.collect()
    assert {r.segment_id: len(r.out) for r in sim} == {0: 60, 1: 51}
