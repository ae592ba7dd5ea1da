"""The whole dataflow: panels, labels, pairs by segment, trading, portfolio, metrics.

Only pair selection is sequential, on the driver over the few candidates that passed. Pair series are computed once for
all segments, and every (segment, pair) trades in one job.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.operators import calendar, clusters, context, discovery, features, fold, hedge, metrics, signals
from quantloom.params import Filters, Params
from quantloom.sources import panels


class Kept(list):
    """Tables kept in memory while a run looks at them several times, until release()."""

    def __call__(self, df: DataFrame) -> DataFrame:
        self.append(df.persist())
        return self[-1]

    def release(self) -> None:
        while self:
            self.pop().unpersist()


@dataclass
class Backtest:
    """sim: one row for each (segment_id, a, b); the rest are derived from it."""

    selected: DataFrame
    sim: DataFrame
    kept: Kept = field(default_factory=Kept)

    @property
    def daily(self) -> DataFrame:
        return fold.traded_daily(self.sim)

    @property
    def portfolio(self) -> DataFrame:
        return metrics.portfolio_daily(self.daily)

    @property
    def stats(self) -> DataFrame:
        return fold.trade_stats(self.sim)

    @property
    def segment_pairs(self) -> DataFrame:
        return metrics.attach_stats(self.selected, self.stats)

    def keep(self) -> None:
        """The simulation and the pairs in memory, from now on until kept.release()."""
        if not self.sim.is_cached:
            self.sim, self.selected = self.kept(self.sim), self.kept(self.selected)

    def summary(self) -> DataFrame:
        """One row of all metrics."""
        self.keep()
        out = metrics.performance(self.portfolio)
        for part in (metrics.trade_totals(self.stats), metrics.diagnostics(self.selected), metrics.pair_overlap(self.selected).agg(F.avg("overlap").alias("overlap_rate"))):
            out = out.crossJoin(F.broadcast(part))  # one row each: aggregates without keys
        return out


def pair_series(prices: DataFrame, selected: DataFrame, p: Params, end: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The series of the pairs selected by the hedge ratio asked for (frozen before Kalman before rolling), and selected
    with what its segments need to find their rows in them."""
    own = features.ticker_features(features.capped(prices, end))
    aligned = features.long_enough(features.align(own, selected), p)
    if p.freeze_beta:
        return hedge.frozen_features(aligned, selected, p), selected
    if p.use_kalman:
        selected = hedge.with_seed(selected, aligned)
        base = hedge.kalman_features(aligned, p, selected)
    else:
        base = features.pair_features(aligned, p)
    # The spread is of anchored prices, the ratios of raw ones, and anchors differ by segment.
    return (_anchored(base, selected, p) if p.normalize_prices else base), selected


def _anchored(base: DataFrame, selected: DataFrame, p: Params) -> DataFrame:
    keys = ("segment_id", "a", "b")
    on = ["a", "b", *(["seed"] if "seed" in base.columns else [])]
    own = features.with_anchors(base.join(selected.select("segment_id", "d0", *on).distinct(), on), keys)
    return features.zscore(features.spread(own, "qa", "qb"), p.roll_win, keys).drop("na", "nb", "qa", "qb", "d0")


def backtest(prices: DataFrame, selected: DataFrame, p: Params = Params(), earnings: DataFrame | None = None, regime: DataFrame | None = None, end: str | None = None) -> Backtest:
    """Trade the pairs selected (segment_id, d0, d1, a, b[, beta, alpha, maintenance, ...])."""
    own, seeded = pair_series(prices, selected, p, end)
    rows = signals.segment_rows(own, seeded)
    blocked = None
    if earnings is not None and p.earnings_blackout_days > 0:
        legs = selected.select(F.explode(F.array("a", "b")).alias("ticker")).distinct()
        blocked = context.blackout(earnings, legs, features.capped(prices, end).select("date").distinct(), p.earnings_blackout_days)
    return Backtest(selected, fold.simulate(signals.gates(rows, p, blocked, regime), p))


@dataclass
class WalkForward:
    labels: DataFrame
    segments: DataFrame
    history: DataFrame
    result: Backtest
    persistence: DataFrame

    def release(self) -> None:
        """Give back what is kept in memory; what is not computed by then is computed anew when asked for."""
        self.result.kept.release()

    def summary(self) -> DataFrame:
        own = self.result.summary().crossJoin(F.broadcast(self.persistence.agg(F.avg("persistence").alias("cluster_persistence"))))
        return own.crossJoin(F.broadcast(self.segments.agg(F.count(F.lit(1)).alias("planned_segments"))))


def walk_forward(
    prices: DataFrame,
    factors: DataFrame,
    p: Params = Params(),
    f: Filters = Filters(),
    c: clusters.ClusterParams = clusters.ClusterParams(),
    refit: int = 21,
    start: str | None = None,
    end: str | None = None,
    earnings: DataFrame | None = None,
    membership: DataFrame | None = None,
    regime: DataFrame | None = None,
    factor_zscores: bool = True,
    neutralize: bool = False,
    labels: DataFrame | None = None,
) -> WalkForward:
    """Labels, pairs and trades by refit date. factors: date, factor, ret (as sources.panels.factor_returns gives). labels:
    segment_id, refit_date, ticker, cluster, if they are not to be computed. A refit date without labels is a KeyError."""
    if earnings is None:
        p = replace(p, earnings_blackout_days=0)
    kept = Kept()
    prices, factors = features.capped(prices, end), features.capped(factors, end)
    own = kept(features.ticker_features(prices))
    days = kept(calendar.calendar(prices))
    parts = kept(calendar.segments(days, refit, calendar.burn_in(c.corr_window, c.beta_window), start))
    if labels is None:
        scored = features.factor_zscore(factors) if factor_zscores else factors.withColumn("z", F.coalesce("ret", F.lit(0.0)))
        control = None
        if c.method in ("c", "c_optics", "c_dbscan"):
            control = panels.control_factors(scored).select("date", "factor", F.col("z").alias("ret"))
        labels = clusters.rolling_labels(own, scored, days, parts, c, control)
    labels = clusters.at_refit(clusters.freeze(labels, c.ari_threshold), parts)
    usable = context.active(labels, membership) if membership is not None else labels
    pairs = kept(discovery.candidates(usable))
    adjust: Callable[[DataFrame], DataFrame] | None = (lambda rows: neutralised(rows, factors)) if neutralize else None
    ranking = discovery.ranking(features.align(own, pairs), days, parts, pairs, f, adjust)
    walked = discovery.walk(ranking, parts, f)
    result = backtest(prices, walked.selected, p, earnings, regime, end)
    result.kept = kept
    return WalkForward(labels, parts, walked.history, result, clusters.persistence(labels))


def neutralised(rows: DataFrame, factors: DataFrame) -> DataFrame:
    """Formation rows whose returns and log prices are less what the market (the mean raw factor return) explains, by one
    regression for each segment and leg."""

    market = factors.groupBy("date").agg(F.avg("ret").alias("m"))
    own = rows.join(market, "date", "left").withColumn("m", F.coalesce("m", F.lit(0.0)))
    whole = Window.partitionBy("segment_id", "a", "b")
    path = whole.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    for r, lp in (("ra", "pa"), ("rb", "pb")):
        slope = F.coalesce(F.regr_slope(r, "m").over(whole), F.lit(0.0))
        own = own.withColumn("_b", slope).withColumn(r, F.col(r) - F.col("_b") * F.col("m")).withColumn(lp, F.sum(F.coalesce(r, F.lit(0.0))).over(path))
    return own.drop("_b", "m")
