"""Hedge ratios other than the rolling one: Kalman filter (a sequential recursion, so a grouped map over each pair's
history) and ratios frozen at pair selection."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.rolling import by
from quantloom.operators import features
from quantloom.params import Params

SCALE_ROWS = 30
SEED_ROWS = 63
TINY = 1e-8


def seed_rows(n: int) -> int:
    """Rows that the filter is seeded from, of a history of n."""
    return min(SEED_ROWS, max(20, n // 4))


def kalman_path(y: np.ndarray, x: np.ndarray, delta: float, m: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """beta, alpha and beta's deviation for each row. State: scaled slope and intercept, both random walks, seeded from the
    first m rows; the slope's regressor is x over its trailing mean. The two-state algebra is written out, with the
    covariance as four numbers."""
    n = len(y)
    m = seed_rows(n) if m is None else m
    total = np.concatenate([[0.0], np.cumsum(x)])
    at = np.arange(1, n + 1)
    lo = np.maximum(0, at - SCALE_ROWS)
    scale = (total[at] - total[lo]) / (at - lo)
    scale = np.where(np.abs(scale) < 1e-6, 1.0, scale)
    h = x / scale
    design = np.column_stack([h[:m], np.ones(min(m, n))])
    state = np.linalg.lstsq(design, y[:m], rcond=None)[0]
    rest = y[:m] - design @ state
    noise = float(rest.var() + TINY)
    cov = noise * np.linalg.inv(design.T @ design + TINY * np.eye(2))
    # The covariance update below is not symmetrised, so both off-diagonal numbers are carried.
    p11, p12, p21, p22 = cov[0, 0], cov[0, 1], cov[1, 0], cov[1, 1]
    slope, level = float(state[0]), float(state[1])
    recent = list(rest[-SCALE_ROWS:] ** 2)
    beta, alpha, std = np.empty(n), np.empty(n), np.empty(n)
    for t in range(n):
        p11 += delta
        p22 += delta
        ht = h[t]
        gap = y[t] - (ht * slope + level)
        recent.append(gap * gap)
        del recent[:-SCALE_ROWS]
        g1, g2 = p11 * ht + p12, p21 * ht + p22
        total_var = ht * g1 + g2 + sum(recent) / len(recent) + TINY
        k1, k2 = g1 / total_var, g2 / total_var
        slope += k1 * gap
        level += k2 * gap
        p11, p12, p21, p22 = p11 - k1 * (ht * p11 + p21), p12 - k1 * (ht * p12 + p22), p21 - k2 * (ht * p11 + p21), p22 - k2 * (ht * p12 + p22)
        beta[t], alpha[t], std[t] = slope / scale[t], level, np.sqrt(max(p11, 0.0)) / scale[t]
    return beta, alpha, std


def with_seed(selected: DataFrame, aligned: DataFrame) -> DataFrame:
    """Adds seed to the pairs of segments: the rows the filter is seeded from, by the history up to the segment's end. Only
    a pair's first 4 * SEED_ROWS dates bear on it: from then on it is SEED_ROWS."""
    most = 4 * SEED_ROWS
    own = aligned.withColumn("_n", F.row_number().over(by("a", "b"))).where(F.col("_n") <= most)
    dates = own.groupBy("a", "b").agg(F.collect_list("date").alias("_dates"))
    n = F.size(F.filter("_dates", lambda d: d <= F.col("d1")))
    return selected.join(dates, ["a", "b"]).withColumn("seed", F.least(F.lit(SEED_ROWS), F.greatest(F.lit(20), F.floor(n / 4).cast("int")))).drop("_dates")


def kalman(aligned: DataFrame, delta: float, selected: DataFrame | None = None) -> DataFrame:
    """Adds beta, alpha, beta_std and seed. One group is one pair's history: bounded by the calendar. selected: with seed;
    a pair has a path for each seed that its segments have, at most SEED_ROWS - 19. Without it, one seeded by its whole
    history."""
    names = aligned.columns
    own = aligned.withColumn("_seeds", F.lit(None).cast("array<int>"))
    if selected is not None:
        own = aligned.join(selected.groupBy("a", "b").agg(F.array_sort(F.collect_set("seed")).alias("_seeds")), ["a", "b"])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("date", kind="stable")
        seeds = frame["_seeds"].iloc[0]
        out = []
        for m in [seed_rows(len(frame))] if seeds is None else seeds:
            part = frame[names].copy()
            part["beta"], part["alpha"], part["beta_std"] = kalman_path(frame["pa"].to_numpy(float), frame["pb"].to_numpy(float), delta, int(m))
            part["seed"] = np.int32(m)
            out.append(part)
        return pd.concat(out)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in aligned.schema.fields)
    return own.groupBy("a", "b").applyInPandas(run, f"{schema}, beta double, alpha double, beta_std double, seed int")


def kalman_features(aligned: DataFrame, p: Params, selected: DataFrame | None = None) -> DataFrame:
    """Pair series of Kalman ratios by (a, b, seed); unc is yesterday's relative uncertainty of beta, null where it cannot
    be told."""
    keys = ("a", "b", "seed")
    own = features.pair_returns(features.spread(kalman(aligned, p.kalman_delta, selected)), p.roll_win, keys)
    own = features.zscore(own, p.roll_win, keys)
    unc = F.when(F.abs("beta1") > 1e-6, F.lag("beta_std").over(by(*keys)) / F.abs("beta1"))
    return own.withColumn("unc", unc).drop("beta_std")


def frozen_features(aligned: DataFrame, selected: DataFrame, p: Params) -> DataFrame:
    """Pair series by segment with the ratios of the pairs table (segment_id, d0, a, b, beta, alpha; of several rows of a
    pair the one of the least pair_rank, beta and alpha counts, and 1 and 0 stand in for missing ones). With
    freeze_spread_stats mu and sd are those of all lagged spreads before the segment. Keys are (segment_id, a, b): these
    series do depend on the segment."""
    keys = ("segment_id", "a", "b")
    first = Window.partitionBy(*keys).orderBy(*[F.asc_nulls_last(c) for c in ("pair_rank", "beta", "alpha") if c in selected.columns] or [F.lit(0)])
    chosen = selected.withColumn("_r", F.row_number().over(first)).where("_r = 1")
    value = lambda c, other: (F.coalesce(F.col(c), F.lit(other)) if c in selected.columns else F.lit(other)).alias(c)
    chosen = chosen.select(*keys, "d0", value("beta", 1.0), value("alpha", 0.0))
    own = aligned.join(chosen, ["a", "b"])
    if p.normalize_prices:
        own = features.with_anchors(own, keys)
        own = features.spread(own, "qa", "qb").drop("na", "nb", "qa", "qb")
    else:
        own = features.spread(own)
    own = features.pair_returns(own, p.roll_win, keys)
    if p.freeze_spread_stats:
        own = own.withColumn("s1", F.lag("s").over(by(*keys)))
        early = F.when(F.col("date") < F.col("d0"), F.col("s1"))
        whole = Window.partitionBy(*keys)
        own = own.withColumn("_n", F.count(early).over(whole))
        own = own.withColumn("mu", F.when(F.col("_n") >= 5, F.avg(early).over(whole)).otherwise(0.0))
        own = own.withColumn("sd", F.when(F.col("_n") >= 5, F.nullif(F.stddev_samp(early).over(whole), F.lit(0.0)))).drop("_n", "s1")
        own = own.withColumn("z", F.try_divide(F.col("s") - F.col("mu"), F.col("sd")))
    else:
        own = features.zscore(own, p.roll_win, keys)
    return own.withColumn("unc", F.lit(None).cast("double")).drop("d0")
