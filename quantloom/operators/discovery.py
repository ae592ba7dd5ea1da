"""Pair discovery at refit dates, by public methods: return correlation, Engle-Granger residual test and half-life over a
formation window, all closed forms of sums, so that every (segment, candidate) is one row of one aggregation.

Only the choice among candidates that depends on earlier segments (pairs held over, cap on new ones) is sequential; it
runs on the driver over the few candidates that passed, at most cluster_cap for each cluster and segment.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.params import HISTORY, MAINTENANCE_SHARE, NEW_SHARE, Filters

CORR_ROWS = 63
# MacKinnon (2010) response surface for two variables with a constant: level, 1/T, 1/T^2.
CRITICAL = {0.01: (-3.89644, -10.9519, -22.527), 0.05: (-3.33613, -6.1101, -6.823), 0.10: (-3.04445, -4.2412, -2.720)}


def critical(alpha: float, n: Column) -> Column:
    """The test's critical value at n rows; between the tabulated levels by a straight line in ln alpha."""
    levels = sorted(CRITICAL)
    a = min(max(alpha, levels[0]), levels[-1])
    lo = max(x for x in levels if x <= a)
    hi = min(x for x in levels if x >= a)
    t = 0.0 if hi == lo else (math.log(a) - math.log(lo)) / (math.log(hi) - math.log(lo))
    c = [x + t * (y - x) for x, y in zip(CRITICAL[lo], CRITICAL[hi])]
    return c[0] + c[1] / n + c[2] / (n * n)


def candidates(labels: DataFrame) -> DataFrame:
    """labels: segment_id, ticker, cluster. segment_id, cluster, a, b of every two tickers of one cluster: clusters are
    bounded by the universe, and the list holds names only."""
    own = labels.where("cluster IS NOT NULL")
    x = own.select("segment_id", "cluster", F.col("ticker").alias("a"))
    y = own.select("segment_id", "cluster", F.col("ticker").alias("b"))
    return x.join(y, ["segment_id", "cluster"]).where("a < b")


def formation_rows(aligned: DataFrame, days: DataFrame, segments: DataFrame, formation: int, pairs: DataFrame | None = None) -> DataFrame:
    """aligned rows in each segment's formation window: the `formation` calendar rows up to d0, inclusive; with pairs, only
    of the pairs of each segment, whose list meets the dates before it meets the prices."""
    end = segments.join(days.select(F.col("date").alias("d0"), F.col("rn").alias("rn0")), "d0").select("segment_id", "rn0")
    span = end.select("segment_id", F.explode(F.sequence(F.greatest(F.col("rn0") - formation + 1, F.lit(0)), "rn0")).alias("rn"), "rn0")
    dates = span.join(days, "rn").select("segment_id", "date", (F.col("rn0") - F.col("rn")).alias("age"))
    if pairs is None:
        return aligned.join(dates, "date")
    return aligned.join(dates.join(pairs.select("segment_id", "a", "b").distinct(), "segment_id"), ["a", "b", "date"])


def cluster_rows(features: DataFrame, labels: DataFrame, days: DataFrame, segments: DataFrame, formation: int) -> DataFrame:
    """segment_id, cluster, a, b, date, age, ra, rb of every two tickers of one cluster on the dates of each segment's
    formation window on which both have a price. For universes that grow: series are cut to the windows before they are
    paired, and dealt out by (segment, cluster) once; what is unfolded there into pairs is aggregated where it is."""
    end = segments.join(days.select(F.col("date").alias("d0"), F.col("rn").alias("rn0")), "d0").select("segment_id", "rn0")
    span = end.select("segment_id", F.explode(F.sequence(F.greatest(F.col("rn0") - formation + 1, F.lit(0)), "rn0")).alias("rn"), "rn0")
    dates = span.join(days, "rn").select("segment_id", "date", (F.col("rn0") - F.col("rn")).alias("age"))  # a bounded list
    # By ticker alone, as the series lie: its clusters by segment.
    by_ticker = labels.where("cluster IS NOT NULL").groupBy("ticker").agg(F.map_from_entries(F.collect_set(F.struct("segment_id", "cluster"))).alias("clusters"))
    own = features.where("lp IS NOT NULL").select("ticker", "date", "ret").join(F.broadcast(dates), "date").join(by_ticker, "ticker")
    own = own.select("segment_id", F.col("clusters")[F.col("segment_id")].alias("cluster"), "date", "age", "ticker", "ret").where("cluster IS NOT NULL")
    spread = int(features.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    days_of = own.repartition(spread, "segment_id", "cluster").groupBy("segment_id", "cluster", "date", "age").agg(F.array_sort(F.collect_list(F.struct("ticker", "ret"))).alias("all"))
    left = days_of.select("segment_id", "cluster", "date", "age", "all", F.posexplode("all").alias("i", "x"))
    both = left.select("segment_id", "cluster", "date", "age", "x", F.explode(F.slice("all", F.col("i") + 2, F.size("all"))).alias("y"))
    return both.select("segment_id", "cluster", F.col("x.ticker").alias("a"), F.col("y.ticker").alias("b"), "date", "age", F.col("x.ret").alias("ra"), F.col("y.ret").alias("rb"))


def _correlation() -> Column:
    """Of the returns of the last CORR_ROWS calendar rows, null where a side is constant."""
    recent = F.col("age") < CORR_ROWS
    x, y = F.when(recent & F.col("rb").isNotNull(), F.col("ra")), F.when(recent & F.col("ra").isNotNull(), F.col("rb"))
    return F.try_divide(F.covar_pop(x, y), F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)))


def most_correlated(rows: DataFrame, pairs: DataFrame | None, f: Filters) -> DataFrame:
    """Of the pairs (segment_id, cluster, a, b) the cluster_cap most correlated of each cluster: one aggregate of the last
    CORR_ROWS rows, before anything longer is looked at. Without pairs, rows have a cluster (cluster_rows)."""
    keys = ["segment_id", "a", "b"] if pairs is not None else ["segment_id", "cluster", "a", "b"]
    corr = rows.where(F.col("age") < CORR_ROWS).groupBy(*keys).agg(_correlation().alias("corr63"))
    own = pairs.join(corr, keys) if pairs is not None else corr
    by_corr = Window.partitionBy("segment_id", "cluster").orderBy(F.desc_nulls_last(F.round("corr63", 9)), "a", "b")
    return own.withColumn("corr_rank", F.row_number().over(by_corr)).where(F.col("corr_rank") <= f.cluster_cap).drop("corr63")


def formation_stats(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """For each (segment_id, a, b) of pairs: corr63, beta, alpha, adf (t statistic), half_life, n."""
    keys = ["segment_id", "a", "b"]
    own = rows.join(pairs.select(*keys).distinct(), keys, "left_semi")
    level = own.groupBy(*keys).agg(F.regr_slope("pa", "pb").alias("beta"), F.regr_intercept("pa", "pb").alias("alpha"), _correlation().alias("corr63"))
    own = own.join(level, keys).withColumn("e", F.col("pa") - F.col("beta") * F.col("pb") - F.col("alpha"))
    own = own.withColumn("e1", F.lag("e").over(Window.partitionBy(*keys).orderBy("date"))).withColumn("de", F.col("e") - F.col("e1"))
    n = F.count("de")
    sxx, syy, sxy = F.regr_sxx("de", "e1"), F.regr_syy("de", "e1"), F.regr_sxy("de", "e1")
    slope = F.try_divide(sxy, F.nullif(sxx, F.lit(0.0)))
    rest = F.greatest(syy - slope * sxy, F.lit(0.0))
    se = F.sqrt(F.try_divide(rest, (n - 2).cast("double") * sxx))
    out = own.groupBy(*keys).agg(n.alias("n"), slope.alias("rho"), F.try_divide(slope, F.nullif(se, F.lit(0.0))).alias("adf"), F.first("beta").alias("beta"), F.first("alpha").alias("alpha"), F.first("corr63").alias("corr63"))
    return out.withColumn("half_life", F.when((F.col("rho") < 0) & (F.col("rho") > -1), -math.log(2.0) / F.log(1 + F.col("rho")))).drop("rho")


def judged(stats: DataFrame, f: Filters) -> DataFrame:
    """Adds passes (a new pair may be taken) and passes_held (one held before may stay)."""
    n = F.col("n").cast("double")
    shape = F.col("beta").between(f.min_beta, f.max_beta) & F.col("half_life").between(f.min_hl, f.max_hl)
    new = shape & (F.col("corr63") >= f.min_corr) & (F.col("adf") <= critical(f.adf_alpha, n))
    held = shape & (F.col("corr63") >= f.min_corr - f.maint_corr_slack) & (F.col("adf") <= critical(f.maint_adf_alpha, n))
    false = F.lit(False)
    return stats.withColumn("passes", F.coalesce(new, false)).withColumn("passes_held", F.coalesce(held, false))


def ranked(stats: DataFrame, pairs: DataFrame) -> DataFrame:
    """stats with the clusters of pairs, and pair_rank: the order of each cluster's pairs, those that pass before the
    others, then by the test, then by name."""
    own = stats.join(pairs, ["segment_id", "a", "b"])
    by_test = Window.partitionBy("segment_id", "cluster").orderBy(F.desc("passes"), F.asc_nulls_last(F.round("adf", 9)), "a", "b")
    return own.withColumn("pair_rank", F.row_number().over(by_test))


def ranking(aligned: DataFrame, days: DataFrame, segments: DataFrame, pairs: DataFrame, f: Filters, adjust: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The ranked candidates of every segment: correlation first, and the regression and residual test only for the pairs
    that the cap leaves. adjust: what is done to formation rows before they are looked at; it needs whole windows."""
    rows = lambda own, n: formation_rows(aligned, days, segments, n, own)
    best = most_correlated(adjust(rows(pairs, f.formation)) if adjust else rows(pairs, min(f.formation, CORR_ROWS)), pairs, f)
    formed = rows(best, f.formation)
    return ranked(judged(formation_stats(adjust(formed) if adjust else formed, best), f), best)


def top_pairs(ranking: DataFrame, f: Filters) -> DataFrame:
    return ranking.where(F.col("passes") & (F.col("pair_rank") <= f.top_k))


def most_new(held: int, top_k: int) -> int:
    """How many new pairs a segment may take beside so many held over."""
    return max(int(held / MAINTENANCE_SHARE * NEW_SHARE) + 1, top_k)


@dataclass
class Walk:
    """selected: the pairs traded in each segment: segment_id, d0, d1, a, b, beta, alpha, cluster, pair_rank, maintenance.
    history: for each segment with pairs and each pair seen so far: segment_id, pair, passed (it is traded), passes (in the
    last HISTORY such segments), held_over (it may stay in the next one by the looser test)."""

    selected: DataFrame
    history: DataFrame


def walk(ranking: DataFrame, segment_table: DataFrame, f: Filters) -> Walk:
    """Segments are taken in order. A pair that passed in maint_passes of the last HISTORY segments with pairs, and passes
    the looser test, is held over beyond top_k; new ones follow under the cap. Segments without pairs leave no mark."""
    spark = ranking.sparkSession
    # Names and numbers of the pairs that pass: at most cluster_cap for each cluster and segment.
    rows = ranking.where(F.col("passes") | F.col("passes_held")).select("segment_id", "cluster", "a", "b", "beta", "alpha", "passes", "passes_held", "pair_rank").toPandas()
    history: dict[tuple[str, str], list[bool]] = {}
    chosen: list[tuple] = []
    seen: list[tuple] = []
    for segment, own in sorted(rows.groupby("segment_id"), key=lambda x: x[0]):
        held = {k for k, h in history.items() if sum(h) >= f.maint_passes}
        names = list(zip(own["a"], own["b"]))
        own = own.assign(maintenance=[bool(n in held and ok) for n, ok in zip(names, own["passes_held"])])
        new = own[~own["maintenance"] & own["passes"] & (own["pair_rank"] <= f.top_k)].sort_values(["pair_rank", "a", "b"])
        kept = own[own["maintenance"]].sort_values(["a", "b"])
        book = pd.concat([kept, new.head(most_new(len(kept), f.top_k))])
        if book.empty:
            continue
        chosen += [(int(segment), r.a, r.b, r.beta, r.alpha, int(r.cluster), int(r.pair_rank), bool(r.maintenance)) for r in book.itertuples()]
        now = set(zip(book["a"], book["b"]))
        for k in now | set(history):
            history[k] = [*history.get(k, []), k in now][-HISTORY:]
        seen += [(int(segment), "|".join(k), k in now, sum(h), sum(h) >= f.maint_passes) for k, h in sorted(history.items())]
    schema = "segment_id int, a string, b string, beta double, alpha double, cluster int, pair_rank int, maintenance boolean"
    selected = spark.createDataFrame(chosen, schema).join(segment_table, "segment_id")
    return Walk(selected, spark.createDataFrame(seen, "segment_id int, pair string, passed boolean, passes long, held_over boolean"))
