"""Per-ticker and per-pair series: returns, average dollar volume, factor z-scores, alignment of two legs, rolling hedge
ratios, spreads, z-scores and pair volatility.

Pair series depend on (pair, date) alone, not on the segment in which a pair is traded, so they are computed once for all
segments. After the legs are joined, one exchange and one sort by (a, b, date) serve every window below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.rolling import by, gated, rolling_mean, rolling_std, trailing
from quantloom.operators import calendar
from quantloom.params import ADV_WINDOW, Params

PAIR = ("a", "b")


def capped(df: DataFrame, end: str | None) -> DataFrame:
    """Rows up to the end date, inclusive: pushed below every window, to the scan."""
    return df.where(F.col("date") <= F.lit(end).cast("date")) if end else df


def over_days(key: str, n: int):
    """The rows of the last n days of the calendar (column rn): a day on which the key has no row counts as missing."""
    return Window.partitionBy(key).orderBy("rn").rangeBetween(-(n - 1), 0)


def ticker_features(prices: DataFrame, adv_window: int = ADV_WINDOW) -> DataFrame:
    """Adds lp (log price, null unless positive), ret (change from the last known close) and adv (mean dollar volume of the
    last adv_window days of the calendar of all tickers, null unless it is known on each)."""
    w = by("ticker")
    # The frame is unbounded: one with a bound, however far, is gone through anew for each row.
    last = F.last("close", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    own = prices.join(F.broadcast(calendar.calendar(prices)), "date").withColumn("last", last)  # a bounded list of dates
    own = own.withColumn("lp", F.when(F.col("close") > 0, F.log("close"))).withColumn("ret", F.try_divide(F.coalesce("close", "last"), F.nullif("last", F.lit(0.0))) - 1)
    own = own.drop("last").withColumn("dollars", F.col("close") * F.col("volume"))
    over = over_days("ticker", adv_window)
    return own.withColumn("adv", gated(F.avg("dollars"), over, adv_window, "dollars")).drop("dollars", "rn")


def factor_zscore(factors: DataFrame, window: int = 252, least: int = 63) -> DataFrame:
    """Adds z: the last value against its window of calendar days; 0 where it or the window is missing."""
    own = factors.join(calendar.calendar(factors), "date")
    over = over_days("factor", window)
    z = (F.col("ret") - F.avg("ret").over(over)) / (F.stddev_samp("ret").over(over) + 1e-8)
    return own.withColumn("z", F.coalesce(F.when((F.count("ret").over(over) >= least) & F.col("ret").isNotNull(), z), F.lit(0.0))).drop("rn")


def all_pairs(tickers: DataFrame) -> DataFrame:
    """a, b of every two tickers, a < b: unfolded from one sorted list of names, no price rows and no join."""
    names = tickers.agg(F.array_sort(F.collect_set("ticker")).alias("names"))
    each = names.select("names", F.posexplode("names").alias("i", "a"))
    return each.select("a", F.explode(F.slice("names", F.col("i") + 2, F.size("names"))).alias("b"))


def align(features: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, date, pa, pb, ra, rb, adva, advb for dates on which both legs have a price."""
    own = features.where("lp IS NOT NULL")
    left = own.select(F.col("ticker").alias("a"), "date", F.col("lp").alias("pa"), F.col("ret").alias("ra"), F.col("adv").alias("adva"))
    right = own.select(F.col("ticker").alias("b"), "date", F.col("lp").alias("pb"), F.col("ret").alias("rb"), F.col("adv").alias("advb"))
    # Pairs meet the first leg, then the second by (ticker, date): two equi joins, nothing quadratic in the dates. The
    # short list of pairs is dealt out by (a, b) first: where the legs are broadcast, the joined rows are in place for
    # the windows over (a, b) then, and only the list has been shuffled.
    spread = int(features.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pairs.select("a", "b").distinct().repartition(spread, "a", "b").join(left, "a").join(right, ["b", "date"]).select("a", "b", "date", "pa", "pb", "ra", "rb", "adva", "advb")


def long_enough(aligned: DataFrame, p: Params) -> DataFrame:
    """Pairs that ever have enough common rows, with ready: the date from which on they have. A segment that ends before
    that date does not trade the pair (see signals.segment_rows): what comes after a segment decides nothing in it."""
    whole = Window.partitionBy(*PAIR)
    own = aligned.withColumn("_n", F.row_number().over(whole.orderBy("date")))
    return own.withColumn("ready", F.max(F.when(F.col("_n") == p.history_rows, F.col("date"))).over(whole)).where("ready IS NOT NULL").drop("_n")


def rolling_ols(aligned: DataFrame, window: int) -> DataFrame:
    """Adds beta, alpha: least squares of pa on pb over the window; null before it is full, and over a constant leg."""
    over = trailing(by(*PAIR), window)
    fit = lambda f: gated(f("pa", "pb"), over, window, "pa")
    return aligned.withColumn("beta", fit(F.regr_slope)).withColumn("alpha", fit(F.regr_intercept))


def spread(hedged: DataFrame, a: Column | str = "pa", b: Column | str = "pb") -> DataFrame:
    value = lambda x: F.col(x) if isinstance(x, str) else x
    return hedged.withColumn("s", value(a) - (F.col("beta") * value(b) + F.col("alpha")))


def zscore(spreads: DataFrame, window: int, keys: tuple[str, ...] = PAIR) -> DataFrame:
    """Adds mu, sd (of the spreads before today) and z."""
    w = by(*keys)
    own = spreads.withColumn("mu", rolling_mean("s", w, window, 1)).withColumn("sd", rolling_std("s", w, window, 1))
    return own.withColumn("z", F.try_divide(F.col("s") - F.col("mu"), F.col("sd")))


def pair_returns(hedged: DataFrame, window: int, keys: tuple[str, ...] = PAIR) -> DataFrame:
    """Adds beta1 (yesterday's beta), rp (return hedged with it) and sigma (its deviation up to yesterday)."""
    w = by(*keys)
    own = hedged.withColumn("beta1", F.lag("beta").over(w)).withColumn("rp", F.col("ra") - F.col("beta1") * F.col("rb"))
    return own.withColumn("sigma", rolling_std("rp", w, window, 1))


def pair_features(aligned: DataFrame, p: Params) -> DataFrame:
    """All series of rolling hedge ratios: one exchange, one sort."""
    own = pair_returns(spread(rolling_ols(aligned, p.roll_win)), p.roll_win)
    return zscore(own, p.roll_win).withColumn("unc", F.lit(None).cast("double"))


def with_anchors(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """rows: with d0. Adds na, nb: log prices on the last row before d0, else on the first; and qa, qb: the log prices
    divided by them, null where that is 0."""
    whole = Window.partitionBy(*keys)
    before = F.when(F.col("date") < F.col("d0"), F.col("date"))
    own = rows
    for leg in ("a", "b"):
        at = F.coalesce(F.max_by(f"p{leg}", before).over(whole), F.min_by(f"p{leg}", "date").over(whole))
        own = own.withColumn(f"n{leg}", at).withColumn(f"q{leg}", F.try_divide(f"p{leg}", F.nullif(F.col(f"n{leg}"), F.lit(0.0))))
    return own


def vol_weight(features: DataFrame, p: Params) -> DataFrame:
    """Adds w: target volatility over sigma, scaled down where a leg's share of its dollar volume passes the cap."""
    w0 = F.try_divide(F.lit(p.target_spread_vol_bps / 1e4), "sigma")
    if not p.enable_adv_cap:
        return features.withColumn("w", w0)
    part = lambda adv: F.when(F.col(adv) > 0, w0 * p.portfolio_notional_usd / F.col(adv))
    most = F.greatest(part("adva"), part("advb"))  # skips a leg without volume
    return features.withColumn("w", w0 * F.coalesce(F.least(F.lit(1.0), F.try_divide(F.lit(p.adv_cap_pct), F.nullif(most, F.lit(0.0)))), F.lit(1.0)))
