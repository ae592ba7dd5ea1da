"""Portfolio series and performance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.params import YEAR


def portfolio_daily(daily: DataFrame) -> DataFrame:
    """segment_id, date, pnl, cost, pnl_gross over all pairs that traded. A boundary date has a row in both segments."""
    return daily.groupBy("segment_id", "date").agg(F.sum("pnl").alias("pnl"), F.sum("cost").alias("cost")).withColumn("pnl_gross", F.col("pnl") + F.col("cost"))


def with_defaults(portfolio: DataFrame) -> DataFrame:
    """pnl, cost, pnl_gross as columns, 0 where the input lacks them."""
    for c in ("pnl", "cost", "pnl_gross"):
        if c not in portfolio.columns:
            portfolio = portfolio.withColumn(c, F.lit(0.0))
    return portfolio


def equity(portfolio: DataFrame) -> DataFrame:
    """Adds equity, equity_gross, peak (the first value is the first peak) and drawdown. The portfolio has a row a day
    and segment, so one ordered window is bounded by the calendar."""
    w = Window.orderBy("date", "segment_id").rowsBetween(Window.unboundedPreceding, 0)
    own = with_defaults(portfolio).withColumn("equity", F.sum("pnl").over(w)).withColumn("equity_gross", F.sum("pnl_gross").over(w))
    own = own.withColumn("peak", F.max("equity").over(w))
    return own.withColumn("drawdown", F.col("equity") - F.col("peak"))


def performance(portfolio: DataFrame) -> DataFrame:
    """One row: annualised mean, deviation and Sharpe ratio, net and gross, and the largest drawdown."""
    sd = lambda c: F.stddev_samp(c) * F.sqrt(F.lit(float(YEAR)))
    sharpe = lambda c: F.when(sd(c) > 0, F.try_divide(F.avg(c) * YEAR, F.nullif(sd(c), F.lit(0.0))))
    return equity(portfolio).agg(
        (F.avg("pnl") * YEAR).alias("ann_mu"), sd("pnl").alias("ann_sd"), sharpe("pnl").alias("sharpe"),
        (F.avg("pnl_gross") * YEAR).alias("ann_mu_gross"), sharpe("pnl_gross").alias("sharpe_gross"), F.min("drawdown").alias("max_drawdown"),
        F.count(F.lit(1)).alias("days"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
    )


def trade_totals(stats: DataFrame) -> DataFrame:
    """One row: round trips, and unweighted means over pair-segments that skip missing ones."""
    return stats.agg(F.coalesce(F.sum("round_trips"), F.lit(0)).cast("long").alias("total_round_trips"), F.avg("avg_hold_days").alias("avg_hold_days"), F.avg("hit_rate").alias("avg_hit_rate"))


def attach_stats(selected: DataFrame, stats: DataFrame) -> DataFrame:
    return selected.withColumn("pair", F.concat_ws("|", "a", "b")).join(stats, ["segment_id", "pair"], "left")


def diagnostics(selected: DataFrame) -> DataFrame:
    """One row: pairs in all, distinct ones, pairs held over, segments with pairs."""
    pair = F.concat_ws("|", "a", "b")
    held = F.sum(F.col("maintenance").cast("int")) if "maintenance" in selected.columns else F.lit(0)
    return selected.agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct(pair).alias("unique_pairs"), F.coalesce(held, F.lit(0)).cast("long").alias("maintenance"), F.count_distinct("segment_id").alias("segments"))


def pair_overlap(selected: DataFrame) -> DataFrame:
    """For each segment with pairs and the next such one: shared pairs over pairs of the later. Segments without pairs
    are passed over."""
    own = selected.select("segment_id", F.concat_ws("|", "a", "b").alias("pair")).distinct()
    order = own.select("segment_id").distinct().select("segment_id", F.row_number().over(Window.orderBy("segment_id")).alias("ord"))
    own = own.join(order, "segment_id")
    size = own.groupBy("ord").agg(F.count(F.lit(1)).alias("n"))
    earlier = own.select((F.col("ord") + 1).alias("ord"), "pair")
    shared = own.join(earlier, ["ord", "pair"], "left_semi").groupBy("ord").agg(F.count(F.lit(1)).alias("k"))
    out = size.where("ord > 1").join(shared, "ord", "left").join(order, "ord")
    return out.select("segment_id", F.col("n").alias("pairs"), F.coalesce("k", F.lit(0)).cast("long").alias("shared"), (F.coalesce("k", F.lit(0)) / F.col("n")).alias("overlap"))
