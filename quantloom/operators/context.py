"""Point-in-time context: earnings blackouts, index membership, regime scale."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def blackout(earnings: DataFrame, tickers: DataFrame, days: DataFrame, n: int) -> DataFrame:
    """ticker, date: trading dates within n calendar days of an earnings date. The range join is an explode of 2n + 1
    dates and an equi join."""
    own = earnings.join(tickers.select("ticker").distinct(), "ticker", "left_semi").where("earnings_date IS NOT NULL")
    own = own.select("ticker", F.explode(F.sequence(F.date_add("earnings_date", -n), F.date_add("earnings_date", n))).alias("date")).distinct()
    return own.join(days.select("date"), "date", "left_semi").select("ticker", "date")


def with_blackout(rows: DataFrame, blocked: DataFrame | None) -> DataFrame:
    """Adds blk: either leg is in its blackout."""
    if blocked is None:
        return rows.withColumn("blk", F.lit(False))
    hit = lambda leg: blocked.select(F.col("ticker").alias(leg), "date", F.lit(True).alias(f"_{leg}"))
    own = rows.join(hit("a"), ["a", "date"], "left").join(hit("b"), ["b", "date"], "left")
    return own.withColumn("blk", F.coalesce("_a", F.lit(False)) | F.coalesce("_b", F.lit(False))).drop("_a", "_b")


def active(labels: DataFrame, membership: DataFrame) -> DataFrame:
    """Rows of labels (refit_date, ticker) whose ticker is a member on the date."""
    m = membership.alias("m")
    on = (labels["ticker"] == F.col("m.ticker")) & (F.col("m.start_date") <= labels["refit_date"]) & (F.col("m.end_date").isNull() | (F.col("m.end_date") >= labels["refit_date"]))
    return labels.join(m, on, "left_semi")


def with_regime(rows: DataFrame, regime: DataFrame | None) -> DataFrame:
    """Adds rscale: the scale of the very date, 1 where there is none."""
    if regime is None:
        return rows.withColumn("rscale", F.lit(1.0))
    own = rows.join(regime.select("date", F.col("scale").alias("_scale")), "date", "left")
    return own.withColumn("rscale", F.coalesce(F.when(~F.isnan("_scale"), F.col("_scale")), F.lit(1.0))).drop("_scale")
