"""An extension for live use: daily portfolio sums over a stream of pair rows, with late rows bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def portfolio_stream(rows: DataFrame, late: str = "2 days") -> DataFrame:
    """rows: a stream of segment_id, date, pnl, cost (as operators.fold.pair_daily gives). segment_id, date, pnl, cost,
    pnl_gross, each emitted once no row for its date can come any more."""
    own = rows.withColumn("at", F.col("date").cast("timestamp")).withWatermark("at", late)
    out = own.groupBy("segment_id", F.window("at", "1 day")).agg(F.sum("pnl").alias("pnl"), F.sum("cost").alias("cost"))
    return out.select("segment_id", F.col("window.start").cast("date").alias("date"), "pnl", "cost", (F.col("pnl") + F.col("cost")).alias("pnl_gross"))
