"""Refit dates and trading segments from the calendar of returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def calendar(prices: DataFrame) -> DataFrame:
    """date, rn (from 0). One row for each trading date: a bounded list, whatever the number of tickers."""
    return prices.select("date").distinct().select("date", (F.row_number().over(Window.orderBy("date")) - 1).cast("long").alias("rn"))


def burn_in(corr_window: int = 126, beta_window: int = 252) -> int:
    return max(corr_window, beta_window)


def segments(days: DataFrame, refit: int = 21, burn: int = 252, start: str | None = None) -> DataFrame:
    """segment_id, d0, d1: from every refit-th date on; d1 is the next refit date, for the last segment the last date."""
    last = days.agg(F.max("date").alias("last"))
    own = days.where((F.col("rn") >= burn) & (F.pmod(F.col("rn") - burn, F.lit(refit)) == 0))
    if start:
        own = own.where(F.col("date") >= F.lit(start).cast("date"))
    w = Window.orderBy("date")
    own = own.crossJoin(F.broadcast(last))  # one row: an aggregate without keys
    return own.select((F.row_number().over(w) - 1).cast("int").alias("segment_id"), F.col("date").alias("d0"), F.coalesce(F.lead("date").over(w), "last").alias("d1"))
