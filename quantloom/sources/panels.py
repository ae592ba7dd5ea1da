"""Scans into long tables: prices(date, ticker, close, volume), factor_returns(date, factor, ret), cluster labels,
earnings, membership and regime. Every scan casts dates to DATE and turns not-a-number into null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.functions.rolling import finite

FACTOR_SOURCES = {"etf_only": ("etf",), "ff_fred_first": ("ff", "fred"), "both": ("ff", "fred", "etf")}


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.option("header", True).csv(path) if kind == "csv" else reader.parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on any file system Spark reads."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def _number(c: str) -> Column:
    return finite(F.col(c).cast("double")).alias(c)


def prices(raw: DataFrame) -> DataFrame:
    volume = _number("volume") if "volume" in raw.columns else F.lit(None).cast("double").alias("volume")
    return raw.select(F.col("date").cast("date").alias("date"), F.col("ticker").cast("string").alias("ticker"), _number("close"), volume)


def factor_returns(raw: DataFrame, source: str | None = None, drop: tuple[str, ...] = ("FF_RF",)) -> DataFrame:
    """One or several factor sets; with a `source` column only the sets of the source named (a partition filter)."""
    if source and "source" in raw.columns:
        raw = raw.where(F.col("source").isin(*FACTOR_SOURCES[source]))
    return raw.where(~F.col("factor").isin(*drop)).select(F.col("date").cast("date").alias("date"), "factor", _number("ret"))


def control_factors(factors: DataFrame) -> DataFrame:
    """The market factor alone where there is one, else all."""
    has = not factors.where(F.col("factor") == "SPY").isEmpty()
    return factors.where(F.col("factor") == "SPY") if has else factors


def optional(spark: SparkSession, path: str | None, reader) -> DataFrame | None:
    """The table, or None (the feature that needs it is off) where its file is missing."""
    if not path or not exists(spark, path):
        return None
    return reader(spark.read.parquet(path))


def earnings(raw: DataFrame) -> DataFrame:
    return raw.select("ticker", F.col("earnings_date").cast("date").alias("earnings_date")).where("earnings_date IS NOT NULL")


def membership(raw: DataFrame) -> DataFrame:
    return raw.select("ticker", F.col("start_date").cast("date").alias("start_date"), F.col("end_date").cast("date").alias("end_date")).where("ticker IS NOT NULL")


def regime(raw: DataFrame, calm: float = 1.0, stressed: float = 0.5, crisis: float = 0.0) -> DataFrame:
    """date, scale. A table of states (calm, stressed, crisis, or 0, 1, 2) is mapped to its weights."""
    if "scale" in raw.columns:
        return raw.select(F.col("date").cast("date").alias("date"), _number("scale"))
    state = F.lower(F.col("state").cast("string"))
    scale = F.when(state.isin("calm", "0"), calm).when(state.isin("stressed", "1"), stressed).when(state.isin("crisis", "2"), crisis)
    return raw.select(F.col("date").cast("date").alias("date"), scale.cast("double").alias("scale"))


def required_regime(spark: SparkSession, path: str, **weights: float) -> DataFrame:
    if not exists(spark, path):
        raise FileNotFoundError(f"regime overlay asked for, but {path} is missing")
    return regime(spark.read.parquet(path), **weights)
