"""Connected components of a graph given as pairs, by alternating large-star and small-star steps.

Every step is a pre-aggregated groupBy and a join whose both sides are shuffled, so that Spark can split the rows of a
hub. The pairs after each round are written to the shared folder; nothing but counts reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import written

ROUNDS = 60
_MARK = 0x5DEECE66D


def own_side(c: str) -> Column:
    """A key made anew, so that a join shuffles this side even where it is grouped by c already: only a join with two
    shuffled sides has its skewed partitions split."""
    return F.col(c).bitwiseXOR(F.lit(_MARK))


def spread_join(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """left and right joined on a long column, both sides shuffled."""
    l, r = left.withColumn("_k", own_side(on)), right.withColumn("_k", own_side(on)).drop(on)
    return l.join(r, "_k", how).drop("_k")


def _star(near: DataFrame, keep: Column) -> DataFrame:
    """near: u, v. Links every v that keep admits, and u itself, to the least of u and its neighbours."""
    least = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    rows = spread_join(near, least, "u")
    far = rows.where(keep).select(F.col("v").alias("a"), F.col("m").alias("b"))
    return far.where("a != b")


def components(pairs: DataFrame, like: DataFrame | None = None) -> DataFrame:
    """pairs: a long, b long. Returns id, component: the least id reachable, for every id in a pair of two ids. like: see
    written()."""
    edges = written(pairs.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", like)
    last = None
    for _ in range(ROUNDS):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _star(both, F.col("v") > F.col("u")).distinct()
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        rest = spread_join(down, least, "u").where("v != m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        edges = written(rest.unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct(), "edges", like)
        # A star forest: nothing moves any more once the same edges come out again.
        now = tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())
        if now == last:
            ids = edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionAll(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
            return written(ids, "components", like)
        last = now
    raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
