"""Operator 1, token counts: an exact histogram of encoded lengths answers every context limit by suffix sums.

Each text is encoded once; only its length leaves the worker. The histogram (one row for each distinct length) is
pre-aggregated on the map side, and written, as it is looked at several times. Suffix sums are taken in two levels, within
blocks of lengths and over blocks, so no single task has to see the whole histogram in order.

Nulls and empty texts have length 0 and count as documents. Very long texts are encoded whole, one at a time. Repeated
rows count as often as they occur. An empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.common import text_of, written
from quantloom.llm.tokens import encoding, ranks_path

#: Lengths that share a block of the two-level suffix sum.
BLOCK = 512


def token_length(path: str) -> Column:
    @F.arrow_udf("long")
    def length(texts: pa.Array) -> pa.Array:
        encode = encoding(path).encode_ordinary
        return pa.array((len(encode(t.as_py())) for t in texts), pa.int64())

    return length


def length_histogram(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """n_tokens long, n_docs long: one row for each length that occurs; written to the shared folder."""
    length = token_length(path or ranks_path())
    counts = docs.select(length(text_of(docs, text)).alias("n_tokens")).groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))
    return written(counts, "lengths")


def context_table(histogram: DataFrame, block: int = BLOCK) -> DataFrame:
    """For each length that occurs, read as a context limit: docs_ge and tokens_ge (documents and their tokens at or
    above the limit), docs_le, total_docs, total_tokens, truncated_tokens (sum of min(length, limit)), and quantile
    (share of documents at or below)."""
    own = histogram.withColumn("block", F.floor(F.col("n_tokens") / block).cast("long")).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    sums = own.groupBy("block").agg(F.sum("n_docs").alias("b_docs"), F.sum("tokens").alias("b_tokens"))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    above = sums.select(
        "block", F.coalesce(F.sum("b_docs").over(after), zero).alias("docs_above"), F.coalesce(F.sum("b_tokens").over(after), zero).alias("tokens_above"),
        F.sum("b_docs").over(whole).alias("total_docs"), F.sum("b_tokens").over(whole).alias("total_tokens"),
    )
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    out = (
        own.join(above, "block")
        .withColumn("docs_ge", F.sum("n_docs").over(inside) + F.col("docs_above"))
        .withColumn("tokens_ge", F.sum("tokens").over(inside) + F.col("tokens_above"))
    )
    docs_le = F.col("total_docs") - F.col("docs_ge") + F.col("n_docs")
    return out.select(
        "n_tokens", "n_docs", "docs_ge", "tokens_ge", docs_le.alias("docs_le"), "total_docs", "total_tokens",
        (F.col("total_tokens") - F.col("tokens_ge") + F.col("n_tokens") * F.col("docs_ge")).alias("truncated_tokens"),
        F.try_divide(docs_le, "total_docs").alias("quantile"),
    )


def limits(histogram: DataFrame, wanted: list[int]) -> DataFrame:
    """Answers for any context limits, also those no document has: context_limit, docs_over (longer ones),
    truncated_tokens. A limit is a length of no documents among those that occur, so the same suffix sums answer it."""
    asked = histogram.sparkSession.createDataFrame([(int(x),) for x in dict.fromkeys(wanted)], "context_limit long")
    both = histogram.select("n_tokens", "n_docs").unionByName(asked.select(F.col("context_limit").alias("n_tokens"), F.lit(0).cast("long").alias("n_docs")))
    own = context_table(both.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs")))
    return own.join(asked, F.col("n_tokens") == F.col("context_limit")).select("context_limit", (F.col("docs_ge") - F.col("n_docs")).alias("docs_over"), "truncated_tokens")


def op1(docs: DataFrame) -> DataFrame:
    return context_table(length_histogram(docs))
