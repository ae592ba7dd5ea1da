"""The text pipeline: documents go through five operators, and each stage works on all that the one before kept.

1. toxicity (operator 4): documents scored as toxic go. Learns from the labels of documents that are there.
2. exact dedup (3): of documents equal but for white space, the longest stays, ties to the smallest id.
3. near dedup (8): one document of each component of near-duplicates (five-word shingles, similarity 0.8) stays.
4. secrets (9): every span found is replaced by a mark; n_chars follows. No document goes.
5. packing (5): the rows of the packed pieces, as the packing operator gives them.

Stages 1 to 4 return the columns they were given. Rows are judged by their text, each by itself: rows that repeat an id
with other texts stay or go as other documents do, of rows that repeat an id and its text one stays. Rows with a null id
are never linked as near duplicates. Null and empty texts are not toxic, equal to each other in stage 2, and pack as an
end token. Very long texts are read whole. An empty table gives an empty table at each stage.
"""

from __future__ import annotations

import atexit
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm import chunk_dedup, near_dup, packing, secret_scan, toxicity
from quantloom.llm.common import remove, saved, scratch, table, written


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    names = docs.columns
    scored = toxicity.score(model, docs.select(F.struct(*names).alias("row"), "text"))
    return scored.where(F.col("score") < toxicity.THRESHOLD).select("row.*")


def thinned(docs: DataFrame, judge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of docs that stay. judge: doc_id, _h, kept for each row of (doc_id, text, _h), where _h is a hash of the text.
    Rows are told apart by id and hash, so that no row has to be numbered and no text written for it; of rows with the same
    of both, one stays if any does."""
    own = docs.withColumn("_h", F.xxhash64(F.coalesce("text", F.lit(""))))
    by = judge(own.select("doc_id", "text", "_h")).groupBy("doc_id", "_h").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    said = written(by.where("NOT kept OR n > 1"), "said").select(F.col("doc_id").alias("_id"), F.col("_h").alias("_g"), "kept")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_g"))
    several = said.where("kept")
    out = own.join(said.where("NOT kept"), same, "left_anti")
    if not several.isEmpty():
        out = out.join(several, same, "left_anti").unionByName(out.join(several, same, "left_semi").dropDuplicates(["doc_id", "_h"]))
    return out.select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return thinned(docs, lambda rows: chunk_dedup.dedup(rows).select("doc_id", "_h", "kept"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return thinned(docs, lambda rows: near_dup.near_duplicates(rows, row="_h").select("doc_id", F.col("row").alias("_h"), "kept"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secret_scan.redact(docs)
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))) if "n_chars" in docs.columns else clean


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [("toxicity", toxic), ("exact_dedup", exact), ("near_dedup", near), ("secrets", secrets), ("packing", packed)]

#: Scores, near-duplicate components, the battery's thresholds and packings are beyond SQL: see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; between stages the documents are written and read again. What a stage has put down for
    itself goes once its result is written, and that once the next stage's is."""
    docs = table(spark, sf_dir, "documents")
    done: list[str] = []
    for name, stage in STAGES[:-1]:
        with scratch():
            df = stage(spark, docs, sf_dir)
            docs, path = saved(df, name)
        done.append(path)
        atexit.register(remove, spark, path)
        for old in done[:-1]:
            remove(spark, old)
    return STAGES[-1][1](spark, docs, sf_dir)
