"""The queries of the text operators, as __spark_entry__ registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quantloom.llm import bpe, chunk_dedup, html_text, multi_index, near_dup, packing, secret_scan, token_counts, toxicity, url_filter
from quantloom.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def _on(name: str, op: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: op(table(spark, sf_dir, name))


def queries() -> dict[str, Query]:
    return {
        "op1_token_counts": _on("documents", token_counts.op1),
        "op2_multi_index": _on("embeddings", multi_index.op2),
        "op3_chunk_recipe_dedup": _on("documents", chunk_dedup.op3),
        "op4_toxicity": toxicity.query,
        "op5_pattern_packing": _on("documents", packing.op5),
        "op6_url_filter": _on("pages", url_filter.op6),
        "op7_html_text": _on("pages", html_text.op7),
        "op8_near_dup": _on("documents", near_dup.op8),
        "op9_secret_scan": _on("documents", secret_scan.op9),
        "op10_byte_bpe": _on("documents", bpe.op10),
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_chunk_recipe_dedup": chunk_dedup.OP3_SQL, "op6_url_filter": url_filter.OP6_SQL, "op8_near_dup": near_dup.OP8_SQL}
