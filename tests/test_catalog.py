import os
import re
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from quantloom.plans import catalog

DIR = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent
QUICK = ["log_returns", "weekly_panel", "factor_zscore", "pair_align", "refit_segments", "membership_point_in_time", "earnings_blackout", "regime_join", "trade_fold_full", "portfolio_daily", "top_pairs", "maintenance_history", "adjusted_rand", "cluster_persistence", "sparse_panel", "factor_sources", "walk_selection", "labels_frozen", "kalman_beta", "walk_forward_pairs", "walk_forward_summary", "wide_selection", *(f"cluster_labels_{m}" for m in ("fused", "c_optics", "c_dbscan"))]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("lineitem", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def rows(df):
    text = lambda v: None if pd.isna(v) else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted([tuple(text(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)], key=str)


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_its_oracle(spark, duck, name):
    got, want = catalog.queries()[name](spark, DIR).toPandas(), duck.sql(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_wide_selection_shuffles_tickers_not_pairs(spark):
    plan = catalog.queries()["wide_selection"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\([^)]*\b[ab]#", plan)


def test_every_query_has_an_oracle_that_parses(duck):
    assert set(catalog.oracle_sql()) == set(catalog.queries())
    for sql in catalog.oracle_sql().values():
        duck.execute(f"EXPLAIN {sql}")


def test_nothing_outside_the_text_subpackage_imports_it():
    for path in (ROOT / "quantloom").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"quantloom\.llm|corpus_pipeline", path.read_text()), path


def test_a_text_subpackage_that_cannot_be_imported_leaves_the_engine_alone(monkeypatch):
    import importlib.util
    import sys

    spec = importlib.util.spec_from_file_location("spark_entry_without_text", ROOT / "__spark_entry__.py")
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    for name in ("quantloom.llm", "quantloom.llm.queries", "corpus_pipeline"):
        monkeypatch.setitem(sys.modules, name, None)
    with pytest.warns(UserWarning, match="left out"):
        assert set(entry.queries()) == set(catalog.queries()) and set(entry.oracle_sql()) == set(catalog.oracle_sql())


def test_entry_and_stream(spark, tmp_path):
    import importlib.util

    spec = importlib.util.spec_from_file_location("spark_entry_under_test", ROOT / "__spark_entry__.py")
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    assert set(catalog.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
    from quantloom.streaming.live import portfolio_stream

    src, out = os.fspath(tmp_path / "in"), os.fspath(tmp_path / "out")
    batch = spark.sql("SELECT 0 AS segment_id, explode(sequence(date'2020-01-01', date'2020-01-10')) AS date, 1.0D AS pnl, 0.5D AS cost")
    batch.write.parquet(src)
    query = portfolio_stream(spark.readStream.schema(batch.schema).parquet(src)).writeStream.format("parquet").option("checkpointLocation", f"{out}-c").outputMode("append").trigger(availableNow=True).start(out)
    query.awaitTermination(120)
    got = spark.read.parquet(out)
    assert 0 < got.count() <= 9 and got.where("pnl_gross != 1.5").count() == 0
