import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.llm import multi_index


def brute(rows, queries, k):
    out = {}
    for q, v in queries.items():
        scored = sorted(((-float((np.float64(x) * np.float64(v)).sum()), i) for i, x in rows if i != q))
        out[q] = [i for _, i in scored[:k]]
    return out


@pytest.mark.parametrize("structured", [True, False])
def test_recall_and_order(spark, structured):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16)) * (4 if structured else 0)
    data = (centres[rng.integers(12, size=1500)] + rng.normal(size=(1500, 16))).astype("float32")
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(data)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    got = {}
    for r in multi_index.op2(df).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute([(i, np.float32(v)) for i, v in rows], {i: np.float32(v) for i, v in rows if i % 20 == 0}, 20)
    assert set(got) == set(want)
    hits = 0
    for q, own in got.items():
        own.sort()
        assert [r for r, _, _ in own] == list(range(1, 21))
        assert all((a[2], -a[1]) >= (b[2], -b[1]) for a, b in zip(own, own[1:]))
        hits += len({v for _, v, _ in own} & set(want[q]))
    assert hits / (20 * len(want)) >= 0.9


def test_copies_ties_and_unusable_vectors(spark):
    good = [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(30)]
    bad = [(100, None), (120, [0.0] * 4), (140, [1.0, None, 2.0, 3.0]), (160, [1.0, math.nan, 0.0, 0.0]), (180, [1.0, math.inf, 0.0, 0.0]), (200, [1.0]), (None, [1.0, 2.0, 3.0, 4.0])]
    df = spark.createDataFrame(good + bad + [good[0]], "vec_id long, embedding array<double>").withColumn("rank", F.lit("x"))
    got = multi_index.op2(df).orderBy("query_id", "rank").collect()
    assert {r.query_id for r in got} == {0, 20}
    assert [r.vec_id for r in got if r.query_id == 0] == list(range(1, 21))
    assert [r.vec_id for r in got if r.query_id == 20] == [0, 0, *range(1, 19)]
    assert {r.score for r in got} == {30.0}


def test_empty_and_few(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert multi_index.op2(empty).count() == 0
    two = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.rank, r.vec_id) for r in multi_index.op2(two).collect()] == [(0, 1, 1)]


def test_walk_takes_pairs_by_distance():
    rng = np.random.default_rng(0)
    one, two = rng.normal(size=7), rng.normal(size=5)
    counts = np.ones((7, 5), dtype=int)
    order = [one[i] + two[j] for i, j in multi_index.walk(one, two, counts, 35)]
    assert order == sorted(order) and len(order) == 35
    assert len(multi_index.walk(one, two, counts, 4)) == 4


def test_pages_hold_every_cell_once_and_split_large_ones():
    sizes = np.array([3, 0, 5, 40, 2, 2, 9, 0])
    pages = multi_index.paged(sizes, 10)
    assert pages.parts.tolist() == [1, 1, 1, 4, 1, 1, 1, 1]
    load = np.zeros(len(pages.start))
    for cell, n in enumerate(sizes):
        for k in range(pages.parts[cell]):
            load[pages.first[cell] + k] += n / pages.parts[cell]
    assert load.sum() == sizes.sum() and load.max() <= 10
    assert (np.diff(pages.first) >= 0).all() and (pages.start[pages.first] <= np.arange(8)).all()


def test_recall_and_work_beyond_the_sample(spark):
    """50,000 vectors, of which 20,000 are learned from: recall against brute force, and the vectors multiplied."""
    rng = np.random.default_rng(5)
    visits = {}
    for name, spread in (("clusters", 0.25), ("none", None)):
        data = rng.normal(size=(50_000, 16)) if spread is None else rng.normal(size=(400, 16))[rng.integers(400, size=50_000)] + spread * rng.normal(size=(50_000, 16))
        data = (data / np.linalg.norm(data, axis=1, keepdims=True)).astype("float32")
        df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(data)), "embedding": data.tolist()}), "vec_id long, embedding array<float>")
        got = multi_index.search(df, F.col("vec_id") % 125 == 0).toPandas()
        asked = np.arange(0, len(data), 125)
        score = data[asked].astype("float64") @ data.T.astype("float64")
        score[np.arange(len(asked)), asked] = -np.inf
        true = np.argpartition(-score, 20, axis=1)[:, :20]
        hits = sum(len(set(got["vec_id"][got["query_id"] == q]) & set(t)) for q, t in zip(asked, true))
        assert hits / (20 * len(asked)) >= 0.95
        visits[name] = got.groupby("query_id")["visited"].first().mean() / len(data)
    assert visits["clusters"] < 0.2 and visits["clusters"] < visits["none"] < 1
