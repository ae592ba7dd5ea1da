"""Operator 2, approximate nearest neighbours by an inverted multi-index.

Vectors are cut into two halves, and each half is quantised by its own centroids, learned on at most SAMPLE vectors (those
with the smallest hash of the id). A vector's cell is its pair of centroids. Their number grows with the square root of
the rows, so that a cell holds CELL vectors in the mean, as far as the sample can tell centroids apart (one for each
PER_CENTROID of its vectors). A query walks the pairs in order of summed distance with a heap, until the cells seen hold
enough vectors; these are reranked by inner product in double precision. How many are enough is measured, for the table at
hand and at its size: PROBES vectors are searched exactly, and the share is taken within which TARGET of their true
neighbours are found. Data with structure need little; vectors without any need most of the table, and get it.

Every row is indexed. Cells are put behind one another, in order of their centroids, and cut into pages of some PAGE
vectors; a cell larger than that is several pages, so one that holds a third of all rows is many tasks. Queries are walked
in many tasks. They come to each page they walk into with the cells they want there, in parts of at most some QUERIES that
lie near each other, and a page goes only where it is wanted; there each cell is multiplied with just the queries that
want it. A page hands on its `k` best for each query, so what is shuffled last is small. The driver sees the sample, the
centroids, k neighbours of each probe, and one count for each cell.

Vectors that are null, zero, or hold a null or a non-finite number take no part, and neither do those whose length is not
the most common one. Ids that are null take no part. A candidate with the query's own id is never returned; rows that
repeat a query's id ask once. Ties go to the smaller id. Very long vectors are used whole. Fewer candidates than k give
fewer rows, an empty table none. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.common import slices, written

SAMPLE = 20_000
CELL, PER_CENTROID = 8, 8
TARGET, PROBES = 0.97, 256
PAGE, QUERIES = 4096, 1024
K = 20
MASK = 2**64 - 1


@dataclass
class Index:
    first: np.ndarray
    second: np.ndarray

    @property
    def half(self) -> int:
        return self.first.shape[1]

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return nearest(x[:, : self.half], self.first), nearest(x[:, self.half :], self.second)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances, but for a constant of each row."""
    return (c * c).sum(1)[None, :] - 2 * (x @ c.T)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return distances(x, c).argmin(1)


def centroids(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's algorithm from k spread rows of x, always the same."""
    distinct = np.unique(x, axis=0)
    c = distinct[np.random.default_rng(7).permutation(len(distinct))[:k]].copy()
    for _ in range(rounds):
        a = nearest(x, c)
        n = np.bincount(a, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, a, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    # Along the main axis of their spread, so that those of one shard are near each other.
    axis = np.linalg.svd(c - c.mean(0), full_matrices=False)[2][0]
    return c[np.argsort(c @ axis, kind="stable")]


def walk(one: np.ndarray, two: np.ndarray, counts: np.ndarray, enough: float) -> list[tuple[int, int]]:
    """Pairs of centroids by summed distance until their cells hold `enough` vectors. Each step of the heap opens the
    pair's next neighbours in either sorted list, so that a pair is opened once both its predecessors were taken."""
    ii, jj = np.argsort(one, kind="stable"), np.argsort(two, kind="stable")
    a, b = one[ii].tolist(), two[jj].tolist()
    ii, jj = ii.tolist(), jj.tolist()
    n, m = len(a), len(b)
    heap = [(a[0] + b[0], 0, 0)]
    reach = [0] * n  # pairs taken in each row: they are always the row's first
    out = []
    got = 0
    while heap and got < enough:
        _, r, c = heapq.heappop(heap)
        reach[r] = c + 1
        if held := int(counts[ii[r], jj[c]]):
            out.append((ii[r], jj[c]))
            got += held
        if c + 1 < m and (r == 0 or reach[r - 1] > c + 1):
            heapq.heappush(heap, (a[r] + b[c + 1], r, c + 1))
        if r + 1 < n and reach[r + 1] == c:
            heapq.heappush(heap, (a[r + 1] + b[c], r + 1, c))
    return out


def learn(sample: np.ndarray, rows: int) -> Index:
    """Centroids for a table of so many rows, from a bounded sample."""
    half = max(1, sample.shape[1] // 2)
    count = max(1, min(math.isqrt(rows // CELL), len(sample) // PER_CENTROID))
    return Index(centroids(sample[:, :half], count), centroids(sample[:, half:], count))


def share_needed(index: Index, probes: np.ndarray, cells: list[np.ndarray], counts: np.ndarray, target: float = TARGET) -> float:
    """The share of the vectors to visit so that `target` of the probes' true neighbours are met. cells: for each probe
    the cells (i * width + j) of its neighbours."""
    need = []
    flat, total = counts.ravel(), counts.sum()
    for x, own in zip(probes, cells):
        d = distances(x[None, : index.half], index.first)[0][:, None] + distances(x[None, index.half :], index.second)[0][None, :]
        order = np.argsort(d.ravel(), kind="stable")
        before = np.empty(len(order))
        before[order] = np.cumsum(flat[order])
        need.append(before[own] / total)
    need = np.concatenate(need) if need else np.zeros(0)
    return float(min(1.0, np.quantile(need, target))) if len(need) else 1.0


@dataclass
class Pages:
    """Where cells lie. first: the page of a cell, or its first one; parts: the pages it alone fills (1: it may share one);
    start: a page's first cell."""

    first: np.ndarray
    parts: np.ndarray
    start: np.ndarray


def paged(sizes: np.ndarray, page: int = PAGE) -> Pages:
    first, parts = np.zeros(len(sizes), dtype=np.int64), np.maximum(1, -(-sizes // page))
    start: list[int] = []
    room = 0
    for cell, n in enumerate(sizes.tolist()):
        if n > page:
            first[cell] = len(start)
            start += [cell] * int(parts[cell])
            room = 0
        else:
            if n > room or not start:
                start.append(cell)
                room = page
            first[cell] = len(start) - 1
            room -= n
    return Pages(first, parts, np.array(start))


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """vec_id long, v array<float or double> of those that take part."""
    own = vectors.select(vectors[vec_id].cast("long").alias("vec_id"), vectors[vector].alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    own = own.where(F.forall("v", finite) & F.exists("v", lambda x: x != 0))
    common = own.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    return own.where(F.size("v") == (common["d"] if common else 0))


def top(rough: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, own: int, k: int) -> list[tuple[int, float]]:
    """The k best rows by a sum that does not depend on what else is in the page. rough: nearly their products with q, minus
    infinity for those not wanted."""
    at = np.flatnonzero((rough > -np.inf) & (ids != own))
    if len(at) > k:
        s = rough[at]
        least = np.partition(s, len(s) - k)[len(s) - k]
        at = at[s >= least - 1e-9 * max(1.0, abs(least))]
    exact = (v[at] * q).sum(axis=1)
    best = np.lexsort((ids[at], -exact))[:k]
    return [(int(ids[at[b]]), float(exact[b])) for b in best]


def matrix(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), dtype=np.float64).reshape(len(vectors), -1)


def exact_cells(placed: DataFrame, ids: np.ndarray, probes: np.ndarray, k: int) -> list[np.ndarray]:
    """For each probe the cells of its k nearest vectors: every task keeps its own k best."""

    def best(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in slices(frames, PAGE):
            score = probes @ matrix(frame["v"]).T
            score[ids[:, None] == frame["vec_id"].to_numpy()[None, :]] = -np.inf
            n = min(k, score.shape[1])
            at = np.argpartition(-score, n - 1, axis=1)[:, :n]
            yield pd.DataFrame({"probe": np.repeat(np.arange(len(probes)), n), "score": np.take_along_axis(score, at, axis=1).ravel(), "cell": frame["cell"].to_numpy()[at].ravel()})

    rows = placed.mapInPandas(best, "probe int, score double, cell int")
    order = Window.partitionBy("probe").orderBy(F.desc("score"), "cell")
    rows = rows.withColumn("r", F.row_number().over(order)).where((F.col("r") <= k) & (F.col("score") > float("-inf"))).select("probe", "cell").toPandas()  # k rows for each probe
    return [rows["cell"][rows["probe"] == p].to_numpy() for p in range(len(probes))]


def search(vectors: DataFrame, asks: Column, vec_id: str = "vec_id", vector: str = "embedding", k: int = K, share: float | None = None) -> DataFrame:
    """query_id, rank, vec_id, score, visited (the vectors multiplied with the query): the k nearest found of every row for
    which `asks` (over vec_id) holds. share: of the vectors to visit, measured if not given."""
    own = usable(vectors, vec_id, vector)
    spark = own.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, visited long")
    rows = own.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vec_id", "v").toPandas()  # bounded by SAMPLE
    if not len(rows):
        return empty
    sample = matrix(rows["v"])
    index = learn(sample, own.count())
    width = len(index.second)

    @F.pandas_udf("int")
    def place(v: pd.Series) -> pd.Series:
        i, j = index.cells(matrix(v)) if len(v) else (np.zeros(0, int), np.zeros(0, int))
        return pd.Series(i * width + j, dtype="int32")

    placed = written(own.withColumn("cell", place("v")), "placed")
    sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).toPandas()  # a row for each cell
    counts = np.zeros(len(index.first) * width, dtype=np.int64)
    counts[sizes["cell"]] = sizes["n"]
    grid = counts.reshape(-1, width)
    total = int(counts.sum())
    if share is None:
        probes = sample[:PROBES]
        share = share_needed(index, probes, exact_cells(placed, rows["vec_id"].to_numpy()[:PROBES], probes, k), grid)
    enough = min(total, max(share * total, 4.0 * k))
    pages = paged(counts)
    ends = np.append(pages.start[1:], len(counts))  # a page's cells are those from its start to the next one's, or one
    spans = np.maximum(1, ends - pages.start)

    queries = placed.where(asks).groupBy("vec_id").agg(F.min(F.struct("v", "cell")).alias("q")).select(F.col("vec_id").alias("query_id"), "q.v", F.col("q.cell").alias("home"))
    asked = queries.count()
    if not asked:
        return empty
    # Parts of queries that lie near each other: by the page of their own cell, several if one page holds very many.
    per_page = placed.where(asks).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).toPandas()
    load = np.bincount(pages.first[per_page["cell"]], weights=per_page["n"], minlength=len(pages.start))
    group = (np.cumsum(load) - load) // QUERIES  # pages next to each other share a part while it has room
    split = np.maximum(1, -(-load // QUERIES)).astype(np.int64)
    most = int(split.max())

    def wants(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """For each query, a row for each page it walks into, with the cells it wants there as bits."""
        for frame in slices(frames, 64):
            x = matrix(frame["v"])
            one, two = distances(x[:, : index.half], index.first), distances(x[:, index.half :], index.second)
            out = []
            for q, v, home, a, b in zip(frame["query_id"], frame["v"], pages.first[frame["home"]], one, two):
                cells = np.array([i * width + j for i, j in walk(a, b, grid, enough)], dtype=np.int64)
                cells.sort()
                visited = int(counts[cells].sum())
                part = int(group[home]) * most + ((q * 0x9E3779B97F4A7C15 & MASK) >> 33) % int(split[home])
                at = pages.first[cells]
                cuts = np.flatnonzero(np.diff(at)) + 1
                for own_cells in np.split(cells, cuts):
                    first = int(pages.first[own_cells[0]])
                    bits = np.zeros(int(spans[first]), dtype=bool)
                    bits[own_cells - pages.start[first]] = True
                    packed = np.packbits(bits).tobytes()
                    out += [(q, v, part, first + n, packed, visited) for n in range(int(pages.parts[own_cells[0]]))]
            yield pd.DataFrame(out, columns=["query_id", "v", "part", "page", "cells", "visited"])

    @F.pandas_udf("int")
    def page_of(cell: pd.Series, vec: pd.Series) -> pd.Series:
        return pd.Series(pages.first[cell] + vec.to_numpy() % pages.parts[cell], dtype="int32")

    kind = own.schema["v"].dataType.simpleString()
    tasks = max(spark.sparkContext.defaultParallelism, -(-asked // QUERIES))
    wanted = queries.repartition(tasks, "query_id").mapInPandas(wants, f"query_id long, v {kind}, part long, page int, cells binary, visited long")
    wanted = written(wanted, "asked")
    held = placed.withColumn("page", page_of("cell", F.pmod(F.xxhash64("vec_id"), F.lit(2**31 - 1))))
    held = held.join(wanted.select("page", F.col("part").alias("to")).distinct(), "page").withColumnRenamed("to", "part")

    def rerank(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            left = left.sort_values("cell", kind="stable")
            ids, cell, v = left["vec_id"].to_numpy(), left["cell"].to_numpy(), matrix(left["v"])
            page = int(left["page"].iloc[0])
            local = cell - pages.start[page]
            cuts = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
            for at in range(0, len(right), 256):
                part = right.iloc[at : at + 256]
                x = matrix(part["v"])
                bits = np.stack([np.unpackbits(np.frombuffer(c, dtype=np.uint8), count=int(spans[page])) for c in part["cells"]]).astype(bool)
                rough = np.full((len(x), len(v)), -np.inf)
                for a, b in zip(cuts, cuts[1:]):  # a cell and those who want it
                    who = np.flatnonzero(bits[:, local[a]])
                    if len(who):
                        rough[who, a:b] = x[who] @ v[a:b].T
                for q, vec, s in zip(part["query_id"], x, rough):
                    out += [(q, i, value) for i, value in top(s, vec, ids, v, q, k)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    keys = ["page", "part"]
    found = held.groupBy(*keys).cogroup(wanted.groupBy(*keys)).applyInPandas(rerank, "query_id long, vec_id long, score double")
    # At most k rows come from a page, so a query's candidates are few; the k best of them are its answer.
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    seen = wanted.groupBy("query_id").agg(F.first("visited").alias("visited"))
    return best.join(seen, "query_id").select("query_id", "rank", "vec_id", "score", "visited")


def op2(vectors: DataFrame) -> DataFrame:
    return search(vectors.select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)
