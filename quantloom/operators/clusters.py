"""Rolling cluster labels by public methods. Each refit date is one group: a window of at most max(corr, beta) rows of
returns of the universe, so all dates are clustered in parallel; the freeze of labels between similar dates is a pass
over the few label vectors.

Methods: a (shrunk correlation, spectral), b (ridge betas, k-means), fused (blend of both affinities), a_coint (blend
with residual-test affinity), c (correlation of returns residualised on control factors, spectral), c_optics and
c_dbscan (the same, by density), b_agglo (betas, average linkage cut at a distance).
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.params import RETURN_WEIGHT

METHODS = ("a", "b", "fused", "a_coint", "c", "c_optics", "c_dbscan", "b_agglo")


@dataclass(frozen=True)
class ClusterParams:
    method: str = "fused"
    corr_window: int = 126
    beta_window: int = 252
    ridge_alpha: float = 10.0
    return_weight: float = RETURN_WEIGHT
    ari_threshold: float = 0.6
    pca_betas: int | None = None
    ortho_factors: int | None = None
    coint_weight: float = 0.5
    coint_prefilter_corr: float = 0.70
    coint_window: int = 252
    optics_xi: float = 0.05
    c_use_ols: bool = False
    agglo_threshold: float = 0.4
    min_points: int = 3
    clusters: int | None = None


def shrunk_correlation(x: np.ndarray) -> np.ndarray:
    """Correlation shrunk to the identity by the intensity of Ledoit and Wolf (2004)."""
    sd = x.std(0)
    z = (x - x.mean(0)) / np.where(sd > 0, sd, 1.0)
    n = len(z)
    s = z.T @ z / n
    target = np.eye(len(s)) * np.trace(s) / len(s)
    gap = ((s - target) ** 2).sum()
    spread = ((z**2).T @ (z**2) / n - s**2).sum() / n
    k = 0.0 if gap == 0 else min(1.0, max(0.0, spread / gap))
    return (1 - k) * s + k * target


def ridge_betas(x: np.ndarray, factors: np.ndarray, alpha: float, components: int | None = None) -> np.ndarray:
    """One row of standardised factor loadings for each column of x."""
    f = (factors - factors.mean(0)) / np.where(factors.std(0) > 0, factors.std(0), 1.0)
    if components:
        u, s, _ = np.linalg.svd(f, full_matrices=False)
        f = u[:, :components] * s[:components]
    return np.linalg.solve(f.T @ f + alpha * np.eye(f.shape[1]), f.T @ (x - x.mean(0))).T


def principal(b: np.ndarray, k: int | None) -> np.ndarray:
    if not k or k >= b.shape[1]:
        return b
    c = b - b.mean(0)
    u, s, _ = np.linalg.svd(c, full_matrices=False)
    return u[:, :k] * s[:k]


def k_means(x: np.ndarray, k: int, rounds: int = 50) -> np.ndarray:
    """Lloyd's algorithm from farthest-point seeds: no randomness."""
    at = [int(((x - x.mean(0)) ** 2).sum(1).argmax())]
    while len(at) < k:
        d = np.min([((x - x[i]) ** 2).sum(1) for i in at], axis=0)
        at.append(int(d.argmax()))
    c = x[at].copy()
    own = np.zeros(len(x), dtype=int)
    for _ in range(rounds):
        new = ((x[:, None, :] - c[None]) ** 2).sum(2).argmin(1)
        if (new == own).all() and _:
            break
        own = new
        for j in range(k):
            if (own == j).any():
                c[j] = x[own == j].mean(0)
    return own


def spectral(affinity: np.ndarray, k: int | None) -> np.ndarray:
    """Normalised cut: k-means on the leading eigenvectors, k by the largest gap if not given."""
    w = np.maximum(affinity, 0)
    np.fill_diagonal(w, 0)
    d = w.sum(1)
    root = 1 / np.sqrt(np.where(d > 0, d, 1.0))
    values, vectors = np.linalg.eigh(root[:, None] * w * root[None, :])
    values, vectors = values[::-1], vectors[:, ::-1]
    if k is None:
        most = max(2, min(len(w) - 1, 12))
        gaps = values[1:most] - values[2 : most + 1] if len(values) > most else values[1:-1] - values[2:]
        k = 2 + int(np.argmax(gaps)) if len(gaps) else 1
    k = max(1, min(k, len(w)))
    e = vectors[:, :k]
    norm = np.linalg.norm(e, axis=1, keepdims=True)
    return k_means(e / np.where(norm > 0, norm, 1.0), k)


def cosine(b: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(b, axis=1, keepdims=True)
    u = b / np.where(n > 0, n, 1.0)
    return u @ u.T


def residuals(x: np.ndarray, control: np.ndarray, ols: bool, alpha: float) -> np.ndarray:
    f = np.column_stack([np.ones(len(x)), control])
    pen = np.zeros((f.shape[1], f.shape[1])) if ols else alpha * np.diag([0.0] + [1.0] * control.shape[1])
    return x - f @ np.linalg.lstsq(f.T @ f + pen, f.T @ x, rcond=None)[0]


def residual_test(y: np.ndarray, x: np.ndarray) -> float:
    """t statistic of the residual's unit root, without lags."""
    f = np.column_stack([np.ones(len(x)), x])
    e = y - f @ np.linalg.lstsq(f, y, rcond=None)[0]
    d, e1 = np.diff(e), e[:-1] - e[:-1].mean()
    sxx = float(e1 @ e1)
    if sxx <= 0:
        return 0.0
    rho = float(e1 @ (d - d.mean())) / sxx
    rest = float(((d - d.mean() - rho * e1) ** 2).sum()) / max(1, len(d) - 2)
    return rho / np.sqrt(rest / sxx) if rest > 0 else 0.0


def dbscan(distance: np.ndarray, radius: float, least: int) -> np.ndarray:
    """Density clusters; noise is -1."""
    near = distance <= radius
    core = near.sum(1) >= least
    own = np.full(len(distance), -1)
    k = 0
    for i in np.flatnonzero(core):
        if own[i] >= 0:
            continue
        stack = [i]
        own[i] = k
        while stack:
            for j in np.flatnonzero(near[stack.pop()] & (own < 0)):
                own[j] = k
                if core[j]:
                    stack.append(j)
        k += 1
    return own


def parting_reach(distance: np.ndarray) -> float:
    """A reach that joins what is dense and parts the rest: of the edges of the minimum spanning tree, from the median one
    on, the geometric mean of the two between which they grow by the largest factor."""
    n = len(distance)
    inside, best, edges = np.zeros(n, dtype=bool), distance[0].astype(float).copy(), []
    inside[0] = True
    for _ in range(n - 1):
        i = int(np.where(inside, np.inf, best).argmin())
        edges.append(best[i])
        inside[i] = True
        best = np.minimum(best, distance[i])
    e = np.maximum(np.sort(edges)[(n - 1) // 2 :], 1e-12)
    k = int((e[1:] / e[:-1]).argmax()) if len(e) > 1 else 0
    return float(np.sqrt(e[k] * e[min(k + 1, len(e) - 1)]))


def reachability(distance: np.ndarray, least: int) -> tuple[list[int], np.ndarray]:
    """The order in which density reaches the points, and each point's reachability in that order (Ankerst et al., 1999)."""
    n = len(distance)
    core = np.sort(distance, axis=1)[:, min(least, n) - 1]
    reach, done, order = np.full(n, np.inf), np.zeros(n, dtype=bool), []
    for _ in range(n):
        i = int(np.where(done, np.inf, np.minimum(reach, 1e300)).argmin())
        done[i] = True
        order.append(i)
        reach = np.where(done, reach, np.minimum(reach, np.maximum(core[i], distance[i])))
    return order, reach[order]


def steep_areas(r: np.ndarray, xi: float, least: int, down: bool) -> list[tuple[int, int]]:
    """Maximal stretches (first, last) of a reachability plot that begin and end with a fall (or rise) by the share xi, go
    only one way, and hold no `least` neighbours that are not steep."""
    lo, hi = (r[1:], r[:-1]) if down else (r[:-1], r[1:])
    steep = lo <= hi * (1 - xi)
    goes = lo <= hi
    out, at, n = [], 0, len(steep)
    while at < n:
        if not steep[at]:
            at += 1
            continue
        last, flat, k = at, 0, at + 1
        while k < n and goes[k] and flat < least:
            flat = 0 if steep[k] else flat + 1
            last = k if steep[k] else last
            k += 1
        out.append((at, last))
        at = last + 1
    return out


def optics(distance: np.ndarray, least: int, xi: float) -> np.ndarray:
    """Clusters of the reachability plot by the xi method: between a steep fall and a later steep rise of which neither is
    passed by what lies between, trimmed to equal height at both ends. Of clusters within clusters those count that stand
    out most: a dent by little more than xi in the floor of a deep valley does not break the valley up. Points in none
    are -1."""
    order, reach = reachability(distance, least)
    n = len(order)
    r = np.append(reach, np.inf)
    falls, rises = steep_areas(r, xi, least, True), steep_areas(r, xi, least, False)
    found: list[tuple[int, int]] = []
    for up, top in rises:
        for first, bottom in falls:
            if bottom >= up:
                break
            inside = r[bottom + 1 : up + 1].max()  # the highest between the two areas
            if inside > r[first] * (1 - xi) or inside > r[top + 1] * (1 - xi):
                continue
            start, end = first, top
            if r[first] * (1 - xi) >= r[top + 1]:  # the fall begins higher: cut it at the height of the rise's end
                start = max(k for k in range(first, bottom + 1) if r[k] > r[top + 1] or k == first)
            elif r[top + 1] * (1 - xi) >= r[first]:  # the rise ends higher: cut it at the height of the fall's begin
                end = min(k for k in range(up, top + 1) if r[k + 1] >= r[first] or k == top)
            if end - start + 1 >= least:
                found.append((start, end))

    def contrast(start: int, end: int) -> float:  # the lower wall over the highest inside; all points have no wall
        wall = min(r[start], r[end + 1])
        return wall / max(r[start + 1 : end + 1].max(), 1e-12) if np.isfinite(wall) else 0.0

    own, k = np.full(n, -1), 0
    for start, end in sorted(found, key=lambda c: (-contrast(*c), c[1] - c[0], c)):
        if (own[start : end + 1] < 0).all():
            own[start : end + 1] = k
            k += 1
    out = np.full(n, -1)
    out[order] = own
    return out


def average_linkage(distance: np.ndarray, threshold: float) -> np.ndarray:
    """Groups merged by mean distance up to the threshold. A merge changes one row of the means, so it costs a look at the
    table and not at all pairs of members."""
    n = len(distance)
    d = distance.astype(float).copy()
    d[np.tril_indices(n)] = np.inf  # row before column, as ties go to the first
    mean, size, group = distance.astype(float).copy(), np.ones(n), np.arange(n)
    while n > 1:
        i, j = divmod(int(d.argmin()), n)
        if not d[i, j] <= threshold:
            break
        mean[i] = mean[:, i] = (size[i] * mean[i] + size[j] * mean[j]) / (size[i] + size[j])
        size[i] += size[j]
        group[group == j] = i
        d[j], d[:, j] = np.inf, np.inf
        free = np.isfinite(d[i, i + 1 :])
        d[i, i + 1 :][free] = mean[i, i + 1 :][free]
        free = np.isfinite(d[:i, i])
        d[:i, i][free] = mean[:i, i][free]
    return np.unique(group, return_inverse=True)[1]


def cluster(x: np.ndarray, factors: np.ndarray, control: np.ndarray, logs: np.ndarray, p: ClusterParams) -> np.ndarray:
    """Labels of the columns of x; -1 is none. Rows are dates, the last is the refit date."""
    if x.shape[1] < 3:
        return np.zeros(x.shape[1], dtype=int)
    recent = x[-p.corr_window :]
    betas = lambda: principal(ridge_betas(x[-p.beta_window :], factors[-p.beta_window :], p.ridge_alpha, p.ortho_factors), p.pca_betas)
    if p.method == "a":
        return spectral(shrunk_correlation(recent), p.clusters)
    if p.method == "b":
        return spectral(np.exp(cosine(betas()) - 1), p.clusters)
    if p.method == "fused":
        return spectral(p.return_weight * shrunk_correlation(recent) + (1 - p.return_weight) * cosine(betas()), p.clusters)
    if p.method == "a_coint":
        corr = shrunk_correlation(recent)
        tests = np.zeros_like(corr)
        own = logs[-p.coint_window :]
        for i, j in itertools.combinations(range(len(corr)), 2):
            if corr[i, j] >= p.coint_prefilter_corr:
                tests[i, j] = tests[j, i] = min(1.0, max(0.0, -residual_test(own[:, i], own[:, j]) / 4))
        return spectral((1 - p.coint_weight) * corr + p.coint_weight * tests, p.clusters)
    if p.method == "b_agglo":
        return average_linkage(1 - cosine(betas()), p.agglo_threshold)
    corr = shrunk_correlation(residuals(recent, control[-p.corr_window :], p.c_use_ols, p.ridge_alpha))
    if p.method == "c":
        return spectral(corr, p.clusters)
    distance = np.sqrt(np.maximum(0, 2 * (1 - corr)))
    np.fill_diagonal(distance, 0)
    if p.method == "c_optics":
        return optics(distance, p.min_points, p.optics_xi)
    if p.method == "c_dbscan":
        return dbscan(distance, parting_reach(distance), p.min_points)
    raise ValueError(f"method must be one of {METHODS}")


def rolling_labels(features: DataFrame, factors: DataFrame, days: DataFrame, segments: DataFrame, p: ClusterParams, control: DataFrame | None = None) -> DataFrame:
    """segment_id, refit_date, ticker, cluster before the freeze (no row for unlabelled tickers)."""
    if p.method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    window = max(p.corr_window, p.beta_window, p.coint_window if p.method == "a_coint" else 0)
    rn0 = segments.join(days.select(F.col("date").alias("d0"), F.col("rn").alias("rn0")), "d0").select("segment_id", F.col("d0").alias("refit_date"), "rn0")
    spans = rn0.select("segment_id", "refit_date", F.explode(F.sequence(F.greatest(F.col("rn0") - window + 1, F.lit(0)), "rn0")).alias("rn")).join(days, "rn").drop("rn")
    kinds = [features.select("date", F.lit("t").alias("kind"), F.col("ticker").alias("name"), "ret", "lp"), factors.select("date", F.lit("f").alias("kind"), F.col("factor").alias("name"), F.col("z").alias("ret"), F.lit(None).cast("double").alias("lp"))]
    if control is not None:
        kinds.append(control.select("date", F.lit("c").alias("kind"), F.col("factor").alias("name"), "ret", F.lit(None).cast("double").alias("lp")))
    rows = kinds[0]
    for k in kinds[1:]:
        rows = rows.unionByName(k)
    rows = rows.join(spans, "date")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        wide = lambda kind, c: frame[frame["kind"] == kind].pivot_table(index="date", columns="name", values=c, aggfunc="first")
        x = wide("t", "ret").dropna(axis=1, thresh=int(0.9 * frame["date"].nunique())).fillna(0.0)
        f = wide("f", "ret").reindex(x.index).fillna(0.0)
        c = wide("c", "ret").reindex(x.index).fillna(0.0) if (frame["kind"] == "c").any() else f
        logs = wide("t", "lp").reindex(index=x.index, columns=x.columns).ffill().bfill()
        own = cluster(x.to_numpy(), f.to_numpy(), c.to_numpy(), logs.to_numpy(), p) if x.shape[1] else np.zeros(0, dtype=int)
        out = pd.DataFrame({"segment_id": frame["segment_id"].iloc[0], "refit_date": frame["refit_date"].iloc[0], "ticker": list(x.columns), "cluster": own})
        return out[out["cluster"] >= 0].astype({"segment_id": "int32", "cluster": "int32"})

    return rows.groupBy("segment_id").applyInPandas(run, "segment_id int, refit_date date, ticker string, cluster int")


def contingency(labels: DataFrame) -> DataFrame:
    """segment_id, prev, curr, n: tickers by their cluster at the refit date before and at this one."""
    before = labels.select((F.col("segment_id") + 1).alias("segment_id"), "ticker", F.col("cluster").alias("prev"))
    own = labels.select("segment_id", "ticker", F.col("cluster").alias("curr"))
    return own.join(before, ["segment_id", "ticker"]).groupBy("segment_id", "prev", "curr").agg(F.count(F.lit(1)).alias("n"))


def adjusted_rand(labels: DataFrame) -> DataFrame:
    """segment_id, ari: agreement with the labels one refit date before (Hubert and Arabie, 1985)."""
    table = contingency(labels)
    two = lambda c: c * (c - 1) / 2.0
    cells = table.groupBy("segment_id").agg(F.sum(two(F.col("n"))).alias("both"), F.sum("n").alias("total"))
    side = lambda k, name: table.groupBy("segment_id", k).agg(F.sum("n").alias("n")).groupBy("segment_id").agg(F.sum(two(F.col("n"))).alias(name))
    own = cells.join(side("prev", "x"), "segment_id").join(side("curr", "y"), "segment_id")
    expected = F.try_divide(F.col("x") * F.col("y"), F.nullif(two(F.col("total")), F.lit(0.0)))
    most = (F.col("x") + F.col("y")) / 2.0
    return own.select("segment_id", F.coalesce(F.try_divide(F.col("both") - expected, F.nullif(most - expected, F.lit(0.0))), F.lit(1.0)).alias("ari"))


def rand_index(a: dict, b: dict) -> float:
    """The same for two label maps."""
    common = [k for k in a if k in b]
    if len(common) < 2:
        return 1.0
    table = pd.crosstab([a[k] for k in common], [b[k] for k in common]).to_numpy()
    two = lambda v: (v * (v - 1) / 2).sum()
    x, y, n = two(table.sum(1)), two(table.sum(0)), len(common)
    expected, most = x * y / (n * (n - 1) / 2), (x + y) / 2
    return 1.0 if most == expected else (two(table) - expected) / (most - expected)


def freeze(labels: DataFrame, threshold: float) -> DataFrame:
    """Labels held from the refit date before while they agree with the new ones: a pass over one small vector for each
    refit date (universe times refit dates names in all). A ticker that is new to a labelling that is held has no label in
    it, and gets none until the next one is taken: the rejected labelling's numbers mean nothing in the one held."""
    spark = labels.sparkSession
    rows = labels.toPandas()
    held: dict[str, int] | None = None
    out = []
    for (segment, date), own in sorted(rows.groupby(["segment_id", "refit_date"]), key=lambda x: x[0][0]):
        new = dict(zip(own["ticker"], own["cluster"]))
        if held is None or rand_index(held, new) < threshold:
            held = new
        out += [(int(segment), date, t, int(held[t])) for t in new if t in held]
    return spark.createDataFrame(out, "segment_id int, refit_date date, ticker string, cluster int")


def at_refit(labels: DataFrame, segments: DataFrame) -> DataFrame:
    """labels, once it is sure that every refit date has some: KeyError names the first that has none."""
    missing = segments.join(labels.select("segment_id").distinct(), "segment_id", "left_anti").select("d0").orderBy("d0").first()
    if missing is not None:
        raise KeyError(f"no labels at the refit date {missing['d0']}")
    return labels


def best_assignment(gain: np.ndarray) -> float:
    """The largest sum of one entry in each row and column (shortest augmenting paths)."""
    n = max(gain.shape)
    cost = np.zeros((n, n))
    cost[: gain.shape[0], : gain.shape[1]] = -gain
    u, v, match = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, dtype=int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, prev, used = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=int), np.zeros(n + 1, dtype=bool)
        while match[j0]:
            used[j0] = True
            i0 = match[j0]
            free = np.flatnonzero(~used[1:]) + 1
            cut = cost[i0 - 1, free - 1] - u[i0] - v[free]
            better = cut < least[free]
            least[free[better]], prev[free[better]] = cut[better], j0
            j1 = free[int(least[free].argmin())]
            d = least[j1]
            u[match[used]] += d
            v[used] -= d
            least[~used] -= d
            j0 = j1
        while j0:
            match[j0], j0 = match[prev[j0]], prev[j0]
    return float(-sum(cost[match[j] - 1, j - 1] for j in range(1, n + 1)))


def persistence(labels: DataFrame) -> DataFrame:
    """segment_id, persistence: share of the tickers labelled on both dates that keep their cluster under the best
    matching of cluster names. One group is one contingency table."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        table = frame.pivot_table(index="prev", columns="curr", values="n", fill_value=0, aggfunc="sum").to_numpy(dtype=float)
        share = best_assignment(table) / table.sum() if table.sum() else float("nan")
        return pd.DataFrame({"segment_id": [frame["segment_id"].iloc[0]], "persistence": [share]}).astype({"segment_id": "int32"})

    return contingency(labels).groupBy("segment_id").applyInPandas(run, "segment_id int, persistence double")
