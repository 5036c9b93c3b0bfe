"""Clustering of neurons: linkage on a cohort, k-means and density clustering on Spark."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.operators.components import connected_components
from arborlake.operators.correlation import Cohort, per_neuron
from arborlake.runtime import arrow_schema, written

#: Fixed value: bytes from which a square lies in a file of the task's disk instead of its memory.
IN_MEMORY = 200_000_000


def distances(r: np.ndarray) -> np.ndarray:
    """Distances max(0, 1 - r) of a correlation matrix, r clipped to [-1, 1], 0 on the diagonal."""
    d = np.maximum(0.0, 1.0 - np.clip(r, -1.0, 1.0))
    np.fill_diagonal(d, 0.0)
    return d


def linkage(d: np.ndarray, method: str = "average") -> np.ndarray:
    """Merges (a, b, height, size) of a distance matrix by nearest-neighbour chains.

    Methods: average, complete, single, ward (on Euclidean distances). Merged
    clusters are numbered from n in order of height.
    """
    return merged(np.array(d, float), method)


def merged(d: np.ndarray, method: str = "average") -> np.ndarray:
    """``linkage`` that uses the matrix up, so that nothing else of its size is needed."""
    if method not in ("average", "complete", "single", "ward"):
        raise ValueError(f"unknown method {method!r}")
    n = m = len(d)
    if method == "ward":
        for row in d:
            np.multiply(row, row, out=row)
    np.fill_diagonal(d, np.inf)
    # Rows of merged clusters stay until half of them are gone; their place in ``gone`` is infinite.
    size, gone, own, chain, merges = np.ones(n), np.zeros(n), np.arange(n), [], []
    while len(merges) < n - 1:
        if n - len(merges) <= m // 2:
            kept = np.flatnonzero(gone[:m] == 0)
            for to, row in enumerate(kept):
                d[to, : len(kept)] = d[row, kept]
            chain = np.searchsorted(kept, chain).tolist()
            size, own, gone, m = size[kept], own[kept], np.zeros(len(kept)), len(kept)
        if not chain:
            chain = [int(np.argmin(gone))]
        while True:
            a = chain[-1]
            b = int(np.argmin(d[a, :m] + gone))
            if len(chain) > 1 and d[a, chain[-2]] <= d[a, b]:
                b = chain[-2]
                break
            chain.append(b)
        chain = chain[:-2]
        height, x, y = d[a, b], d[a, :m], d[b, :m]
        merges.append((own[a], own[b], np.sqrt(height) if method == "ward" else height))
        na, nb = size[a], size[b]
        if method == "average":
            new = (na * x + nb * y) / (na + nb)
        elif method == "complete":
            new = np.maximum(x, y)
        elif method == "single":
            new = np.minimum(x, y)
        else:
            new = ((na + size) * x + (nb + size) * y - size * height) / (na + nb + size)
        new[[a, b]] = np.inf
        d[b, :m], d[:m, b] = new, new
        gone[a], size[b] = np.inf, na + nb
    return _numbered(merges, n)


def ward_of_points(c: np.ndarray) -> np.ndarray:
    """Ward's ``linkage`` of points by the centres of clusters: no matrix, a chain's step takes one row of distances."""
    n = m = len(c)
    c, size, gone, low, own, chain, merges = np.array(c.T, float), np.ones(n), np.zeros(n), np.zeros(n), np.arange(n), [], []

    def away(a: int) -> np.ndarray:
        d = sum((v - v[a]) ** 2 for v in c) * (2 * size[a] * size / (size[a] + size)) + gone
        d[a] = np.inf
        return d

    while len(merges) < n - 1:
        if n - len(merges) <= m // 2:
            kept = np.flatnonzero(gone == 0)
            chain = np.searchsorted(kept, chain).tolist()
            c, size, low, own, gone, m = c[:, kept], size[kept], low[kept], own[kept], np.zeros(len(kept)), len(kept)
        if not chain:
            chain = [int(np.argmin(gone))]
        while True:
            a = chain[-1]
            d = away(a)
            b = int(np.argmin(d))
            if len(chain) > 1 and d[chain[-2]] <= d[b]:
                b = chain[-2]
                break
            chain.append(b)
        chain = chain[:-2]
        # Rounding must not put a merge below those it joins.
        low[b] = max(np.sqrt(d[b]), low[a], low[b])
        merges.append((own[a], own[b], low[b]))
        c[:, b] = (size[a] * c[:, a] + size[b] * c[:, b]) / (size[a] + size[b])
        gone[a], size[b] = np.inf, size[a] + size[b]
    return _numbered(merges, n)


def _numbered(merges: list[tuple[int, int, float]], n: int) -> np.ndarray:
    """Merges of (member, member, height) as rows (a, b, height, size) in order of height."""
    merges.sort(key=lambda m: m[2])
    up, number, count = list(range(n)), list(range(n)), [1] * n

    def root(v: int) -> int:
        while up[v] != v:
            up[v] = up[up[v]]
            v = up[v]
        return v

    out = np.zeros((len(merges), 4))
    for k, (a, b, h) in enumerate(merges):
        a, b = root(a), root(b)
        x, y = sorted((number[a], number[b]))
        count[b] += count[a]
        out[k] = x, y, h, count[b]
        up[a], number[b] = b, n + k
    return out


def cut(merges: np.ndarray, k: int) -> np.ndarray:
    """Labels from 1 of at most k clusters: the last merges undone, equal heights together."""
    n = len(merges) + 1
    k = max(1, min(k, n))
    heights = merges[:, 2]
    keep = n - k
    while 0 < keep < len(merges) and heights[keep - 1] == heights[keep] and keep < n - 1:
        keep += 1
    group = {v: [v] for v in range(n)}
    for i in range(keep):
        a, b = int(merges[i, 0]), int(merges[i, 1])
        less, more = sorted((group.pop(a), group.pop(b)), key=len)
        more += less
        group[n + i] = more
    labels = np.zeros(n, int)
    for label, (_, rows) in enumerate(sorted(group.items(), key=lambda g: min(g[1])), 1):
        labels[rows] = label
    return labels


def leaf_order(merges: np.ndarray) -> list[int]:
    """Leaves from left to right."""
    n, todo, out = len(merges) + 1, [2 * len(merges)], []
    while todo:
        v = todo.pop()
        if v < n:
            out.append(v)
        else:
            todo += [int(merges[v - n, 1]), int(merges[v - n, 0])]
    return out


def cophenetic(merges: np.ndarray) -> np.ndarray:
    """Height at which each pair is joined."""
    n = len(merges) + 1
    out, group = np.zeros((n, n)), {v: [v] for v in range(n)}
    for i, (a, b, h, _) in enumerate(merges):
        left, right = group.pop(int(a)), group.pop(int(b))
        out[np.ix_(left, right)] = out[np.ix_(right, left)] = h
        group[n + i] = left + right
    return out


def _ranks(v: np.ndarray) -> np.ndarray:
    _, inverse, count = np.unique(v, return_inverse=True, return_counts=True)
    return (np.cumsum(count) - (count - 1) / 2)[inverse]


def cophenetic_spearman(d: np.ndarray, merges: np.ndarray) -> float:
    """Spearman correlation of distances and joining heights over all pairs."""
    at = np.triu_indices(len(d), 1)
    a, b = _ranks(d[at]), _ranks(cophenetic(merges)[at])
    return float(np.corrcoef(a, b)[0, 1])


def _square(n: int) -> np.ndarray:
    """Room for a square of doubles: memory, or from ``IN_MEMORY`` on a file that is gone with its last use."""
    if 8 * n * n < IN_MEMORY:
        return np.empty((n, n))
    with tempfile.TemporaryFile(dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None) as f:
        f.truncate(8 * n * n)
        return np.memmap(f, float, "r+", shape=(n, n))


def correlation_distances(cohort: Cohort, dense: bool) -> np.ndarray:
    """Distances of all pairs of a cohort, row by row."""
    d = _square(len(cohort.ids))
    for a in range(len(d)):
        d[a] = np.maximum(0.0, 1.0 - np.clip(cohort.row(a, dense), -1.0, 1.0))
        d[a, a] = 0.0
    return d


def _one_task(rows: DataFrame, work: Callable[[Iterator], dict], ddl: str) -> DataFrame:
    """``work`` on all rows (of which there is one a neuron) in one task of an executor: chains follow one another, and the driver holds none of it."""
    schema = arrow_schema(ddl)

    def run(batches):
        import pyarrow as pa

        yield pa.RecordBatch.from_pydict(work(batches), schema=schema)

    return rows.repartition(1).mapInArrow(run, ddl)


def correlation_clusters(counts: DataFrame, k: int, method: str = "average", dense: bool = False) -> DataFrame:
    """Clusters of a cohort correlated by its counts per voxel: file_id, label, leaf position. Without ``dense``, neurons that share no voxel are at the distance 2."""

    def work(batches):
        cohort = Cohort(batches)
        if not cohort.ids:
            return {"file_id": [], "label": [], "leaf": []}
        merges = merged(correlation_distances(cohort, dense), method)
        place = np.argsort(leaf_order(merges))
        return {"file_id": cohort.ids, "label": cut(merges, k), "leaf": place}

    return _one_task(per_neuron(counts), work, "file_id string, label int, leaf int")


def soma_clusters(somas: DataFrame, k: int, method: str = "ward") -> DataFrame:
    """Hierarchical clusters of a cohort's soma coordinates (file_id, x, y, z). Ward's method needs no matrix."""
    somas = written(somas.select("file_id", "x", "y", "z"))
    if somas.limit(2).count() < 2:
        raise ValueError("clustering takes at least 2 somas")

    def work(batches):
        got = sorted(row for b in batches for row in zip(*(b.column(c).to_pylist() for c in ("file_id", "x", "y", "z"))))
        c = np.array([row[1:] for row in got], float)
        if method == "ward":
            merges = ward_of_points(c)
        else:
            d = _square(len(c))
            for a in range(len(c)):
                d[a] = np.sqrt(((c - c[a]) ** 2).sum(1))
            merges = merged(d, method)
        return {"file_id": [row[0] for row in got], "label": cut(merges, k)}

    return _one_task(somas, work, "file_id string, label int")


def soma_kmeans(somas: DataFrame, k: int, starts: int = 10, seed: int = 42) -> DataFrame:
    """k-means of soma coordinates on Spark, best of several starts; labels from 1.

    The somas are written once, so that no start derives them again.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=["x", "y", "z"], outputCol="features").transform(written(somas.select("file_id", "x", "y", "z")))
    fits = [KMeans(k=k, seed=seed + s).fit(rows) for s in range(starts)]
    best = min(fits, key=lambda m: m.summary.trainingCost)
    return best.transform(rows).select("file_id", (F.col("prediction") + 1).alias("label"))


def soma_pairs(somas: DataFrame, eps: float) -> DataFrame:
    """Pairs of somas within eps, found by cells of that size; each pair once."""
    cell = [F.floor(F.col(c) / eps).alias(n) for c, n in zip("xyz", "ijk")]
    a = somas.select(F.col("file_id").alias("a"), *[F.col(c).alias(f"a{c}") for c in "xyz"], *cell)
    steps = F.explode(F.array(*[F.struct(*[F.lit(d).alias(n) for d, n in zip((i, j, k), "ijk")]) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])).alias("s")
    b = somas.select(F.col("file_id").alias("b"), *[F.col(c).alias(f"b{c}") for c in "xyz"], *cell, steps).select("b", "bx", "by", "bz", *[(F.col(n) + F.col(f"s.{n}")).alias(n) for n in "ijk"])
    d = F.sqrt(sum(((F.col(f"a{c}") - F.col(f"b{c}")) ** 2 for c in "xyz"), F.lit(0.0)))
    return a.join(b, ["i", "j", "k"]).where(F.col("a") < F.col("b")).select("a", "b", d.alias("d")).where(F.col("d") <= eps)


def soma_dbscan(somas: DataFrame, eps: float, least: int) -> DataFrame:
    """Density clusters of somas. Noise is label 1, clusters count from 2 in order of their first file.

    A core soma has ``least`` somas within eps, itself counted; a border soma
    goes to the cluster that comes first.
    """
    pairs = soma_pairs(somas, eps)
    both = pairs.select("a", "b").unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.groupBy("a").agg((F.count(F.lit(1)) + 1).alias("n"))
    core = somas.select("file_id").join(near, F.col("file_id") == F.col("a"), "left").where(F.coalesce("n", F.lit(1)) >= least).select(F.col("file_id").alias("c"))
    inner = both.join(core, F.col("a") == F.col("c"), "left_semi").join(core, F.col("b") == F.col("c"), "left_semi")
    joined = connected_components(inner)
    own = core.join(joined, F.col("c") == F.col("vertex"), "left").select("c", F.coalesce("component", "c").alias("k"))
    border = both.join(core, F.col("a") == F.col("c"), "left_anti").join(own, F.col("b") == F.col("c")).groupBy("a").agg(F.min("k").alias("k"))
    of = own.unionAll(border.select(F.col("a").alias("c"), "k"))
    ids = [r[0] for r in own.select("k").distinct().orderBy("k").collect()]  # one row a cluster of a cohort
    number = somas.sparkSession.createDataFrame([(k, v + 2) for v, k in enumerate(ids)], "k string, label int")
    return somas.select("file_id").join(of, F.col("file_id") == F.col("c"), "left").join(number, "k", "left").select("file_id", F.coalesce("label", F.lit(1)).alias("label"))


def compared_partitions(a: np.ndarray, b: np.ndarray, ks: range = range(2, 21)) -> list[tuple[int, float, float]]:
    """Adjusted Rand index and normalised mutual information of two trees over one cohort, cut at each k."""
    out = []
    for k in ks:
        one, two = cut(a, k), cut(b, k)
        table = np.zeros((one.max() + 1, two.max() + 1))
        np.add.at(table, (one, two), 1)
        rows, cols, n = table.sum(1), table.sum(0), table.sum()
        pairs = lambda v: (v * (v - 1) / 2).sum()
        every = n * (n - 1) / 2
        expected, top = pairs(rows) * pairs(cols) / every, (pairs(rows) + pairs(cols)) / 2
        entropy = lambda v: -sum(x / n * np.log(x / n) for x in v.ravel() if x)
        mean = (entropy(rows) + entropy(cols)) / 2
        out.append((k, float((pairs(table) - expected) / (top - expected)) if top != expected else 1.0, float((entropy(rows) + entropy(cols) - entropy(table)) / mean) if mean else 1.0))
    return out


def compare_linkages(counts: DataFrame, first: str = "average", second: str = "ward", ks: range = range(2, 21)) -> DataFrame:
    """Two linkages of one cohort, of which all pairs are correlated, compared at each k: k, ari, nmi."""

    def work(batches):
        cohort = Cohort(batches)
        if len(cohort.ids) < 2:
            return {"k": [], "ari": [], "nmi": []}
        one = merged(correlation_distances(cohort, True), first)  # uses the matrix up
        two = merged(correlation_distances(cohort, True), second)
        return dict(zip(("k", "ari", "nmi"), zip(*compared_partitions(one, two, ks))))

    return _one_task(per_neuron(counts), work, "k int, ari double, nmi double")
