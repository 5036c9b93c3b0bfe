"""Voxel correlation of neurons: counts, Pearson over shared voxels, dense Pearson."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.operators.voxels import IJK, binned


def voxel_counts(nodes: DataFrame, size: float, files: list[str] | None = None) -> DataFrame:
    """Nodes per neuron and voxel."""
    from arborlake.operators.nodes import member

    return binned(member(nodes, "file_id", files), size).groupBy("file_id", *IJK).agg(F.count(F.lit(1)).alias("n"))


def input_nodes(nodes: DataFrame, size: float) -> DataFrame:
    """Exact number of contributing nodes."""
    return binned(nodes, size).agg(F.count(F.lit(1)).alias("n_nodes"))


def neuron_sums(counts: DataFrame) -> DataFrame:
    return counts.groupBy("file_id").agg(F.sum("n").cast("double").alias("s"), F.sum(F.col("n") * F.col("n")).cast("double").alias("q"))


def _pairs(counts: DataFrame) -> DataFrame:
    """Sums of products of neurons that share a voxel. The result is of that size by nature; voxels are the join key, and adaptive execution splits crowded ones."""
    a = counts.select(*IJK, F.col("file_id").alias("a"), F.col("n").alias("na"))
    b = counts.select(*IJK, F.col("file_id").alias("b"), F.col("n").alias("nb"))
    return a.join(b, list(IJK)).where("a < b").groupBy("a", "b").agg(F.sum(F.col("na") * F.col("nb")).cast("double").alias("sxy"))


def _r(v, sxy, sx, sy, qx, qy):
    spread = (v * qx - sx * sx) * (v * qy - sy * sy)
    return F.when(spread > 0, (v * sxy - sx * sy) / F.sqrt(spread))


def pearson(counts: DataFrame, symmetric: bool = True) -> DataFrame:
    """Pearson r of voxel counts over all occupied voxels, for neurons that share a voxel.

    Null where a neuron has no variance. ``symmetric`` adds the other
    triangle and the diagonal of 1. Output: swc_id_1, swc_id_2, r.
    """
    v = F.broadcast(counts.select(*IJK).distinct().agg(F.count(F.lit(1)).cast("double").alias("v")))
    sums = neuron_sums(counts)
    one = sums.select(F.col("file_id").alias("a"), F.col("s").alias("sx"), F.col("q").alias("qx"))
    two = sums.select(F.col("file_id").alias("b"), F.col("s").alias("sy"), F.col("q").alias("qy"))
    r = _r(*(F.col(c) for c in ("v", "sxy", "sx", "sy", "qx", "qy")))
    upper = _pairs(counts).join(one, "a").join(two, "b").crossJoin(v).select(F.col("a").alias("swc_id_1"), F.col("b").alias("swc_id_2"), r.alias("r"))
    if not symmetric:
        return upper
    lower = upper.select(F.col("swc_id_2").alias("swc_id_1"), F.col("swc_id_1").alias("swc_id_2"), "r")
    own = sums.select(F.col("file_id").alias("swc_id_1"), F.col("file_id").alias("swc_id_2"), F.lit(1.0).alias("r"))
    return upper.unionAll(lower).unionAll(own)


def square(long_form: DataFrame, ids: DataFrame) -> DataFrame:
    """All pairs of the given neurons; missing and null r are -1, the diagonal 1.

    The full grid is the result itself: use it for the neurons of a cohort
    (the number is checked against 20,000).
    """
    n = ids.count()
    if n > 20_000:
        raise ValueError(f"{n} neurons make too large a grid")
    a, b = ids.select(F.col("file_id").alias("swc_id_1")), ids.select(F.col("file_id").alias("swc_id_2"))
    full = a.crossJoin(F.broadcast(b)).join(long_form, ["swc_id_1", "swc_id_2"], "left")
    return full.select("swc_id_1", "swc_id_2", F.when(F.col("swc_id_1") == F.col("swc_id_2"), 1.0).otherwise(F.coalesce("r", F.lit(-1.0))).alias("r"))


def dense_pearson(counts: DataFrame) -> DataFrame:
    """Pearson r of all pairs of neurons, those that share no voxel too; 0 without variance, 1 on the diagonal."""
    sums = neuron_sums(counts)
    n = sums.count()
    if n > 20_000:
        raise ValueError(f"{n} neurons make too large a grid")
    v = F.broadcast(counts.select(*IJK).distinct().agg(F.count(F.lit(1)).cast("double").alias("v")))
    one = sums.select(F.col("file_id").alias("a"), F.col("s").alias("sx"), F.col("q").alias("qx"))
    two = F.broadcast(sums.select(F.col("file_id").alias("b"), F.col("s").alias("sy"), F.col("q").alias("qy")))
    grid = one.join(two, F.col("a") < F.col("b"))
    r = F.coalesce(_r(F.col("v"), F.coalesce("sxy", F.lit(0.0)), *(F.col(c) for c in ("sx", "sy", "qx", "qy"))), F.lit(0.0))
    upper = grid.join(_pairs(counts), ["a", "b"], "left").crossJoin(v).select(F.col("a").alias("swc_id_1"), F.col("b").alias("swc_id_2"), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)).alias("r"))
    lower = upper.select(F.col("swc_id_2").alias("swc_id_1"), F.col("swc_id_1").alias("swc_id_2"), "r")
    own = sums.select(F.col("file_id").alias("swc_id_1"), F.col("file_id").alias("swc_id_2"), F.lit(1.0).alias("r"))
    return upper.unionAll(lower).unionAll(own)


def per_neuron(counts: DataFrame) -> DataFrame:
    """The counts of each neuron as one row: file_id, v (i, j, k, n)."""
    return counts.groupBy("file_id").agg(F.collect_list(F.struct(*[F.col(c).cast("long").alias(c) for c in (*IJK, "n")])).alias("v"))


class Cohort:
    """All counts of a cohort in a task, from batches of ``per_neuron``: a few numbers a neuron and voxel.

    A row of its correlations is made when it is asked for, by the same sums and formula as ``pearson``.
    """

    def __init__(self, batches: Iterable):
        ids, lengths, parts = [], [], []
        for b in batches:
            v = b.column("v")
            ids += b.column("file_id").to_pylist()
            lengths.append(v.value_lengths().to_numpy(zero_copy_only=False))
            parts.append(np.array([f.to_numpy(zero_copy_only=False) for f in v.flatten().flatten()]))
        order = sorted(range(len(ids)), key=ids.__getitem__)
        self.ids = [ids[x] for x in order]
        place = np.empty(len(ids), int)
        place[order] = np.arange(len(ids))
        *at, n = np.concatenate(parts, axis=1) if parts else np.zeros((4, 0), int)
        neuron = place[np.repeat(np.arange(len(ids)), np.concatenate(lengths))] if parts else np.zeros(0, int)
        # Voxels get numbers; the counts lie by neuron, and once more by voxel.
        by = np.lexsort(at)
        new = np.any([c[by][1:] != c[by][:-1] for c in at], axis=0)
        voxel = np.empty(len(by), int)
        voxel[by] = np.concatenate(([0], np.cumsum(new))) if len(by) else 0
        self.voxels = int(voxel.max(initial=-1)) + 1
        mine = np.argsort(neuron, kind="stable")
        self.voxel, self.count, self.start = voxel[mine], n[mine], np.searchsorted(neuron[mine], np.arange(len(ids) + 1))
        self.others, self.theirs, self.first = neuron[by], n[by], np.searchsorted(voxel[by], np.arange(self.voxels + 1))
        self.s, self.q = (np.array([v[a:b].sum() for a, b in zip(self.start, self.start[1:])], float) for v in (self.count, self.count**2))

    def row(self, a: int, dense: bool, missing: float = -1.0) -> np.ndarray:
        """r of neuron a and all: of ``dense_pearson``, or of ``pearson`` with ``missing`` where that has none; 1 for itself."""
        own = slice(self.start[a], self.start[a + 1])
        sxy = np.zeros(len(self.ids))
        for v, n in zip(self.voxel[own], self.count[own]):
            there = slice(self.first[v], self.first[v + 1])
            sxy[self.others[there]] += n * self.theirs[there]
        total = float(self.voxels)
        spread = (total * self.q[a] - self.s[a] * self.s[a]) * (total * self.q - self.s * self.s)
        known = (spread > 0) & (dense | (sxy > 0))
        r = np.full(len(sxy), 0.0 if dense else missing)
        np.divide(total * sxy - self.s[a] * self.s, np.sqrt(spread, where=spread > 0, out=np.ones(len(sxy))), where=known, out=r)
        if dense:
            np.clip(r, -1.0, 1.0, out=r)
        r[a] = 1.0
        return r
