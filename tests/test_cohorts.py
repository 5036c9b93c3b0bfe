"""Linkage and distances of whole cohorts: in tasks of executors, without a largest number of neurons."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborlake.operators import clustering, correlation, exports, flatcorr, flatmap
from arborlake.plans import catalogue
from arborlake.plans.morphology import SIZE, nodes


@pytest.fixture
def no_driver(spark, monkeypatch):
    """No rows may come to the driver."""

    def held(*_):
        raise AssertionError("rows of the cohort on the driver")

    for name in ("toPandas", "collect"):
        monkeypatch.setattr(type(spark.range(1)), name, held)
    yield monkeypatch.undo


def brute(long_form, missing=-1.0):
    """Sorted ids and the matrix of correlations, None as ``missing``."""
    got = {(a, b): r for a, b, r in long_form.collect()}
    ids = sorted({a for a, _ in got})
    return ids, np.array([[1.0 if a == b else missing if got.get((a, b)) is None else got[a, b] for b in ids] for a in ids])


def test_correlation_clusters_in_a_task(spark, sf, no_driver):
    df = catalogue.queries()["cl02_correlation_clusters"](spark, sf)
    no_driver()
    ids, r = brute(correlation.pearson(correlation.voxel_counts(nodes(spark, sf), SIZE)))
    merges = clustering.linkage(clustering.distances(r))
    place = {v: p for p, v in enumerate(clustering.leaf_order(merges))}
    assert sorted(map(tuple, df.collect())) == [(f, int(c), place[v]) for v, (f, c) in enumerate(zip(ids, clustering.cut(merges, 8)))]


def test_rows_of_a_cohort_equal_the_pairs(spark):
    m = np.random.default_rng(4).integers(0, 2, (9, 10))
    m[5] = 1  # no variance
    m[6] = m[7]
    rows = [(f"n{a}", int(v), -int(v), 0, int(m[a, v])) for a in range(9) for v in range(10) if m[a, v]]
    counts = spark.createDataFrame(rows, "file_id string, i long, j long, k long, n long")
    cohort = correlation.Cohort(correlation.per_neuron(counts).toArrow().to_batches())
    for dense, long_form in ((True, correlation.dense_pearson(counts)), (False, correlation.pearson(counts))):
        ids, r = brute(long_form)
        assert cohort.ids == ids and (np.array([cohort.row(a, dense) for a in range(9)]) == r).all()
    empty = clustering.correlation_clusters(counts.limit(0), 3)
    assert empty.count() == 0 and clustering.correlation_clusters(counts.where("file_id = 'n5'"), 3).collect() == [("n5", 1, 0)]


def test_squares_on_disk_give_the_same_merges(monkeypatch):
    c = np.random.default_rng(6).normal(size=(40, 3))
    d = np.sqrt(((c[:, None] - c[None]) ** 2).sum(2))
    monkeypatch.setattr(clustering, "IN_MEMORY", 0)
    for method in ("average", "complete", "single", "ward"):
        square = clustering._square(40)
        square[:] = d
        assert isinstance(square, np.memmap) and (clustering.merged(square, method) == clustering.linkage(d, method)).all()


def test_linkages_are_compared_in_a_task(spark, sf, no_driver):
    df = catalogue.queries()["cl09_compared_linkages"](spark, sf)
    no_driver()
    _, r = brute(correlation.dense_pearson(correlation.voxel_counts(nodes(spark, sf), SIZE)))
    d = clustering.distances(r)
    want = clustering.compared_partitions(clustering.linkage(d, "average"), clustering.linkage(d, "ward"))
    assert sorted(map(tuple, df.collect())) == [(k, pytest.approx(a, abs=1e-6), pytest.approx(b, abs=1e-6)) for k, a, b in want]
    counts = spark.createDataFrame([("a", 0, 0, 0, 1)], "file_id string, i long, j long, k long, n long")
    assert clustering.compare_linkages(counts).count() == 0


def test_clusters_are_ordered_without_the_driver(spark, sf, no_driver):
    df = catalogue.queries()["exp01_ordered_clusters"](spark, sf)
    no_driver()
    want = catalogue.queries()["cl02_correlation_clusters"](spark, sf).collect()
    assert sorted((r["leaf_order"], r["file_id"], r["cluster_assignment"]) for r in df.collect()) == sorted((leaf + 1, f, label) for f, label, leaf in want)


def test_distances_in_leaf_order_by_blocks(spark, sf, no_driver, monkeypatch):
    df = catalogue.queries()["snk19_distances"](spark, sf)
    no_driver()
    counts = correlation.voxel_counts(nodes(spark, sf), SIZE)
    result = clustering.correlation_clusters(counts, 8).localCheckpoint()
    long_form = correlation.dense_pearson(counts)
    want = {(r[0], r[1]): r[2] for r in exports.ordered_distances(long_form, result).collect()}
    got = df.collect()
    assert len(got) == len(want) == result.count() ** 2 and all(abs(r[2] - want[r[0], r[1]]) < 1e-6 for r in got)
    # Several blocks; neurons without a place count in the correlation but have no row.
    monkeypatch.setattr(exports, "PAIRS_A_BLOCK", 100)
    some = result.withColumn("leaf", F.when(F.col("leaf") % 3 > 0, F.col("leaf")))
    want = {(r[0], r[1]): r[2] for r in exports.ordered_distances(long_form, some).collect()}
    assert {(r[0], r[1]): r[2] for r in exports.cohort_distances(counts, some).collect()} == want


def test_ward_of_points_equals_the_matrix():
    c = np.random.default_rng(8).normal(size=(300, 3))
    merges, want = clustering.ward_of_points(c), clustering.linkage(np.sqrt(((c[:, None] - c[None]) ** 2).sum(2)), "ward")
    assert np.allclose(merges, want) and (np.diff(merges[:, 2]) >= 0).all()


@pytest.mark.parametrize("method", ["ward", "single"])
def test_somas_of_any_number_are_clustered(spark, method):
    n = 5_200
    c = np.random.default_rng(9).normal(0, 1, (n, 3)) + np.repeat(np.arange(4), n // 4)[:, None] * 100
    somas = spark.createDataFrame([(f"n{v:05}", *map(float, p)) for v, p in enumerate(c)], "file_id string, x double, y double, z double")
    assert sorted(map(tuple, clustering.soma_clusters(somas, 4, method).collect())) == [(f"n{v:05}", 1 + v // (n // 4)) for v in range(n)]
    with pytest.raises(ValueError):
        clustering.soma_clusters(somas.limit(1), 4, method)


def test_flat_clusters_of_any_number_of_neurons(spark):
    n = 5_100
    flat = spark.range(n).select(F.format_string("n%05d", "id").alias("file_id"), *[(F.col("id") % 2 + 0.2).alias(c) for c in ("x", "y")], F.lit(10.0).alias("d"))
    flat = flat.unionAll(flat.select("file_id", F.lit(1.9), F.lit(1.9), "d").where("file_id < 'n00100'"))
    grid = flatmap.Grid((0.0, 2.0), (0.0, 2.0), 8, (0.0, 500.0), 100.0)
    got = sorted(map(tuple, flatcorr.correlation_clusters(flat, "x", "y", "d", 2, grid).select("file_id", "label").collect()))
    assert got == [(f"n{v:05}", 1 + v % 2) for v in range(n)]
