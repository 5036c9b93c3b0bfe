"""Clusters and distance-linked groups against brute force."""

import math
import random
from datetime import datetime, timedelta

import pytest

from arborlake.llm import clusters
from arborlake.runtime import is_number, read_table

T0 = datetime(2025, 1, 1)
NEURON = "file_id string, node_id int, parent_id int, region_id int, x double, y double, z double, loaded_at timestamp, n int, cell string, leaf string, i long"


def neuron(file, node, parent=-1, region=0, x=1.0, y=1.0, z=1.0, day=0):
    return (file, node, parent, region, x, y, z, T0 + timedelta(days=day), 7, "k", "f", 3)


def neurons(spark, rows):
    return spark.createDataFrame(rows, NEURON)


def brute_groups(points, eps):
    left, out = set(points), {}
    while left:
        todo = [left.pop()]
        group = set(todo)
        while todo:
            a = todo.pop()
            near = {b for b in left if math.dist(points[a], points[b]) <= eps}
            left -= near
            group |= near
            todo += near
        for a in group:
            out[a] = frozenset(group)
    return out


@pytest.mark.parametrize("limits", [{"radius": 60.0}, {"most_cells": 12}])
def test_probe_pairs_equal_brute_force(spark, limits):
    rng = random.Random(5)
    centres = [(rng.uniform(-400, 400), rng.uniform(-400, 400), rng.uniform(0, 300)) for _ in range(9)]
    points = {("f%d" % (k % 3), k): tuple(round(v + rng.gauss(0, 35), 2) for v in rng.choice(centres)) for k in range(500)}
    rows = [neuron(f, n, x=p[0], y=p[1], z=p[2]) for (f, n), p in points.items()]
    rows += rows[:50] + [neuron("f0", 1000, x=None), neuron("f0", 1001, y=math.nan), neuron("f0", 1002, z=math.inf), neuron(None, 3), neuron("f0", 1003, x=1e14, y=0.0, z=0.0), neuron("f0", 1004, x=1e300, y=1e300, z=0.0), neuron("f0", 1005, x=-1e300, y=1e300, z=0.0)]
    probes = [(k, "f%d" % (k % 3), k) for k in range(0, 500, 4)] + [(900, "f0", 0), (901, "f0", 1000), (902, None, 1), (None, "f0", 3), (903, "f0", 1003)]
    groups = brute_groups(points, 60.0)
    of = {p: groups[f, n] for p, f, n in probes if p is not None and (f, n) in groups and len(groups[f, n]) >= 12}
    want = {(a, b) for a in of for b in of if a < b and of[a] == of[b]}
    df, pr = neurons(spark, rows), spark.createDataFrame(probes, "probe_id long, file_id string, node_id int")
    assert {tuple(r) for r in clusters.probe_pairs(df, pr, 60.0, 12, **limits).collect()} == want
    got = {(r["file_id"], r["node_id"]): r["group_size"] for r in clusters.node_groups(df, 60.0, 12, **limits).collect()}
    assert got == {k: len(g) for k, g in groups.items() if len(g) >= 12}


def flat(points):
    """Groups by brute force, of points in any number, by cells."""
    return {k: len(g) for k, g in brute_groups(points, 60.0).items()}


@pytest.mark.parametrize("gap", [59.9, 60.0, 60.002])
def test_cells_that_face_each_other_at_the_limit(spark, gap):
    # Two crowded sheets, bent so that only one pair of points is at the gap: boxes cannot tell before they are tiny.
    rng = random.Random(7)
    points = {}
    for n in range(400):
        y, z = rng.uniform(0, 30), rng.uniform(0, 30)
        bend = ((y - 15) ** 2 + (z - 15) ** 2) / 1e4 + 1e-3
        points["f0", n], points["f0", 1000 + n] = (30.0 - bend, y, z), (30.0 + gap + bend, y, z)
    points["f0", 400], points["f0", 1400] = (30.0, 15.0, 15.0), (30.0 + gap, 15.0, 15.0)
    rows = [neuron(f, n, x=p[0], y=p[1], z=p[2]) for (f, n), p in points.items()]
    got = {(r["file_id"], r["node_id"]): r["group_size"] for r in clusters.node_groups(neurons(spark, rows), 60.0, 2).collect()}
    assert got == flat(points) and set(got.values()) == ({802} if gap <= 60 else {401})


def test_one_cell_with_half_of_all_rows_is_a_bounded_task(spark):
    rng = random.Random(8)
    rows = [neuron("f0", n, x=rng.uniform(0, 30), y=rng.uniform(0, 30), z=rng.uniform(0, 30)) for n in range(3000)]
    rows += [neuron("f1", n, x=200.0 + 50 * n, y=0.0, z=0.0) for n in range(60)]
    df = neurons(spark, rows)
    nodes = clusters.located(df, 60.0)
    cells = clusters.cell_sums(nodes)
    boxes = clusters._parts(nodes, cells.withColumn("width", clusters.F.lit(clusters._side(60.0))), clusters.PARTS)
    assert boxes.groupBy("cell").count().agg({"count": "max"}).first()[0] <= clusters.PARTS**3
    sizes = {r["group_size"] for r in clusters.node_groups(df, 60.0, 2).collect()}
    assert sizes == {3000, 60}


def test_far_coordinates_are_grouped_like_any_other(spark):
    at = [1e13, 1e13 + 50, 1e13 + 100, 1e13 + 200, 1e15, 1e15 + 59, 1e15 + 121, 1e17, 1e17 + 48, 3e25, 3e25, -3e25]
    points = {("f0", n): (x, 5.0, -x) if n < 9 else (x, 5.0, 1.0) for n, x in enumerate(at)}
    points |= {("f1", n): (x, 5.0, 1.0) for n, x in enumerate(at)}
    rows = [neuron(f, n, x=p[0], y=p[1], z=p[2]) for (f, n), p in points.items()]
    got = {(r["file_id"], r["node_id"]): r["group_size"] for r in clusters.node_groups(neurons(spark, rows), 60.0, 2).collect()}
    assert got == {k: n for k, n in flat(points).items() if n > 1}


def test_clusters_hold_all_nodes_and_name_typical_ones(spark, sf):
    df = read_table(spark, sf, "neurons")
    got = clusters.clusters(df, typical=2, radius=200.0).collect()
    placed = df.where(is_number("x") & is_number("y") & is_number("z")).select("file_id", "node_id").distinct().count()
    sizes = {r["cluster"]: r["n_nodes"] for r in got}
    assert sum(sizes.values()) == placed and len(sizes) > 3
    assert all(r["radius"] <= 200.0 for r in got)
    first = [r for r in got if r["rank"] == 1]
    assert all(r["distance"] <= 3 * r["radius"] + 1e-6 for r in first)
    assert all(r["rank"] in (1, 2) for r in got)
    assert clusters.node_clusters(df, radius=200.0).count() == placed
    assert clusters.clusters(df.limit(0)).count() == 0 and clusters.node_groups(df.limit(0)).count() == 0
