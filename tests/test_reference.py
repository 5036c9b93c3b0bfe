"""Operators on nodes, trees, voxels and points on small fixtures with known results."""

import math
import os

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.sql import functions as F

from arborlake.operators import assignments, clustering, correlation, flatmap, morphology, nodes, points, regions, voxels
from arborlake.plans import catalogue
from arborlake.sources import nrrd, swc, tables
from arborlake.streaming import dropfolder

NODE = "file_id string, node_id int, parent_id int, type int, x double, y double, z double, region_id int, region_acronym string, neuron_id string, subject string"


def cells(spark, rows):
    """(file, node, parent, type, x[, region]) with y = z = x of the first file's rows given apart."""
    return spark.createDataFrame([(f, n, p, t, *((x,) * 3 if not isinstance(x, tuple) else x), 1, r, f, "s") for f, n, p, t, x, r in rows], NODE)


@pytest.fixture(scope="module")
def three(spark):
    rows = [("a", k + 1, p, t, 1.0, r) for k, (p, t, r) in enumerate(zip((-1, 1, 2, 2, 1, 5), (1, 2, 2, 2, 3, 3), ("R1", "R1", "R2", "R1", "R1", "R1")))]
    rows += [("b", k + 1, p, t, 1.0, r) for k, (p, t, r) in enumerate(zip((-1, 1, 2), (1, 2, 2), ("R1", "R1", "R2")))]
    rows += [("u", k + 1, p, t, 1.0, "R1") for k, (p, t) in enumerate(zip((-1, 1, 2), (1, 0, 0)))]
    return cells(spark, rows)


def keys(df):
    return {(r["file_id"], r["node_id"]) for r in df.collect()}


@pytest.mark.parametrize(
    "ids,parents,want",
    [((1, 2, 3, 4), (-1, 1, 2, 3), {4}), ((1, 2, 3, 4), (-1, 1, 2, 2), {3, 4}), ((100, 250, 375, 900), (-1, 100, 250, 250), {375, 900}), ((4, 3, 2, 1), (3, 2, 1, -1), {4}), ((1,), (-1,), {1}), ((1, 2), (-1, 99), {1, 2})],
)
def test_childless(spark, ids, parents, want):
    df = cells(spark, [("f", n, p, 2, 0.0, "") for n, p in zip(ids, parents)])
    assert {n for _, n in keys(morphology.childless(df))} == want


def test_termini_filter_only_what_is_reported(three):
    assert keys(morphology.termini(three, [2])) == {("a", 3), ("a", 4), ("b", 3)}
    assert keys(morphology.termini(three, [2], ["R1"])) == {("a", 4)}
    assert keys(morphology.termini(three, [])) == set()
    r = morphology.coverage_summary(morphology.coverage(three, [2])).first()
    assert (r["n_with"], r["n_without"], r["n_termini"], r["n_other"]) == (2, 1, 3, 2)


def test_edges_and_slabs(spark):
    df = cells(spark, [("f", 1, -1, 1, (0.0, 0.0, 0.0), ""), ("f", 2, 1, 2, (0.0, 0.0, 10.0), ""), ("f", 3, 99, 2, (0.0, 0.0, 5.0), "")])
    e = morphology.edges(df)
    assert keys(e) == {("f", 2)}
    assert morphology.slab_segments(e, "z", 5.0, 1.0).count() == 1 and morphology.slab_segments(e, "z", 12.0, 1.0).count() == 0
    assert morphology.cable_length(e).first()["length"] == 10.0


def test_lists_none_and_empty(three):
    assert nodes.member(three, "file_id", None).count() == 12 and nodes.member(three, "file_id", []).count() == 0
    assert nodes.without(three, "file_id", ["a"]).count() == 6 and nodes.without(three, "file_id", []).count() == 12
    assert nodes.node_types([3, 2, 2], soma_only=True) == [2, 3] and nodes.node_types(None, True) == [1]
    assert nodes.neurons_touching(three, ["R2"], types=[2]).count() == 2


def test_soma_radius(spark):
    at = {"a": ((1, 0), (3, 50), (4, 125)), "b": ((1, 200), (1, 300), (3, 320), (4, 380)), "c": ((3, 25),)}
    df = cells(spark, [(f, k, -1, t, (float(x), 0.0, 0.0), "") for f, rows in at.items() for k, (t, x) in enumerate(rows)])
    near = voxels.heatmap(df, 25.0, (20, 2, 2), types=[3, 4], radius=100.0)
    assert {r["i"]: r["n"] for r in near.collect()} == {2: 1, 12: 1}
    every = {r["i"]: r["n"] for r in voxels.heatmap(df, 25.0, (20, 2, 2), types=[3, 4]).collect()}
    assert sum(every.values()) == 5 and every[1] == 1


def test_hemispheres(spark):
    df = cells(spark, [("a", 1, -1, 1, (0.0, 0.0, 10.0), ""), ("b", 1, -1, 1, (0.0, 0.0, 49.5), ""), ("c", 1, -1, 1, (0.0, 0.0, 50.2), ""), ("d", 1, -1, 1, (0.0, 0.0, 90.0), ""), ("i", 1, -1, 2, (0.0, 0.0, 999.0), "")])
    r = nodes.hemisphere_summary(df, 50.0).first()
    assert (r["n_somas"], r["n_left"], r["n_midline"], r["n_right"], r["least"], r["greatest"]) == (4, 1, 2, 1, 10.0, 90.0) and abs(r["mean"] - 49.925) < 1e-9
    turned = {r["file_id"]: r["z"] for r in nodes.flipped(df, "left", 50.0).collect()}
    assert turned == {"a": 10.0, "b": 49.5, "c": 50.2, "d": 10.0, "i": 999.0}


def test_voxel_rules(spark):
    df = spark.createDataFrame([(-0.5,), (0.5,), (1.5,), (2.5,)], "x double")
    from arborlake.functions.columns import voxel

    got = [tuple(r) for r in df.select(*[voxel("x", 1.0, r).alias(r) for r in ("floor", "truncate", "round", "half_up")]).collect()]
    assert got == [(-1, 0, 0, 0), (0, 0, 0, 1), (1, 1, 2, 2), (2, 2, 2, 3)]


def test_smoothing_equals_dense_convolution(spark):
    rng = np.random.default_rng(0)
    v = np.where(rng.random((7, 5, 4)) < 0.3, rng.integers(1, 9, (7, 5, 4)), 0).astype(float)
    df = spark.createDataFrame([(int(i), int(j), int(k), float(v[i, j, k])) for i, j, k in np.argwhere(v > 0)], "i long, j long, k long, n double")
    want, sigma = v.copy(), 0.8
    reach = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    w /= w.sum()
    for axis in range(3):
        padded = np.pad(want, [(reach, reach) if a == axis else (0, 0) for a in range(3)], mode="edge")
        want = sum(w[d] * np.take(padded, range(d, d + v.shape[axis]), axis) for d in range(2 * reach + 1))
    got = np.zeros_like(v)
    for r in voxels.smoothed(df, sigma, v.shape).collect():
        got[r["i"], r["j"], r["k"]] = r["n"]
    assert np.allclose(got, want, atol=1e-12)
    assert voxels.smoothed(df, 0.0, v.shape).count() == df.count()


def test_raster_algebra(spark):
    v = spark.createDataFrame([(0, 0, k, n) for k, n in enumerate([1, 1, 2, 9, 10, 10])], "i long, j long, k long, n long")
    assert voxels.otsu(v) == 1.75  # the centre of the first of the best bins
    with pytest.raises(ValueError):
        voxels.threshold_mask(v, 0)
    assert voxels.threshold_mask(v, 2, 9).count() == 2
    assert {r["k"]: r["voxel_id"] for r in voxels.voxel_numbers(v).collect()} == {k: k for k in range(6)}
    assert sum(r["n"] for r in voxels.histogram(v, 4).collect()) == 6
    one = v.where("k = 3")
    faces = voxels.exposed_faces(one)
    assert faces.count() == 6 and voxels.face_vertices(faces).count() == 8
    pair = v.where("k in (3, 4)")
    assert voxels.exposed_faces(pair).count() == 10 and voxels.face_vertices(voxels.exposed_faces(pair)).count() == 12
    parts = voxels.voxel_components(v.where("k <> 2")).groupBy("component").count().collect()
    assert sorted(r["count"] for r in parts) == [2, 3]
    grown = voxels.dilated(one, 5.0, (1, 3, 9))
    assert grown.count() >= 5 and voxels.dilated(one, 0.0, (1, 1, 9)).count() == 1


def test_dilation_reaches_the_wanted_volume_however_far(spark):
    one = spark.createDataFrame([(0, 0, 0)], "i long, j long, k long")
    assert {r["k"] for r in voxels.dilated(one, 149.5, (1, 1, 200)).collect()} == set(range(151))
    assert voxels.dilated(one, 1e6, (1, 2, 200)).count() == 400


def test_dilation_equals_brute_force(spark):
    shape, rng = (9, 7, 8), np.random.default_rng(3)
    first = {tuple(map(int, rng.integers(0, shape))) for _ in range(5)} | {(-1, 3, 3)}
    d2 = {p: min(sum((a - b) ** 2 for a, b in zip(p, q)) for q in first) for p in np.ndindex(*shape)}
    for fraction in (1.0, 9.0, 40.0, 75.0):
        limit = next(d for d in sorted(set(d2.values())) if sum(v <= d for v in d2.values()) >= len(first) * (1 + fraction))
        grown = voxels.dilated(spark.createDataFrame(sorted(first), "i long, j long, k long"), fraction, shape)
        assert {tuple(r) for r in grown.collect()} == {p for p, v in d2.items() if v <= limit}


def test_majority_takes_the_least_region_in_ties(spark):
    df = spark.createDataFrame([(0, 0, 0, 5), (0, 0, 0, 3), (0, 0, 1, 7), (0, 0, 1, 7), (0, 0, 1, 2)], "i long, j long, k long, region_id int")
    assert {r["k"]: (r["region_id"], r["n_labels"]) for r in voxels.majority_labels(df).collect()} == {0: (3, 2), 1: (7, 2)}


def test_pearson_equals_numpy(spark):
    rng = np.random.default_rng(1)
    m = rng.integers(0, 3, (5, 12))
    m[4] = 0
    m[4, 0] = 2
    rows = [(f"n{a}", 0, 0, int(v), int(m[a, v])) for a in range(5) for v in range(12) if m[a, v]]
    counts = spark.createDataFrame(rows, "file_id string, i long, j long, k long, n long")
    used = m[:, m.sum(0) > 0]
    want = np.corrcoef(used)
    dense = {(r[0], r[1]): r[2] for r in correlation.dense_pearson(counts).collect()}
    assert all(abs(dense[f"n{a}", f"n{b}"] - want[a, b]) < 1e-9 for a in range(5) for b in range(5))
    sparse = {(r[0], r[1]): r[2] for r in correlation.pearson(counts).collect()}
    assert all(((f"n{a}", f"n{b}") in sparse) == bool((m[a] * m[b]).any()) for a in range(5) for b in range(5) if a != b)
    full = correlation.square(correlation.pearson(counts), counts.select("file_id").distinct())
    assert full.count() == 25 and full.where("r = -1").count() == 25 - len(sparse)


def brute_linkage(d, method):
    groups, out = [[k] for k in range(len(d))], []
    between = {"single": np.min, "complete": np.max, "average": np.mean}[method]
    while len(groups) > 1:
        h, a, b = min((between(d[np.ix_(x, y)]), a, b) for a, x in enumerate(groups) for b, y in enumerate(groups) if a < b)
        out.append(h)
        groups[a] = groups[a] + groups.pop(b)
    return out


@pytest.mark.parametrize("method", ["single", "complete", "average"])
def test_linkage_heights(method):
    rng = np.random.default_rng(2)
    c = rng.normal(size=(25, 3))
    d = np.sqrt(((c[:, None] - c[None]) ** 2).sum(2))
    merges = clustering.linkage(d, method)
    assert np.allclose(merges[:, 2], sorted(brute_linkage(d, method)))
    labels = clustering.cut(merges, 4)
    assert len(set(labels)) == 4 and sorted(clustering.leaf_order(merges)) == list(range(25))
    assert -1 <= clustering.cophenetic_spearman(d, merges) <= 1


def test_ward_joins_tight_groups():
    c = np.concatenate([np.random.default_rng(k).normal(100 * k, 1, (6, 3)) for k in range(3)])
    labels = clustering.cut(clustering.linkage(np.sqrt(((c[:, None] - c[None]) ** 2).sum(2)), "ward"), 3)
    assert [len(set(labels[k * 6 : k * 6 + 6])) for k in range(3)] == [1, 1, 1] and len(set(labels)) == 3


def test_dbscan_marks_noise_with_1(spark):
    at = {"a": 0.0, "b": 1.0, "c": 2.0, "d": 50.0, "e": 51.0, "f": 52.0, "g": 500.0, "h": 3.0}
    somas = spark.createDataFrame([(f, x, 0.0, 0.0) for f, x in at.items()], "file_id string, x double, y double, z double")
    assert {r[0]: r[1] for r in clustering.soma_dbscan(somas, 1.5, 3).collect()} == {"a": 2, "b": 2, "c": 2, "h": 2, "d": 3, "e": 3, "f": 3, "g": 1}


def test_kmeans_query_takes_the_best_of_ten_starts(spark, sf, monkeypatch):
    fits, fit = {}, KMeans.fit
    monkeypatch.setattr(KMeans, "fit", lambda self, rows: fits.setdefault(self.getSeed(), fit(self, rows)))
    got = catalogue.queries()["cl06_soma_kmeans"](spark, sf).groupBy("label").count().collect()
    assert sorted(fits) == list(range(42, 52))
    best = min(fits.values(), key=lambda m: m.summary.trainingCost)
    assert {r["label"] - 1: r["count"] for r in got} == {v: n for v, n in enumerate(best.summary.clusterSizes) if n}


def test_projection_codes_and_mirrored_depth(spark):
    lookup = spark.createDataFrame([(0, 0, 1, 0.1, 0.5, -1.0), (0, 0, 3, 1.9, 0.5, 100.0), (0, 0, 0, -1.0, -1.0, -1.0)], "i long, j long, k long, x_flat double, y_flat double, depth double")
    df = cells(spark, [("left", 1, -1, 1, (0.0, 0.0, 0.0), ""), ("right", 1, -1, 1, (0.0, 0.0, 30.0), ""), ("out", 1, -1, 1, (0.0, 0.0, 99.0), ""), ("none", 1, -1, 1, (0.0, math.nan, 0.0), "")])
    got = {r["file_id"]: r for r in flatmap.project(df, lookup, 10.0, (1, 1, 4)).collect()}
    assert [got[f]["invalid_code"] for f in ("left", "right", "out", "none")] == [3, 0, 2, 1]
    assert got["left"]["depth_um"] == 100.0 and got["left"]["depth_mode"] == "mirrored_depth" and got["left"]["x_flat"] is None
    assert got["right"]["depth_mode"] == "direct" and got["right"]["x_flat"] == 1.9
    both = {r["file_id"]: r for r in flatmap.project_with_mirror(df, lookup, 10.0, (1, 1, 4), 15.0).collect()}
    assert both["left"]["lookup_mode"] == "mirrored" and both["left"]["x_flat"] == 1.9


def test_collapsed_is_the_sum_of_planes(spark):
    rng = np.random.default_rng(0)
    rows = [(f"f{k % 6}", k, float(rng.random()), float(rng.random()), float(rng.choice([-1, rng.random() * 900]))) for k in range(800)]
    df = spark.createDataFrame(rows, "file_id string, node_id int, x double, y double, d0 double")
    grid = flatmap.Grid((0, 1), (0, 1), 8, (0, 900), 100)
    planes = flatmap.flat_heatmap(df, "x", "y", "d0", grid, sentinel=True).groupBy("by", "bx").agg(F.sum("n").alias("n"))
    flat = flatmap.flat_heatmap(df, "x", "y", "d0", grid, collapse=True, sentinel=True).select("by", "bx", "n")
    assert set(map(tuple, planes.collect())) == set(map(tuple, flat.collect()))
    per_file = flatmap.flat_heatmap(df, "x", "y", "d0", grid, by=["file_id"])
    a = spark.createDataFrame([("f0", 1), ("f1", 1)], "file_id string, label int")
    assert flatmap.grouped_heatmap(per_file, a).agg(F.sum("n")).first()[0] == flatmap.flat_heatmap(df, "x", "y", "d0", grid).agg(F.sum("n")).first()[0]


def test_points(spark, tmp_path):
    raw = spark.createDataFrame([(" m ", "1", "2", "3", "x"), ("n", "1e1", "2", "3", None)], "marker string, atlas_x string, atlas_y string, atlas_z string, origin_csv string")
    mapping = {"marker": "label", "atlas_x": "x", "atlas_y": "y", "atlas_z": "z"}
    got = points.with_origin(points.standardised(raw, mapping))
    assert got.columns == ["label", "x", "y", "z", "region_name", "acronym", "id", "hemisphere", "origin_csv"]
    assert [(r["label"], r["x"], r["origin_csv"]) for r in got.collect()] == [("m", 1.0, "x"), ("n", 10.0, "(not recorded)")]
    assert points.groups(got).count() == 2 and points.of_groups(got, [("m", "x")]).count() == 1 and points.of_groups(got, [("n", " ")]).count() == 1
    with pytest.raises(ValueError, match="invalid values"):
        points.standardised(raw.withColumn("atlas_x", F.lit("nan")), mapping)
    with pytest.raises(ValueError, match="missing"):
        points.standardised(raw)
    with pytest.raises(ValueError, match="schemas differ"):
        points.appended(got, got.withColumn("more", F.lit(1)))
    csv = tmp_path / "p.csv"
    csv.write_text('label,x,y,z\n"a ""b""",1,2,3\n')
    table = str(tmp_path / "points")
    tables.write_table(tables.read_points(spark, str(csv)), table, {"made": "here"})
    assert tables.read_metadata(spark, table) == {"made": "here"}
    assert tables.append_points(spark, table, str(csv)) == 1 and spark.read.parquet(table).count() == 2
    assert tables.two_row_header(["Marker", "Atlas", "", ""], ["", "x", "y", "z pos"]) == ["marker", "atlas_x", "atlas_y", "atlas_z_pos"]


def test_swc_round_trip_and_failures(spark, tmp_path):
    (tmp_path / "123_45_x.swc").write_text("# c\n1 1 10 20 30 5 -1\n2.0 3 11 21 31 1 1 extra # inline\n\n3 2\n")
    (tmp_path / "bad.SWC").write_text("1 1 a 20 30 5 -1\n")
    (tmp_path / "empty.swc").write_text("# nothing\n")
    paths = swc.discover(spark, str(tmp_path))
    assert [os.path.basename(p) for p in paths] == ["123_45_x.swc", "bad.SWC", "empty.swc"]
    out = str(tmp_path / "nodes")
    got = swc.convert(spark, paths, out, hemisphere="left", midline=20.0)
    assert (got["discovered"], got["processed"], got["failed"], got["flipped"], got["rows"]) == (3, 1, 2, 1, 2)
    df = spark.read.parquet(out)
    assert tuple(df.columns) == swc.NODE_COLUMNS
    first = df.orderBy("node_id").first()
    assert (first["subject"], first["neuron_id"], first["z"], first["region_acronym"]) == ("45", "123", 10.0, "")
    assert swc.append(spark, paths, out) == 2  # both bad ones are new, and fail again
    assert [r["value"] for r in swc.swc_lines(df).orderBy("node_id").collect()][0] == "1 1 10.000 20.000 10.000 5.000 -1"


def test_stream_appends_new_files_once(spark, tmp_path):
    drop = tmp_path / "drop"
    drop.mkdir()
    (drop / "a.swc").write_text("1 1 1 2 3 1 -1\n2 2 1 2 3 1 1\n")
    run = lambda: dropfolder.follow(spark, str(drop), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination(60)
    run()
    (drop / "b.swc").write_text("1 1 1 2 3 1 -1\n")
    run()
    assert spark.read.parquet(str(tmp_path / "t")).groupBy("file_id").count().orderBy("file_id").collect() == [("a.swc", 2), ("b.swc", 1)]


def test_nrrd(spark, tmp_path):
    v = np.arange(24, dtype="f4").reshape(2, 3, 4)
    (tmp_path / "v.nrrd").write_bytes(nrrd.encode(v, {"space origin": "(1,2,3)", "space directions": "(2,0,0) (0,2,0) (0,0,2)"}))
    header, back = nrrd.decode((tmp_path / "v.nrrd").read_bytes())
    assert (back == v).all() and nrrd.transform(header)[0].tolist() == [1, 2, 3]
    got = {(r["i"], r["j"], r["k"]): r["value"] for r in nrrd.read_nrrd(spark, str(tmp_path / "v.nrrd")).collect()}
    assert len(got) == 23 and got[1, 2, 3] == 23.0
    assert nrrd.components_last(np.zeros((2, 3, 4, 5))).shape == (3, 4, 5, 2)


def test_nrrd_slabs_transforms_and_sets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(nrrd, "SLAB_VOXELS", 8)
    v = np.arange(1, 61, dtype=">i2").reshape(3, 4, 5)
    (tmp_path / "depth_a.nrrd").write_bytes(nrrd.encode(v.astype("<i2")))
    got = {(r["i"], r["j"], r["k"]): r["value"] for r in nrrd.read_nrrd(spark, str(tmp_path / "depth_a.nrrd")).collect()}
    assert got == {(i, j, k): float(v[i, j, k]) for i in range(3) for j in range(4) for k in range(5)}
    flat = np.random.default_rng(0).normal(size=(2, 3, 4, 5)).astype("f4")
    for name in nrrd.LOOKUP_FILES.values():
        if name != "depth.nrrd":
            (tmp_path / name).write_bytes(nrrd.encode(flat))
    found = nrrd.discover_lookups(spark, str(tmp_path))
    assert found["depth"].endswith("depth_a.nrrd")
    rows = nrrd.read_nrrd(spark, found["shaped"]).collect()
    assert len(rows) == 60 and all(r["x_flat"] == pytest.approx(float(flat[0, r["i"], r["j"], r["k"]])) for r in rows)
    (tmp_path / "depth_b.nrrd").write_bytes(nrrd.encode(flat))
    with pytest.raises(FileNotFoundError):
        nrrd.discover_lookups(spark, str(tmp_path))
    h = {"space directions": "(2,0,0) (0,2,0) (0,0,2)", "space origin": "(0,0,0)"}
    assert nrrd.agreed_transform({"a": h, "b": {}}, (2.0, 2.0, 2.0))[1][0, 0] == 2.0
    for headers, size in (({"a": h, "b": {}}, None), ({"a": h, "b": {}}, (1.0, 1.0, 1.0)), ({"a": h, "b": h | {"space origin": "(1,0,0)"}}, None), ({"a": h}, (1.0, 1.0, 1.0))):
        with pytest.raises(ValueError):
            nrrd.agreed_transform(headers, size)


def test_assignments_and_regions(spark):
    assert assignments.assignment_column("My Set!", {"cluster_my_set"}) == "cluster_my_set_2"
    assert assignments.leaf_sample(10, 4) == [0, 3, 6, 9]
    table = spark.createDataFrame([("a", 1), ("b", 2), ("c", None)], "file_id string, label int")
    assert assignments.filtered(table, [], False).count() == 3 and assignments.filtered(table, [1], True).count() == 2
    assert [r["label"] for r in assignments.cluster_counts(table).collect()] == [1, 2, None]
    assert assignments.adjusted_rand(table.where("label is not null"), table.where("label is not null")).first()["ari"] == 1.0
    r = spark.createDataFrame([(1, "T", "Top", -1, "/1/"), (2, "A1", "Area, layer 1", 1, "/1/2/"), (3, "A6", "Area/Layer 6a", 1, "/1/3/")], "region_id int, acronym string, region_name string, parent_region_id int, structure_id_path string")
    assert {x["region_id"]: x["layer"] for x in regions.layer_map(r).collect()} == {2: "1", 3: "6a"}
    assert regions.descendants(r, 1).count() == 3 and regions.ancestors(r).count() == 2
    with pytest.raises(ValueError):
        regions.require_layers(regions.layer_map(r))
    assert regions.digest(r) == regions.digest(r.orderBy(F.desc("region_id")))


def test_all_sql_has_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
