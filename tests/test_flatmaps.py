"""Flat-map tables, correlation, region cache, assignment sets, exports and point batches on small fixtures."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborlake.operators import assignments, assignmentsets, augment, clustering, exports, flatcorr, flatmap, regioncache, regions, summaries, voxels
from arborlake.operators import nodes as node_ops
from arborlake.sources import nrrd, store, swc, tables, volumes

LOOKUP = "i long, j long, k long, x_shaped float, y_shaped float, x_square float, y_square float, depth float"


@pytest.fixture(scope="module")
def lookup(spark):
    shaped = {1: (0.1, 0.5), 3: (1.9, 0.5)}
    square = {0: (10.1, 2.5), 1: (10.5, 2.5), 3: (11.9, 2.5)}
    rows = [(0, 0, k, *shaped.get(k, (-1.0, -1.0)), *square.get(k, (-1.0, -1.0)), 100.0 if k == 3 else -1.0) for k in range(4)]
    return spark.createDataFrame(rows, LOOKUP)


@pytest.fixture(scope="module")
def nodes(spark):
    rows = [("left.swc", 1, 1, -1, 0.0, 0.0, 0.0, "a"), ("right.swc", 1, 1, -1, 0.0, 0.0, 30.0, "b"), ("out.swc", 1, 1, -1, 0.0, 0.0, 90.0, None), ("none.swc", 1, 2, -1, None, 0.0, 1.0, "c")]
    return spark.createDataFrame(rows, "file_id string, node_id int, type int, parent_id int, x double, y double, z double, custom_note string")


def test_augmented_columns_of_both_styles(spark, lookup, nodes, tmp_path):
    got = {r["file_id"]: r for r in augment.augmented(nodes, lookup, 10.0, (1, 1, 4)).collect()}
    left, right = got["left.swc"], got["right.swc"]
    assert math.isnan(left["x_flat_shaped"]) and right["x_flat_shaped"] == pytest.approx(1.9)
    assert (left["x_flat_square"], right["x_flat_square"]) == (pytest.approx(10.1), pytest.approx(11.9))
    assert left["depth_um"] == right["depth_um"] == 100.0 and (left["depth_lookup_mode"], right["depth_lookup_mode"]) == ("mirrored_depth", "direct")
    assert (left["flatmap_shaped_lookup_mode"], right["flatmap_shaped_lookup_mode"]) == ("unmapped", "direct") and left["flatmap_square_lookup_mode"] == "direct"
    assert (left["flatmap_shaped_projection_valid"], right["flatmap_shaped_projection_valid"]) == (False, True)
    assert [got[f]["flatmap_shaped_invalid_code"] for f in ("left.swc", "right.swc", "out.swc", "none.swc")] == [3, 0, 2, 1]
    assert got["none.swc"]["depth_invalid_code"] == 1 and got["right.swc"]["custom_note"] == "b"
    path = str(tmp_path / "augmented")
    counts = augment.write_augmented(nodes, lookup, 10.0, (1, 1, 4), path)
    assert (counts["n_rows"], counts["n_shaped_valid"], counts["n_square_valid"], counts["n_depth_mirrored_depth"]) == (4, 1, 2, 1)
    again = spark.read.parquet(path)
    info = augment.transform_info(again.columns, tables.read_metadata(spark, path))
    assert info["styles"] == ["shaped", "square"] and info["has_v3_depth"] and info["grids"]["square"].x == (pytest.approx(10.1), pytest.approx(11.9))
    assert augment.augmented(again, lookup, 10.0, (1, 1, 4)).columns == again.columns  # augmenting again replaces the columns
    assert augment.transform_info(nodes.columns)["styles"] == [] and augment.grid_of({}, "shaped") is None
    with pytest.raises(ValueError):
        augment.style_of("round")
    assert augment.augmented(nodes.limit(0), lookup, 10.0, (1, 1, 4)).count() == 0


def test_single_style_takes_the_whole_mirrored_point(lookup, nodes):
    one = lookup.select("i", "j", "k", F.col("x_shaped").alias("x_flat"), F.col("y_shaped").alias("y_flat"), "depth")
    got = {r["file_id"]: r for r in augment.augmented_single(nodes, one, 10.0, (1, 1, 4), 15.0).collect()}
    assert got["left.swc"]["flatmap_lookup_mode"] == "mirrored" and got["left.swc"]["x_flat"] == pytest.approx(1.9) and got["left.swc"]["flatmap_invalid_code"] == 0
    assert got["right.swc"]["flatmap_lookup_mode"] == "direct" and got["none.swc"]["flatmap_invalid_code"] == 1 and got["out.swc"]["flatmap_lookup_mode"] == "unmapped"
    assert augment.augmented_single(nodes, one, 10.0, (1, 1, 4), 15.0, ["left.swc"]).count() == 1
    p, segments, summary = augment.projected_view(nodes, one, 10.0, (1, 1, 4), 15.0)
    assert p.count() == 4 and segments.count() == 0 and summary.agg(F.sum("n_nodes")).first()[0] == 4


def test_lookup_statistics_pad_degenerate_spans(spark, lookup):
    r = augment.lookup_stats(lookup, "x_shaped", "y_shaped", "depth").first()
    assert (r["n_xy"], r["n_depth"]) == (2, 1) and (r["y_low"], r["y_high"]) == (0.0, 1.0) and (r["depth_low"], r["depth_high"]) == (100.0, 101.0)
    none = augment.lookup_stats(lookup.limit(0), "x_shaped", "y_shaped", "depth").first()
    assert none["x_low"] is None and none["n_xy"] == 0
    with pytest.raises(ValueError):
        augment.lookup_set(lookup.where("k = 2"), 10.0, (1, 1, 4))


@pytest.fixture(scope="module")
def flat(spark):
    rng = np.random.default_rng(0)
    n = 1500
    x, y, d = rng.uniform(0, 2, n), rng.uniform(0, 1, n), np.where(rng.random(n) < 0.05, -1.0, rng.uniform(0, 500, n))
    bad = rng.random(n) < 0.1
    rows = [(f"n{k % 6}", k, None if k < 6 else k - 6, 1 if k < 6 else 2, float("nan") if b else float(a), float(c), float(e)) for k, (a, c, e, b) in enumerate(zip(x, y, d, bad))]
    rows.append(("bare", 1, None, 2, None, None, None))
    return spark.createDataFrame(rows, "file_id string, node_id int, parent_id int, type int, x double, y double, d double")


@pytest.mark.parametrize("collapse", [False, True])
def test_flat_correlation_equals_numpy(flat, collapse):
    grid = flatmap.Grid((0.0, 2.0), (0.0, 1.0), 8, (0.0, 500.0), 100.0)
    counts = flatcorr.bin_counts(flatcorr.rendered(flat, "x", "y", "d", grid, True, collapse))
    table = np.zeros((6, 7 * 64))
    for r in flat.where("x is not null and not isnan(x)").collect():
        plane = 0 if collapse or r["d"] == -1 else 1 + min(int(r["d"] // 100), 5)
        table[int(r["file_id"][1]), plane * 64 + min(int(r["y"] * 8), 7) * 8 + min(int(r["x"] / 2 * 8), 7)] += 1
    assert counts.agg(F.sum("n")).first()[0] == table.sum() == flatcorr.input_nodes(flat, "x", "y", "d", grid).first()[0]
    used = table[:, table.any(0)]
    want = np.corrcoef(used)
    for r in flatcorr.correlated(counts).collect():
        assert r["r"] == pytest.approx(want[int(r["swc_id_1"][1]), int(r["swc_id_2"][1])], abs=1e-9)
    assert [r[0] for r in flatcorr.unassigned(flat, counts).collect()] == ["bare"]
    labelled = flatcorr.correlation_clusters(flat, "x", "y", "d", 2, grid, collapse=collapse).collect()
    assert {r["file_id"] for r in labelled if r["label"] is None} == {"bare"} and len({r["label"] for r in labelled if r["label"]}) == 2
    with pytest.raises(ValueError):
        flatcorr.correlation_clusters(flat, "x", "y", "d", 2, grid, files=["n1"])
    with pytest.raises(ValueError):
        flatcorr.check_size(flatmap.Grid((0, 1), (0, 1), 20_000), True, False)


def test_soma_scales_halve_only_canonical_spans(flat):
    grid = flatmap.Grid((0.0, 2.0), (0.0, 1.0), 8, (0.0, 500.0), 100.0)
    assert flatcorr.soma_scales(flat, "x", "y", "d", 0.5, grid) == {"x": 1.0, "y": 1.0, "depth": 500.0, "depth_scale": 0.5}
    with pytest.warns(UserWarning):
        seen = flatcorr.soma_scales(flat, "x", "y", "d")
    assert 1.9 < seen["x"] <= 2.0
    somas = flatcorr.scaled_somas(flatmap.flat_somas(flat.withColumn("d", F.abs("d")), "x", "y", "d"), seen, with_depth=False)
    assert somas.where("z <> 0").count() == 0 and somas.count() <= 6


CELLS = [(i, j, k) for i in (0, 1) for j in (0, 1) for k in (0, 1)]


@pytest.fixture(scope="module")
def cache_input(spark):
    labels = np.array([[[2, 3], [2, 0]], [[3, 4], [0, 4]]])
    annotation = spark.createDataFrame([(i, j, k, int(labels[i, j, k])) for i, j, k in CELLS], "i long, j long, k long, region_id int")
    rows = [(i, j, k, -1.0 if (i, j, k) == (1, 1, 1) else float(i), -1.0 if (i, j, k) == (1, 1, 1) else float(j), 2.0 * i, 3.0 * j, -1.0 if (i, j, k) == (0, 0, 1) else 10.0 * k) for i, j, k in CELLS]
    tree = spark.createDataFrame([(1, "T", "Top", -1, "/1/"), (2, "B", "B", 1, "/1/2/"), (3, "C", "C", 1, "/1/3/"), (4, "D", "D", -1, "/4/"), (5, "E", "E", -1, "/5/")], "region_id int, acronym string, region_name string, parent_region_id int, structure_id_path string")
    return annotation, spark.createDataFrame(rows, LOOKUP), tree


def test_region_cache_is_built_opened_and_checked(spark, cache_input, tmp_path):
    annotation, lookup, tree = cache_input
    grids = {"shaped": flatmap.Grid((0.0, 1.0), (0.0, 1.0), 2, (0.0, 10.0), 10.0), "square": flatmap.Grid((0.0, 2.0), (0.0, 3.0), 2, (0.0, 10.0), 10.0)}
    about = {"lookup_set_id": "L", "atlas": "mouse_10um", "atlas_version": "1", "resolution_um": 10.0}
    path = str(tmp_path / "cache")
    regioncache.build_cache(annotation, lookup, tree, grids, path, (2, 2, 2), about)
    cache = regioncache.open_cache(spark, path)
    occupied = cache["tables"]["occupancy"].where("style = 'square'")
    # (0,0,1) has no depth of its own and takes that of (0,0,0): regions 2 and 3 meet in one bin.
    got = {(r["region_id"], r["d"], r["by"], r["bx"]): (r["n"], r["n_mirrored"]) for r in occupied.collect()}
    assert got == {(2, 0, 0, 0): (1, 0), (3, 0, 0, 0): (1, 1), (2, 0, 1, 0): (1, 0), (3, 0, 0, 1): (1, 0), (4, 1, 0, 1): (1, 0), (4, 1, 1, 1): (1, 0)}
    labels = regioncache.bin_labels(occupied)
    assert labels.where("d = 0 and by = 0 and bx = 0").first()["region_id"] == 2 and regioncache.collisions(labels).first()["n_collisions"] == 1
    of = {r["region_id"]: (r["footprint"], r["n_bins"]) for r in cache["tables"]["footprints"].where("style = 'square'").collect()}
    assert of == {1: (1, 3), 2: (2, 2), 3: (3, 2), 4: (4, 2)}
    assert regioncache.surface_of(cache, "square", 2).count() == 10 and regioncache.outlines_of(cache, "square", 2).count() == 6
    assert regioncache.region_slice(occupied, 4).count() == 2
    unions = regioncache.region_unions(occupied, tree)
    assert {r["footprint"]: r["n_components"] for r in regioncache.footprint_components(unions, regioncache.footprints(unions)).collect()} == {1: 1, 2: 1, 3: 1, 4: 1}
    m = cache["manifest"]
    assert regioncache.mismatches(m, "square", atlas="mouse_25um", shape=(2, 2, 2)) == [] and len(regioncache.mismatches(m, "square", atlas="rat_10um", lookup_set_id="K")) == 2
    assert regioncache.compatible([m], lookup_set_id="L") == [m] and regioncache.compatible([m], mirrored_depth=False) == []
    with pytest.raises(ValueError):
        regioncache.build_cache(annotation, lookup, tree, grids, path, (2, 2, 2), about | {"lookup_shape": (2, 2, 3)})
    with pytest.raises(ValueError):
        regioncache.build_cache(annotation, lookup, tree, grids | {"shaped": flatmap.Grid((0, 1), (0, 1), 2, (0.0, 20.0), 10.0)}, path, (2, 2, 2), about)
    store.write_text(spark, f"{path}/manifest.json", json.dumps(m | {"rows": {"square": m["rows"]["square"] | {"labels": 99}}}))
    with pytest.raises(ValueError, match="labels"):
        regioncache.open_cache(spark, path)
    with pytest.raises(FileNotFoundError):
        regioncache.open_cache(spark, str(tmp_path / "nothing"))
    assert regioncache.valid_regions([3, -1, 2, 3, None]) == [2, 3]
    with pytest.raises(ValueError):
        regioncache.valid_regions([0])


def test_assignment_sets(spark):
    sets = assignmentsets.AssignmentSets(spark)
    labels = lambda rows: spark.createDataFrame(rows, "file_id string, label int")
    a = sets.add("My Set", labels([("n1", 1), ("n2", None), ("n1", 1)]))
    b = sets.add("my set", labels([("n2", 2)]))
    c = sets.add_result("kmeans", labels([("n1", 7)]))
    assert (b.name, b.column) == ("my set 2", "cluster_my_set_2") and c.name == "kmeans 1" and sets.add_result("kmeans", labels([]), activate=False).name == "kmeans 2"
    files = labels([("n1", 0), ("n2", 0), ("n3", 0)])
    wide = {r["file_id"]: r.asDict() for r in sets.onto_files(files).collect()}
    assert wide["n1"][a.column] == 1 and wide["n2"][a.column] is None and wide["n2"][b.column] == 2 and wide["n3"][c.column] is None
    assert {r["file_id"]: r["label"] for r in sets.active_map(files).collect()} == {"n1": 7, "n2": None, "n3": None}
    assert sets.rename(b.set_id, "MY SET") == "MY SET 2" and b.column == "cluster_my_set_2"
    state = json.loads(json.dumps(sets.state()))
    back = assignmentsets.AssignmentSets.load(spark, state, sets.labels)
    assert back.active_id == c.set_id and back.of(a.set_id).collect() == sets.of(a.set_id).collect()
    back.delete(c.set_id)
    assert back.sets[back.active_id].name == "kmeans 2"
    back.activate(None)
    assert back.active_map(files).where("label is not null").count() == 0
    with pytest.raises(KeyError):
        back.activate("nothing")
    old = assignmentsets.AssignmentSets.load(spark, {"version": 1, "assignments": {"n1": "3", "n2": ""}}, sets.labels)
    assert old.of(old.active_id).collect() == [("n1", 3)]


def test_exports_in_leaf_order(spark, tmp_path):
    table = spark.createDataFrame([(f"n{f}", n, 1 if n == 1 else 3, float(25 * f), 0.0, 0.0, "R", f"neuron{f}", "s") for f in (1, 2, 3) for n in (1, 2)], "file_id string, node_id int, type int, x double, y double, z double, region_acronym string, neuron_id string, subject string")
    result = spark.createDataFrame([("n1", 1, 2), ("n2", 2, 0), ("n3", 1, 1), ("n4", None, None)], "file_id string, label int, leaf int")
    rows = exports.ordered_clusters(table, result).orderBy("leaf_order").collect()
    assert [(r["leaf_order"], r["file_id"], r["cluster_assignment"], r["soma_x"]) for r in rows] == [(1, "n2", 2, 50.0), (2, "n3", 1, 75.0), (3, "n1", 1, 25.0)]
    long_form = spark.createDataFrame([("n1", "n2", 0.5), ("n2", "n1", 0.5), ("n1", "n1", 1.0), ("n2", "n3", None), ("n2", "n2", 1.0)], "swc_id_1 string, swc_id_2 string, r double")
    d = {(r[0], r[1]): r[2] for r in exports.ordered_distances(long_form, result).collect()}
    assert d == {(3, 1): 0.5, (1, 3): 0.5, (3, 3): 0.0, (1, 1): 0.0, (1, 2): 2.0}
    assert exports.extended(table.withColumn("cluster_assignment", F.lit(9)), result).where("file_id = 'n2'").first()["cluster_assignment"] == 2
    path = str(tmp_path / "t")
    exports.write_extended(table, result, long_form, path, {"method": "average", "k": 2})
    assert tables.read_metadata(spark, path)["analysis"] == {"method": "average", "k": "2", "n_clustered": "3", "n_unassigned": "1", "n_clusters": "2"}
    assert spark.read.parquet(f"{path}.clusters").count() == 3


def test_partitions_compared(spark):
    a = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2), ("d", 2)], "file_id string, label int")
    b = spark.createDataFrame([("a", 5), ("b", 5), ("c", 6), ("d", 5)], "file_id string, label int")
    assert assignments.mutual_information(a, a).first()[0] == pytest.approx(1.0)
    ha, hb, hab = math.log(2), -(0.75 * math.log(0.75) + 0.25 * math.log(0.25)), 1.5 * math.log(2)
    assert assignments.mutual_information(a, b).first()[0] == pytest.approx((ha + hb - hab) / ((ha + hb) / 2))
    assert assignments.mutual_information(a.limit(0), b).first()[0] is None
    rng = np.random.default_rng(1)
    p = rng.normal(size=(12, 3))
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))
    one, two = clustering.linkage(d.copy(), "average"), clustering.linkage(d.copy(), "single")
    same = clustering.compared_partitions(one, one)
    assert [k for k, _, _ in same] == list(range(2, 21)) and all(x == pytest.approx(1.0) and y == pytest.approx(1.0) for _, x, y in same)
    assert any(x < 1 for _, x, _ in clustering.compared_partitions(one, two))


def test_histograms_share_edges_and_masks_leave_sources_out(spark):
    v = spark.createDataFrame([("a", 1.0), ("a", 0.0), ("b", 5.0), ("b", math.nan), ("c", 0.0)], "name string, n double")
    got = {(r["name"], r["bin"]): r["n"] for r in voxels.common_histograms(v, 4).collect()}
    assert got == {("a", 0): 1, **{("a", b): 0 for b in (1, 2, 3)}, ("b", 3): 1, **{("b", b): 0 for b in (0, 1, 2)}, **{("c", b): 0 for b in range(4)}}
    assert voxels.common_histograms(v.where("name = 'c'"), 4).count() == 0
    table = spark.createDataFrame([("a", "a", "s", 5.0, 5.0, 5.0), ("b", "b", "s", 6.0, 5.0, 5.0), ("c", "c", "s", 50.0, 5.0, 5.0)], "file_id string, neuron_id string, subject string, x double, y double, z double")
    mask = spark.createDataFrame([(0, 0, 0), (0, 0, 0)], "i long, j long, k long")
    ask = lambda **kw: {r["file_id"] for r in voxels.neurons_in_masks(table, mask, 10.0, **kw).collect()}
    assert ask() == {"a", "b"} and ask(sources=table.where("file_id = 'a'")) == {"b"} and ask(table=table.where("file_id <> 'b'")) == {"a"}
    assert voxels.world_bounds(mask, 10.0).first().asDict() == {"z_low": 0.0, "z_high": 15.0, "y_low": 0.0, "y_high": 15.0, "x_low": 0.0, "x_high": 15.0}


def test_layer_hierarchy(spark):
    r = spark.createDataFrame([(2, "b", "beta, layer 1"), (3, "a", "Alpha, layer 1"), (4, "", "x, layer 4")], "region_id int, acronym string, region_name string")
    layers = spark.createDataFrame([(2, "1"), (3, "1")], "region_id int, layer string")
    assert [(x["position"], x["region_id"]) for x in regions.layer_hierarchy(r, layers).orderBy("position").collect()] == [(1, 3), (2, 2)]
    for more in ((2, "4"), (4, "4"), (9, "4")):
        with pytest.raises(ValueError):
            regions.layer_hierarchy(r, layers.union(spark.createDataFrame([more], layers.schema)))


def test_point_batches_and_two_header_rows(spark, tmp_path):
    folder = tmp_path / "csv"
    folder.mkdir()
    (folder / "a.csv").write_text("Marker,Experiment,,Atlas,,,Region,,,\n,x,strength,x,y,z,name,acronym,id,hemisphere\nm1,9,0.5,1,2,3,Area,A,7,left\n")
    (folder / "b.CSV").write_text('Marker,Experiment,,Atlas,,,Region,,,\n,x,strength,x,y,z,name,acronym,id,hemisphere\n"m 2",9,,4,5,6,"Area, layer 1",,,\n')
    out = str(tmp_path / "points")
    assert tables.convert_point_folder(spark, str(folder), out) == {"discovered": 2, "processed": 2, "rows": 2}
    rows = spark.read.parquet(out).orderBy("x").collect()
    assert [(r["label"], r["x"], r["id"], r["region_name"], r["origin_csv"]) for r in rows] == [("m1", 1.0, 7, "Area", "a.csv"), ("m 2", 4.0, None, "Area, layer 1", "b.CSV")]
    assert {"experiment_x", "experiment_strength"} <= set(spark.read.parquet(out).columns)
    (tmp_path / "s.csv").write_text("label,x,y,z\nm,1,2,3\n")
    (tmp_path / "t.csv").write_text("marker,atlas_x,atlas_y,atlas_z,more\nm,1,2,3,4\n")
    assert tables.header_kind(spark, str(tmp_path / "t.csv"))[0] == "aliases" and tables.read_any(spark, str(tmp_path / "t.csv")).first()["x"] == 1.0
    with pytest.raises(ValueError, match="differ"):
        tables.convert_points(spark, [str(tmp_path / "s.csv"), str(tmp_path / "t.csv")], out)
    assert spark.read.parquet(out).count() == 2  # a failure leaves the table as it was
    (tmp_path / "u.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="not known"):
        tables.read_points(spark, str(tmp_path / "u.csv"))
    with pytest.raises(NotADirectoryError):
        tables.convert_point_folder(spark, str(tmp_path / "s.csv"), out)
    (tmp_path / "m.json").write_text('{"label":"a","x":"b","y":"c","z":"d"}')
    assert tables.load_mapping(spark, str(tmp_path / "m.json")) == {"a": "label", "b": "x", "c": "y", "d": "z"}


def test_projects_are_published_and_swc_written(spark, tmp_path):
    table = spark.createDataFrame([("a", 1, 1, 1.0, 2.0, 3.0, 0.5, -1), ("a", 2, None, None, math.nan, 3.0, None, 1)], "file_id string, node_id int, type int, x double, y double, z double, radius double, parent_id int")
    folder = str(tmp_path / "p")
    tables.save_project(folder, table, {"name": "one"})
    tables.save_project(folder, table.limit(1), {"name": "two"})
    manifest, rows = tables.load_project(spark, folder)
    assert manifest == {"name": "two"} and rows.count() == 1 and [p.name for p in tmp_path.iterdir()] == ["p"]
    assert [r["value"] for r in swc.swc_lines(table).orderBy("node_id").collect()] == ["1 1 1.000 2.000 3.000 0.500 -1", "2 0 nan nan 3.000 nan 1"]
    swc.write_swc(table, str(tmp_path / "swc"), rows_per_part=1)
    assert spark.read.text(str(tmp_path / "swc")).count() == 2
    tables.write_projected_csv(table.withColumn("x_flat", F.lit(1.5)), str(tmp_path / "csv"))
    first = spark.read.csv(str(tmp_path / "csv"), header=True)
    assert tuple(first.columns) == tables.PROJECTED and len(tables.PROJECTED) == 31 and first.first()["x_flat"] == "1.5" and first.first()["depth_um"] == "NaN"


def test_summaries_for_people(spark):
    rows = [("a", 1, -1, 1), ("a", 2, 1, 2), ("a", 3, 1, 3), ("b", 1, -1, 1)]
    table = spark.createDataFrame([(f, n, p, t, 5.0 if f == "a" else 95.0, 0.0, 5.0 if f == "a" else 95.0, "s", f, "R") for f, n, p, t in rows], "file_id string, node_id int, parent_id int, type int, x double, y double, z double, subject string, neuron_id string, region_acronym string")
    assert summaries.terminus_columns(table.columns) == [*summaries.TERMINUS_BASE, "subject", "region_acronym"]
    with pytest.raises(ValueError):
        summaries.terminus_columns(["file_id"])
    assert [(r["file_id"], r["node_id"]) for r in summaries.detected_termini(table, [2]).collect()] == [("a", 2)]
    assert summaries.coverage_sentence(table, [2]) == "1 termini (axon) in 1 of 2 neurons; 1 neurons without any; 2 childless nodes of other types not counted"
    text = summaries.soma_text(node_ops.hemisphere_summary(table, 50.0), "t", "z", 50.0)
    assert "left: 1 (50.00 %)" in text and "5.00 to 95.00" in text
    assert "0 somas" in summaries.soma_text(node_ops.hemisphere_summary(table.limit(0), 50.0), "t", "z", 50.0)
    checked = spark.createDataFrame([("f", 1, "m", "id,acronym"), ("f", 2, "n", None)], "origin_csv string, line_no int, label string, mismatches string")
    assert summaries.mismatch_text(checked, 2) == "1 of 2 points do not fit (acronym: 1, id: 1), among them m [id,acronym]"
    assert summaries.mismatch_text(checked.where("label = 'n'"), 1) == "1 points checked, no mismatches"
    atlas = spark.createDataFrame([(0, 0, 0, "right"), (9, 0, 9, "right")], "i long, j long, k long, side string")
    assert summaries.sides_by_atlas(table, atlas, 50.0, 10.0).collect() == [("a", "left", "right")]
    assert summaries.side_of(50.4, 50.0) == "midline" and summaries.check_resolution(25) == 25
    for bad in (lambda: summaries.check_resolution(30), lambda: summaries.target_side("midline")):
        with pytest.raises(ValueError):
            bad()
    colours = summaries.distinct_colours(9)
    assert len(set(map(summaries.hex_colour, colours))) == 9 and summaries.hex_colour((1, 0, 0.5, 1)) == "#ff0080"
    assert summaries.recoloured({"a": 1, "b": 2, "c": 1}, 1)["b"] == summaries.GREY and set(summaries.recoloured({"a": None, "b": 2}, None, False)) == {"a"}
    assert summaries.point_properties(checked)["label"] == ["m", "n"]
    with pytest.raises(ValueError):
        summaries.point_properties(checked, 1)


def test_volumes_are_decoded_once(spark, tmp_path):
    rng = np.random.default_rng(3)
    xy = {s: rng.uniform(0, 1, (2, 2, 3, 4)).astype("f4") for s in ("shaped", "square")}
    depth = rng.uniform(0, 100, (2, 3, 4)).astype("f4")
    paths = {}
    for kind, v in (*xy.items(), ("depth", depth)):
        paths[kind] = str(tmp_path / f"{kind}.nrrd")
        (tmp_path / f"{kind}.nrrd").write_bytes(nrrd.encode(v))
    cache = str(tmp_path / "cache")
    table, shape = volumes.lookup_table(spark, paths, cache)
    assert shape == (2, 3, 4) and table.count() == 24
    r = table.where("i = 1 and j = 2 and k = 3").first()
    assert r["depth"] == pytest.approx(float(depth[1, 2, 3])) and r["x_square"] == pytest.approx(float(xy["square"][0, 1, 2, 3])) and r["y_shaped"] == pytest.approx(float(xy["shaped"][1, 1, 2, 3]))
    made = sorted(p.stat().st_mtime_ns for p in (tmp_path / "cache").rglob("*.parquet"))
    volumes.lookup_table(spark, paths, cache)
    assert made == sorted(p.stat().st_mtime_ns for p in (tmp_path / "cache").rglob("*.parquet"))
    (tmp_path / "depth.nrrd").write_bytes(nrrd.encode(depth[:, :, :3]))
    with pytest.raises(ValueError, match="shapes differ"):
        volumes.lookup_table(spark, paths, cache)
    assert volumes.cached(spark, paths["depth"], cache, None).count() == 18


def test_vertex_order_over_blocks_of_ids_and_empty_masks(spark):
    rows = [("a", n) for n in (-7, -1, 0, 2, 3, 11, 40)] + [("b", 5), (None, 1)]
    table = spark.createDataFrame(rows, "file_id string, node_id int")
    got = {(r["file_id"], r["node_id"]): r["vertex"] for r in node_ops.in_order(table, block_ids=3).collect()}
    assert got == {("a", n): k for k, n in enumerate((-7, -1, 0, 2, 3, 11, 40))} | {("b", 5): 0, (None, 1): 0}
    places = spark.createDataFrame([("a", 1.0, 2.0, 3.0), ("b", None, 2.0, 3.0)], "file_id string, x double, y double, z double")
    mask = spark.createDataFrame([(0, 0, 0)], "i long, j long, k long")
    assert voxels.in_mask(places, mask, 10.0).count() == 1 and voxels.in_mask(places, mask.limit(0), 10.0).count() == 0
