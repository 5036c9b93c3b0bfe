"""Queries on nodes, trees, regions, voxels, flat maps, correlation and assignments, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborlake.functions.columns import finite, layer_of, plain_bin, region_key, slug, voxel
from arborlake.operators import assignments as A
from arborlake.operators import clustering as CL
from arborlake.operators import compare as CMP
from arborlake.operators import correlation as COR
from arborlake.operators import flatmap as FM
from arborlake.operators import morphology as M
from arborlake.operators import nodes as N
from arborlake.operators import points as P
from arborlake.operators import regions as R
from arborlake.operators import voxels as V
from arborlake.plans.dealt import CSV_POINTS
from arborlake.runtime import read_table as t
from arborlake.runtime import times_as_text, written
from arborlake.sources import csv_points, swc

MIDLINE = 5695.0
SIZE = 100.0
SHAPE = (133, 81, 116)
GRID = FM.Grid((0.0, 1.0), (0.0, 1.0), 50, (0.0, 2000.0), 100.0)
COLUMNS = "file_id, node_id, type, x, y, z, radius, parent_id, region_id, region_name, region_acronym, subject, neuron_id"

# Inputs, each with the SQL that says the same.


def nodes(s, d):
    """Each node once. Repeats agree, so columns are picked one by one: those that a query does not use are never read."""
    rest = [c for c in COLUMNS.split(", ") if c not in ("file_id", "node_id")]
    return t(s, d, "neurons").groupBy("file_id", "node_id").agg(*[F.min(c).alias(c) for c in rest])


def flat_nodes(s, d):
    """Nodes with flat-map columns made of their own: un-annotated ones are holes, somas at the depth mark."""
    hole = F.col("region_id") == 0
    return nodes(s, d).withColumns({
        "fx": F.when(hole, -1.0).otherwise(F.col("x") / 13230.0), "fy": F.when(hole, -1.0).otherwise(F.col("y") / 8000.0),
        "fd": F.when(F.col("type") == 1, -1.0).when(F.col("subject").isNotNull(), F.col("z") / 6.0),
    })


def annotation(s, d, of=None):
    """Label volume: the region of most nodes per voxel."""
    return V.majority_labels(V.binned((nodes(s, d) if of is None else of).where("region_id > 0"), SIZE)).select("i", "j", "k", "region_id")


def with_annotation(s, d, columns, f):
    """``f`` of the nodes and their label volume; the nodes are made distinct once, as a table, for both."""
    n = written(nodes(s, d).select("file_id", "node_id", "x", "y", "z", "region_id", *columns))
    return f(n, annotation(s, d, n))


def lookup(s, d, of=None):
    """Flat-map lookup over the label volume, with holes and depths below the midline only."""
    hole = F.col("j") < 20
    return (annotation(s, d) if of is None else of).select("i", "j", "k", F.when(hole, -1.0).otherwise(F.col("i") / 133.0).alias("x_flat"), F.when(hole, -1.0).otherwise(F.col("k") / 116.0).alias("y_flat"), F.when(F.col("k") < 58, F.col("k") * 10.0).otherwise(-1.0).alias("depth"))


def labels(s, d, by="subject"):
    """An assignment of files to clusters: by the length of their name, or by their least type."""
    f = nodes(s, d)
    if by == "name":
        return f.select("file_id", F.length("file_id").alias("label")).distinct()
    return f.groupBy("file_id").agg(F.max("type").alias("label"))


def dense(s, d):
    """Voxels with at least ten nodes."""
    return V.threshold_mask(V.heatmap(nodes(s, d), SIZE), 10)


def points(s, d):
    return csv_points.good_points(t(s, d, "point_csv_lines"))


NODES = f"nodes AS (SELECT DISTINCT {COLUMNS} FROM neurons)"
OK = "isfinite(x) AND isfinite(y) AND isfinite(z)"
FLAT = f"""{NODES}, flat AS (SELECT *, CASE WHEN region_id = 0 THEN -1.0 ELSE x / 13230.0 END AS fx, CASE WHEN region_id = 0 THEN -1.0 ELSE y / 8000.0 END AS fy,
  CASE WHEN type = 1 THEN -1.0 WHEN subject IS NOT NULL THEN z / 6.0 END AS fd FROM nodes),
  valid AS (SELECT *, isfinite(fx) AND isfinite(fy) AND NOT (fx = -1 AND fy = -1) AS xy, isfinite(fx) AND isfinite(fy) AND NOT (fx = -1 AND fy = -1) AND isfinite(fd) AND fd >= 0 AS drawn FROM flat)"""
XY_BINS = """CAST(LEAST(GREATEST(FLOOR(fy * 50), 0), 49) AS BIGINT) AS "by", CAST(LEAST(GREATEST(FLOOR(fx * 50), 0), 49) AS BIGINT) AS bx"""
BINS = f"CAST(LEAST(GREATEST(FLOOR(fd / 100.0), 0), 20) AS BIGINT) AS d, {XY_BINS}"
VOX = ", ".join(f"CAST(FLOOR({c} / {SIZE}) AS BIGINT) AS {n}" for c, n in zip("xyz", "ijk"))
ANNOTATION = f"""{NODES}, counted AS (SELECT {VOX}, region_id, COUNT(*) AS n FROM nodes WHERE {OK} AND region_id > 0 GROUP BY ALL),
  ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY i, j, k ORDER BY n DESC, region_id) AS place, COUNT(*) OVER (PARTITION BY i, j, k) AS n_labels FROM counted),
  annotation AS (SELECT i, j, k, region_id, n, n_labels FROM ranked WHERE place = 1)"""
LOOKUP = f"""{ANNOTATION}, lookup AS (SELECT i, j, k, CASE WHEN j < 20 THEN -1.0 ELSE i / 133.0 END AS x_flat, CASE WHEN j < 20 THEN -1.0 ELSE k / 116.0 END AS y_flat,
  CASE WHEN k < 58 THEN k * 10.0 ELSE -1.0 END AS depth FROM annotation)"""
HEAT = f"{NODES}, heat AS (SELECT {VOX}, COUNT(*) AS n FROM nodes WHERE {OK} GROUP BY ALL), dense AS (SELECT i, j, k FROM heat WHERE n >= 10)"
CHILDLESS = f"{NODES}, childless AS (SELECT * FROM nodes a WHERE NOT EXISTS (SELECT 1 FROM nodes b WHERE b.file_id = a.file_id AND b.parent_id = a.node_id))"
EDGES = f"""{NODES}, edges AS (SELECT a.file_id, a.node_id, a.parent_id, a.x, a.y, a.z, b.x AS parent_x, b.y AS parent_y, b.z AS parent_z
  FROM nodes a JOIN nodes b ON a.file_id = b.file_id AND a.parent_id = b.node_id WHERE a.parent_id >= 0)"""
SOMAS = f"{NODES}, somas AS (SELECT file_id, AVG(x) AS x, AVG(y) AS y, AVG(z) AS z FROM nodes WHERE type = 1 AND {OK} GROUP BY file_id)"
COUNTS = f"""{NODES}, counts AS (SELECT file_id, {VOX}, COUNT(*) AS n FROM nodes WHERE {OK} GROUP BY ALL),
  sums AS (SELECT file_id, CAST(SUM(n) AS DOUBLE) AS s, CAST(SUM(n * n) AS DOUBLE) AS q FROM counts GROUP BY file_id),
  total AS (SELECT CAST(COUNT(*) AS DOUBLE) AS v FROM (SELECT DISTINCT i, j, k FROM counts)),
  pairs AS (SELECT a.file_id AS a, b.file_id AS b, CAST(SUM(a.n * b.n) AS DOUBLE) AS sxy FROM counts a JOIN counts b USING (i, j, k) WHERE a.file_id < b.file_id GROUP BY 1, 2)"""
SIDE = f"CASE WHEN ABS(v - {MIDLINE}) < 1 THEN 'midline' WHEN v < {MIDLINE} THEN 'left' WHEN v IS NOT NULL THEN 'right' END"
ACRONYMS = ("DLINa5", "DMUIf", "OGRAs2/3", "MOLBn6a", "CFERa1", "MLINa5", "OQUIs5", "OMUPc6a")
IDS = [1269, 910, 876, 399369387, 1072, 476569059, 904, 402]
DEEP = f"""{NODES}, path AS (SELECT region_id, acronym, region_name, parent_region_id, list_transform(list_filter(string_split(structure_id_path, '/'), lambda p: p <> ''), lambda p: CAST(p AS INT)) AS ids FROM atlas_regions)"""
TOP = 531


def _r(df, *names, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in names})


def _segment_bins(s, d):
    seg = FM.flat_segments(flat_nodes(s, d), "fx", "fy", "fd")
    return seg.groupBy(plain_bin("x0", 0, 1, 50).alias("bx"), plain_bin("y0", 0, 1, 50).alias("by")).agg(F.count(F.lit(1)).alias("n_segments"), F.count_if(F.col("d1") > F.col("d0")).alias("n_deeper"))


def queries() -> dict:
    q = {
        # sources, filters
        "src01_scan": lambda s, d: times_as_text(_values(t(s, d, "neurons")), "traced_at", "loaded_at"),
        "src09_file_names": lambda s, d: t(s, d, "neurons").select("file_id").distinct().select("file_id", *[c.alias(n) for c, n in zip(swc.parse_file_names(F.col("file_id")), ("subject", "neuron_id"))]),
        "flt01_neurons_by_acronym": lambda s, d: N.neurons_touching(t(s, d, "neurons"), list(ACRONYMS)),
        "flt02_neurons_by_region_id": lambda s, d: N.neurons_touching(t(s, d, "neurons"), IDS, "region_id", types=[2, 3]),
        "flt04_excluding_large": lambda s, d: N.without(t(s, d, "neurons").select("file_id", "node_id", "type"), "file_id", [r[0] for r in N.largest_neurons(t(s, d, "neurons"), 5).collect()]),
        "flt05_axon_nodes": lambda s, d: N.member(nodes(s, d), "type", N.node_types([2])).select("file_id", "node_id"),
        "flt07_rows_of_largest": lambda s, d: N.file_rows(nodes(s, d), [r[0] for r in N.largest_neurons(nodes(s, d), 3).collect()]).select("file_id", "node_id", "parent_id"),
        "flt08_somas": lambda s, d: N.soma_rows(nodes(s, d)).select("file_id", "node_id", "neuron_id", "region_acronym"),
        "flt10_neurons_in_mask": lambda s, d: V.neurons_in_mask(t(s, d, "neurons"), written(dense(s, d)), SIZE),
        "flt11_mask_bounds": lambda s, d: V.mask_bounds(dense(s, d), SIZE),
        "flt15_soma_radius": lambda s, d: N.soma_distance_filter(nodes(s, d), 300.0).select("file_id", "node_id"),
        "flt16_slab_segments": lambda s, d: M.slab_segments(M.edges(nodes(s, d)).where(finite("z", "parent_z")), "z", 5000.0, 500.0).select("file_id", "node_id"),
        "flt17_slab_somas": lambda s, d: M.slab_points(N.soma_rows(nodes(s, d)).where(finite("z")), "z", 5000.0, 2000.0).select("file_id", "node_id"),
        "flt18_render_valid": lambda s, d: flat_nodes(s, d).where(FM.render_valid("fx", "fy", "fd", sentinel=True)).select("file_id", "node_id"),
        # joins
        "jn01_edges": lambda s, d: M.edges(nodes(s, d)).select("file_id", "node_id", "parent_id"),
        "jn02_cable_length": lambda s, d: _r(M.cable_length(M.edges(nodes(s, d)).where(finite("x", "y", "z", "parent_x", "parent_y", "parent_z"))), "length", digits=3),
        "jn03_termini_per_neuron": lambda s, d: M.termini(nodes(s, d), [2], children=t(s, d, "neurons")).groupBy("file_id").agg(F.count(F.lit(1)).alias("n_termini")),
        "jn03_termini": lambda s, d: M.termini(nodes(s, d), [2, 3], children=t(s, d, "neurons")).select("file_id", "node_id", "type"),
        "jn03_termini_in_region": lambda s, d: M.termini(nodes(s, d), [2], list(ACRONYMS), children=t(s, d, "neurons")).select("file_id", "node_id"),
        "jn09_soma_distance": lambda s, d: _r(nodes(s, d).join(N.soma_locations(nodes(s, d)).groupBy("file_id").agg(F.avg("x").alias("sx")), "file_id").where(finite("x")).groupBy("file_id").agg(F.max(F.abs(F.col("x") - F.col("sx"))).alias("reach_x")), "reach_x", digits=4),
        "jn13_new_files": lambda s, d: swc.new_files(t(s, d, "neurons_copy").select("file_id", "node_id"), t(s, d, "neurons")),
        "jn14_region_names": lambda s, d: R.with_names(nodes(s, d), t(s, d, "atlas_regions")).select("file_id", "node_id", "region_name", "region_acronym"),
        "jn16_annotated": lambda s, d: with_annotation(s, d, [], lambda n, a: V.annotate(n, a, SIZE)).select("file_id", "node_id", "region_id"),
        # aggregates
        "agg01_regions": lambda s, d: N.region_counts(nodes(s, d)),
        "agg02_neurons_per_region": lambda s, d: N.neurons_per_region(t(s, d, "neurons")),
        "agg03_soma_locations": lambda s, d: _r(N.soma_locations(nodes(s, d)), "x", "y", "z", digits=4),
        "agg04_statistics": lambda s, d: N.statistics(nodes(s, d)),
        "agg06_hemispheres": lambda s, d: _r(N.hemisphere_summary(nodes(s, d), MIDLINE), "least", "mean", "greatest", digits=4),
        "agg08_flat_somas": lambda s, d: _r(FM.flat_somas(flat_nodes(s, d).withColumn("fd", F.abs("fd")), "fx", "fy", "fd"), "x", "y", "depth", digits=9),
        "agg09_heatmap": lambda s, d: V.heatmap(nodes(s, d), SIZE, SHAPE),
        "agg09_heatmap_deep_planes": lambda s, d: V.heatmap(nodes(s, d), SIZE, SHAPE, types=[2, 3], radius=500.0, depth_step=4),
        "agg10_flat_heatmap": lambda s, d: FM.flat_heatmap(flat_nodes(s, d), "fx", "fy", "fd", GRID),
        "agg10_flat_heatmap_collapsed": lambda s, d: FM.flat_heatmap(flat_nodes(s, d), "fx", "fy", "fd", GRID, collapse=True),
        "agg11_flat_statistics": lambda s, d: FM.flat_statistics(flat_nodes(s, d), "fx", "fy", "fd"),
        "agg12_layer_heatmap": lambda s, d: FM.layer_heatmap(flat_nodes(s, d), R.layer_map(t(s, d, "atlas_regions")), "fx", "fy", GRID),
        "agg13_flat_bounds": lambda s, d: FM.flat_bounds(flat_nodes(s, d), "fx", "fy", "fd"),
        "agg14_recovered": lambda s, d: A.recovered(A.onto_nodes(nodes(s, d), labels(s, d), ["label"]), ["label"]),
        "agg15_neuron_summary": lambda s, d: _r(N.neuron_summary(nodes(s, d)), "soma_x", "soma_y", "soma_z", digits=4),
        "agg16_neuron_sums": lambda s, d: COR.neuron_sums(COR.voxel_counts(nodes(s, d), SIZE)),
        "agg17_input_nodes": lambda s, d: COR.input_nodes(nodes(s, d), SIZE),
        "agg20_coverage": lambda s, d: M.coverage(nodes(s, d), [2], children=t(s, d, "neurons")),
        "agg20_coverage_summary": lambda s, d: M.coverage_summary(M.coverage(nodes(s, d), [2], children=t(s, d, "neurons"))),
        "agg24_cluster_counts": lambda s, d: A.cluster_counts(A.active_map(nodes(s, d), labels(s, d).where("label < 5"))),
        "agg25_projection_summary": lambda s, d: with_annotation(s, d, [], lambda n, a: FM.projection_summary(written(FM.project(n, written(lookup(s, d, a)), SIZE, SHAPE).select("file_id", "projection_valid", "invalid_code", "depth_mode")))),
        "agg26_grouped_heatmap": lambda s, d: FM.grouped_heatmap(FM.flat_heatmap(flat_nodes(s, d), "fx", "fy", "fd", GRID, by=["file_id"]), labels(s, d).where("label < 5")),
        "agg28_histogram": lambda s, d: V.histogram(V.heatmap(nodes(s, d), SIZE), 64).select("bin", "n"),
        "agg29_step_curve": lambda s, d: _r(V.step_curve(V.histogram(V.heatmap(nodes(s, d), SIZE), 64)), "x", digits=4).select("bin", "side", "x", F.col("y").alias("height")),
        "agg35_centre": lambda s, d: _r(N.centre(nodes(s, d)), "x", "y", "z", digits=3),
        # windows, order, sets
        "win03_majority_labels": lambda s, d: V.majority_labels(V.binned(nodes(s, d).where("region_id > 0"), SIZE)),
        "win05_planar_labels": lambda s, d: V.majority_labels(V.binned(nodes(s, d).where("region_id > 0"), SIZE), bins=("j", "k")),
        "win06_vertex_index": lambda s, d: N.in_order(nodes(s, d)).withColumn("vertex", F.col("vertex").cast("long")),
        "top01_largest": lambda s, d: N.largest_neurons(nodes(s, d), 10),
        "top02_remaps": lambda s, d: CMP.remaps(_twins(s, d), "region_id", 20),
        "set01_concatenated": lambda s, d: t(s, d, "neurons").select("file_id", "node_id", "x").unionByName(t(s, d, "neurons_copy").select("file_id", "node_id", "x")).groupBy("file_id").agg(F.count(F.lit(1)).alias("n_rows")),
        "set04_mask_union": lambda s, d: V.region_mask(annotation(s, d), IDS),
        "set05_with_termini": lambda s, d: M.coverage(nodes(s, d), [2], children=t(s, d, "neurons")).select("file_id", (F.col("n_termini") > 0).alias("has_termini")),
        # hemispheres
        "xf03_soma_sides": lambda s, d: _r(N.soma_sides(nodes(s, d), MIDLINE), "soma", digits=4),
        "xf05_flipped": lambda s, d: _r(N.flipped(nodes(s, d), "left", MIDLINE).where(finite("z")).select("file_id", "node_id", "z"), "z", digits=6),
        # regions
        "reg04_descendants": lambda s, d: R.descendants(t(s, d, "atlas_regions"), TOP),
        "reg05_ancestors": lambda s, d: R.ancestors(t(s, d, "atlas_regions")),
        "reg06_children": lambda s, d: R.children(t(s, d, "atlas_regions")).select("parent_region_id", F.concat_ws(",", "child_ids").alias("child_ids")),
        "reg07_represented": lambda s, d: R.represented(t(s, d, "atlas_regions"), t(s, d, "neurons"), [TOP]),
        "reg08_layers": lambda s, d: R.layer_map(t(s, d, "atlas_regions")),
        "reg10_all_descendants": lambda s, d: R.all_descendants(t(s, d, "atlas_regions")),
        "reg12_layer_report": lambda s, d: R.layer_report(t(s, d, "atlas_regions")),
        "agg30_region_occupancy": lambda s, d: V.binned(nodes(s, d).where("region_id > 0"), SIZE).groupBy("region_id", "i", "j", "k").agg(F.count(F.lit(1)).alias("n")),
        # points
        "src18_points": lambda s, d: points(s, d).drop("extras"),
        "pt05_atlas_check": lambda s, d: P.mismatch_counts(P.atlas_check(points(s, d), t(s, d, "atlas_regions"), MIDLINE)),
        "agg21_point_groups": lambda s, d: P.groups(points(s, d)),
        "agg22_point_volumes": lambda s, d: P.group_volumes(points(s, d), 25.0),
        "agg23_label_volumes": lambda s, d: P.group_volumes(points(s, d), 25.0).groupBy("label", "i", "j", "k").agg(F.sum("n").alias("n")),
        # correlation, clusters
        "cor01_pearson": lambda s, d: _r(COR.pearson(COR.voxel_counts(nodes(s, d), SIZE)), "r"),
        "cor02_square": lambda s, d: _r(COR.square(COR.pearson(COR.voxel_counts(nodes(s, d), SIZE)), nodes(s, d).select("file_id").distinct()), "r"),
        "cor04_dense_pearson": lambda s, d: _r(COR.dense_pearson(COR.voxel_counts(nodes(s, d), SIZE)), "r"),
        "cl02_correlation_clusters": lambda s, d: CL.correlation_clusters(COR.voxel_counts(nodes(s, d), SIZE), 8),
        "cl05_soma_clusters": lambda s, d: CL.soma_clusters(_somas(s, d), 8),
        "cl06_soma_kmeans": lambda s, d: CL.soma_kmeans(_somas(s, d), 8),
        "cl07_soma_dbscan": lambda s, d: CL.soma_dbscan(_somas(s, d), 300.0, 3),
        "cl07_soma_pairs": lambda s, d: _r(CL.soma_pairs(_somas(s, d), 300.0), "d", digits=4),
        "cl09_contingency": lambda s, d: A.contingency(labels(s, d), labels(s, d, "name")),
        "cl09_adjusted_rand": lambda s, d: _r(A.adjusted_rand(labels(s, d), labels(s, d, "name")), "ari"),
        # rasters
        "ras01_smoothed": lambda s, d: _r(V.smoothed(V.heatmap(nodes(s, d), SIZE, SHAPE), 1.0, SHAPE), "n"),
        "ras02_merged": lambda s, d: V.merged(V.heatmap(nodes(s, d), SIZE, types=[2]), V.heatmap(nodes(s, d), SIZE, types=[3])),
        "ras03_isolated": lambda s, d: with_annotation(s, d, [], lambda n, a: V.isolated(V.heatmap(n, SIZE), a, IDS)),
        "ras04_otsu_mask": lambda s, d: V.heatmap_mask(V.heatmap(nodes(s, d), SIZE, SHAPE), 0.0, SHAPE),
        "ras06_threshold": lambda s, d: V.threshold_mask(V.heatmap(nodes(s, d), SIZE), 10, 100),
        "ras07_region_mask": lambda s, d: V.region_mask(annotation(s, d), IDS[2:5]),
        "ras08_dilated": lambda s, d: V.dilated(dense(s, d), 0.5, SHAPE),
        "ras09_voxel_numbers": lambda s, d: V.voxel_numbers(dense(s, d)),
        # flat maps, surfaces
        "fm01_projection": lambda s, d: _r(with_annotation(s, d, [], lambda n, a: FM.project(n, written(lookup(s, d, a)), SIZE, SHAPE)).select("file_id", "node_id", "x_flat", "y_flat", "depth_um", F.col("invalid_code").cast("int").alias("invalid_code"), "depth_mode"), "x_flat", "y_flat"),
        "fm02_mirrored_projection": lambda s, d: _r(with_annotation(s, d, [], lambda n, a: FM.project_with_mirror(n, written(lookup(s, d, a)), SIZE, SHAPE, MIDLINE)).select("file_id", "node_id", "x_flat", "y_flat", "depth_um", "lookup_mode"), "x_flat", "y_flat"),
        "fm08_exposed_faces": lambda s, d: V.exposed_faces(dense(s, d)),
        "fm08_vertices": lambda s, d: V.face_vertices(V.exposed_faces(dense(s, d))),
        "fm09_outlines": lambda s, d: V.outlines(dense(s, d)),
        "fm10_components": lambda s, d: V.voxel_components(dense(s, d)).select("i", "j", "k", *[F.col(f"component.{n}").alias(f"c{n}") for n in "ijk"]),
        "jn10_flat_segments": lambda s, d: _r(FM.flat_segments(flat_nodes(s, d), "fx", "fy", "fd"), "x0", "y0", "x1", "y1", "d0", "d1", digits=9),
        "jn10_segment_bins": _segment_bins,
        "xf09_pixels": lambda s, d: _r(flat_nodes(s, d).where(FM.xy_valid("fx", "fy")).select("file_id", "node_id", FM.pixel("fx", 0.0, 1.0, 50).alias("px")), "px", digits=4),
        # comparison, assignments, functions
        "jn12_difference_counts": lambda s, d: _r(CMP.difference_counts(_twins(s, d), ["parent_id", "type"], "z", 2 * MIDLINE, 0.01), "least_sum", "greatest_sum", "largest_error", digits=3),
        "asg08_restricted": lambda s, d: A.restricted(labels(s, d), N.largest_neurons(nodes(s, d), 50)),
        "snk13_labelled_nodes": lambda s, d: A.onto_nodes(nodes(s, d), labels(s, d), ["label"]).select("file_id", "node_id", "label"),
        "snk14_selected_rows": lambda s, d: A.selected_rows(nodes(s, d), N.largest_neurons(nodes(s, d), 3).select("file_id", F.length("file_id").alias("row_order"))).select("row_order", "file_id", "node_id"),
        "snk04_swc_lines": lambda s, d: swc.swc_lines(nodes(s, d)),
        "src07_parsed_lines": lambda s, d: _values(swc.parsed(_lines(s, d))[0]),
        "src08_failed_files": lambda s, d: swc.parsed(_lines(s, d, broken=True))[1],
        "src10_node_table": lambda s, d: with_annotation(s, d, ["type", "radius", "parent_id"], lambda n, a: swc.node_table(swc.parsed(swc.swc_lines(n))[0], a, t(s, d, "atlas_regions"), SIZE)).select("file_id", "node_id", "region_id", "region_name", "region_acronym", "subject", "neuron_id"),
        "fn09_region_keys": lambda s, d: t(s, d, "atlas_regions").select("region_id", region_key("region_name").alias("key"), slug("region_name").alias("slug"), layer_of("region_name").alias("layer")),
        "vox_rules": lambda s, d: nodes(s, d).where(finite("x", "y", "z")).groupBy(*[voxel("x", 25.0, r).alias(n) for r, n in (("truncate", "a"), ("floor", "b"), ("round", "c"), ("half_up", "e"))]).agg(F.count(F.lit(1)).alias("n")),
        "sql26_adhoc": _adhoc,
    }
    return q


def _values(df):
    """All columns; NaN as null, as checkers tell them apart in their own ways."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("x", "y", "z", "radius")})


def _lines(s, d, broken=False):
    """The nodes as SWC lines with remarks; broken: files of even length of name have a word for a number, those of a length of 3 n no nodes."""
    lines = swc.swc_lines(nodes(s, d))
    size = F.length("file_id")
    value = F.when(size % 3 == 0, F.concat(F.lit("# "), "value")).when(size % 2 == 0, F.regexp_replace("value", "^", "x")).otherwise(F.col("value")) if broken else F.concat("value", F.lit("  extra # remark"))
    return lines.select("file_id", value.alias("value"))


def _adhoc(s, d):
    t(s, d, "neurons").createOrReplaceTempView("arborlake_neurons")
    return s.sql("SELECT type, count(*) AS n FROM arborlake_neurons WHERE region_acronym <> ? AND type >= ? GROUP BY type", args=["", 2])


def _somas(s, d):
    return N.soma_locations(nodes(s, d)).groupBy("file_id").agg(*[F.avg(c).alias(c) for c in "xyz"])


def _twins(s, d):
    """The node table beside the second system's copy, by key."""
    one = t(s, d, "neurons").groupBy("file_id", "node_id").agg(*[F.max(c).alias(c) for c in ("parent_id", "type", "region_id")], F.max(F.when(~F.isnan("z"), F.col("z"))).alias("z"))
    two = t(s, d, "neurons_copy").groupBy("file_id", "node_id").agg(*[F.max(c).alias(c) for c in ("parent_id", "type", "region_id")], F.max(F.when(~F.isnan("z"), F.col("z"))).alias("z"))
    return CMP.side_by_side(one, two, ["file_id", "node_id"])


_TWINS = """WITH one AS (SELECT file_id, node_id, MAX(parent_id) AS parent_id, MAX(type) AS type, MAX(region_id) AS region_id, MAX(CASE WHEN NOT isnan(z) THEN z END) AS z FROM neurons GROUP BY 1, 2),
two AS (SELECT file_id, node_id, MAX(parent_id) AS parent_id, MAX(type) AS type, MAX(region_id) AS region_id, MAX(CASE WHEN NOT isnan(z) THEN z END) AS z FROM neurons_copy GROUP BY 1, 2),
pairs AS (SELECT l.file_id AS lf, r.file_id AS rf, l.parent_id AS lp, r.parent_id AS rp, l.type AS lt, r.type AS rt, l.region_id AS lr, r.region_id AS rr, l.z + r.z AS total FROM one l FULL JOIN two r ON l.file_id = r.file_id AND l.node_id = r.node_id)"""
_NAMES = ", ".join(f"'{a}'" for a in ACRONYMS)
_IDS = ", ".join(map(str, IDS))
_STEM = "regexp_replace(file_id, '\\.swc$', '', 'i')"
_LABELS = "label AS (SELECT file_id, MAX(type) AS label FROM nodes GROUP BY file_id)"
_FM = f"""{LOOKUP}, placed AS (SELECT *, COALESCE({OK}, FALSE) AS ok, CASE WHEN {OK} THEN CAST(FLOOR(x / {SIZE} + 0.5) AS BIGINT) END AS vi, CASE WHEN {OK} THEN CAST(FLOOR(y / {SIZE} + 0.5) AS BIGINT) END AS vj,
  CASE WHEN {OK} THEN CAST(FLOOR(z / {SIZE} + 0.5) AS BIGINT) END AS vk FROM nodes),
  inner_ AS (SELECT *, COALESCE(ok AND vi BETWEEN 0 AND {SHAPE[0] - 1} AND vj BETWEEN 0 AND {SHAPE[1] - 1} AND vk BETWEEN 0 AND {SHAPE[2] - 1}, FALSE) AS inside FROM placed),
  looked AS (SELECT p.*, o.x_flat AS ox, o.y_flat AS oy, o.depth AS od, m.depth AS md FROM inner_ p LEFT JOIN lookup o ON p.vi = o.i AND p.vj = o.j AND p.vk = o.k
    LEFT JOIN lookup m ON p.vi = m.i AND p.vj = m.j AND {SHAPE[2] - 1} - p.vk = m.k),
  flags AS (SELECT *, COALESCE(inside AND ox IS NOT NULL AND NOT (ox = -1 AND oy = -1), FALSE) AS xy, COALESCE(inside AND od >= 0, FALSE) AS own, COALESCE(inside AND md >= 0, FALSE) AS far FROM looked),
  projected AS (SELECT *, CASE WHEN xy THEN ox END AS x_flat, CASE WHEN xy THEN oy END AS y_flat, CASE WHEN own THEN od WHEN far THEN md END AS depth_um, xy AND (own OR far) AS projection_valid,
    CASE WHEN NOT ok THEN 1 WHEN NOT inside THEN 2 WHEN NOT xy THEN 3 WHEN NOT (own OR far) THEN 4 ELSE 0 END AS invalid_code, CASE WHEN own THEN 'direct' WHEN far THEN 'mirrored_depth' ELSE 'unmapped' END AS depth_mode FROM flags)"""
_PEARSON = """SELECT p.a, p.b, CASE WHEN (v * x.q - x.s * x.s) * (v * y.q - y.s * y.s) > 0 THEN (v * sxy - x.s * y.s) / SQRT((v * x.q - x.s * x.s) * (v * y.q - y.s * y.s)) END AS r
  FROM pairs p JOIN sums x ON p.a = x.file_id JOIN sums y ON p.b = y.file_id CROSS JOIN total"""
_FACES = f"""{HEAT}, faces AS (SELECT * FROM dense CROSS JOIN (VALUES ('i', -1, -1, 0, 0), ('i', 1, 1, 0, 0), ('j', -1, 0, -1, 0), ('j', 1, 0, 1, 0), ('k', -1, 0, 0, -1), ('k', 1, 0, 0, 1)) f(axis, side, di, dj, dk)
  WHERE NOT EXISTS (SELECT 1 FROM dense o WHERE o.i = dense.i + di AND o.j = dense.j + dj AND o.k = dense.k + dk))"""


_ROUNDED = ", ".join(f"CAST(ROUND_EVEN({c} / 25.0, 0) AS BIGINT) AS {n}" for c, n in zip("zyx", "ijk"))


def _KEY(c):
    return f"trim(regexp_replace(regexp_replace(lower({c}), '\\s*/\\s*', ', ', 'g'), '\\s+', ' ', 'g'), ' ,')"


def _NUM(c):
    return f"CASE WHEN isfinite({c}) THEN printf('%.3f', {c}) ELSE 'nan' END"


def _VOX(c):
    return f"CASE WHEN ok THEN CAST(FLOOR({c} / {SIZE} + 0.5) AS BIGINT) END"


def _IN(k):
    return f"ok AND vi BETWEEN 0 AND {SHAPE[0] - 1} AND vj BETWEEN 0 AND {SHAPE[1] - 1} AND {k} BETWEEN 0 AND {SHAPE[2] - 1}"


_MIRRORED = f"""{LOOKUP}, both_ AS (SELECT *, COALESCE({OK}, FALSE) AS ok FROM nodes), v AS (SELECT *, {_VOX('x')} AS vi, {_VOX('y')} AS vj, {_VOX('z')} AS vk, {_VOX(f'({2 * MIDLINE} - z)')} AS wk FROM both_),
            p AS (SELECT v.*, COALESCE({_IN('vk')}, FALSE) AS din, COALESCE({_IN('wk')}, FALSE) AS min_, o.x_flat AS ox, o.y_flat AS oy, o.depth AS od, m.x_flat AS mx, m.y_flat AS my, m.depth AS md FROM v LEFT JOIN lookup o ON vi = o.i AND vj = o.j AND vk = o.k LEFT JOIN lookup m ON vi = m.i AND vj = m.j AND wk = m.k),
            f AS (SELECT *, COALESCE(din AND NOT (ox = -1 AND oy = -1), FALSE) AS dxy, COALESCE(min_ AND NOT (mx = -1 AND my = -1), FALSE) AS mxy, COALESCE(din AND od >= 0, FALSE) AS dd, COALESCE(min_ AND md >= 0, FALSE) AS mdd FROM p)"""


def dbscan_sql(points: str, eps: float, least: int) -> str:
    """Density clusters of ``points`` (file_id, x, y, z), a chain of WITH parts."""
    return f"""WITH RECURSIVE {points}, near AS (SELECT a.file_id AS a, b.file_id AS b FROM somas a JOIN somas b ON a.file_id <> b.file_id AND SQRT((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) <= {eps}),
            core AS (SELECT a AS c FROM near GROUP BY a HAVING COUNT(*) + 1 >= {least}), reach AS (SELECT c, c AS r FROM core UNION SELECT n.b, r.r FROM reach r JOIN near n ON n.a = r.c SEMI JOIN core k ON n.b = k.c),
            own AS (SELECT c, MIN(r) AS k FROM reach GROUP BY 1), border AS (SELECT n.a AS c, MIN(o.k) AS k FROM near n JOIN own o ON n.b = o.c WHERE n.a NOT IN (SELECT c FROM core) GROUP BY 1), every AS (SELECT * FROM own UNION ALL SELECT * FROM border), numbers AS (SELECT k, CAST(ROW_NUMBER() OVER (ORDER BY k) + 1 AS INT) AS label FROM (SELECT DISTINCT k FROM own))
            SELECT s.file_id, COALESCE(label, 1) AS label FROM somas s LEFT JOIN every e ON s.file_id = e.c LEFT JOIN numbers USING (k)"""


def _axis(n, axis, size):
    """One axis of the smoothing: every target within reach sums up what it reads, places outside being the border's."""
    before = "box" if n == 1 else f"s{n - 1}"
    rest = [c for c in "ijk" if c != axis]
    return f"""c{n} AS (SELECT DISTINCT {', '.join(rest)}, {axis} + o AS {axis} FROM {before} CROSS JOIN w WHERE {axis} + o BETWEEN 0 AND {size - 1}),
  s{n} AS (SELECT c.i, c.j, c.k, SUM(b.n * w) AS n FROM c{n} c CROSS JOIN w JOIN {before} b ON {' AND '.join(f'b.{r} = c.{r}' for r in rest)} AND b.{axis} = LEAST(GREATEST(c.{axis} + o, 0), {size - 1}) GROUP BY 1, 2, 3)"""


_HEAT_IN = f"{HEAT}, box AS (SELECT i, j, k, CAST(n AS DOUBLE) AS n FROM heat WHERE i BETWEEN 0 AND {SHAPE[0] - 1} AND j BETWEEN 0 AND {SHAPE[1] - 1} AND k BETWEEN 0 AND {SHAPE[2] - 1})"
_SMOOTH = ", ".join(_axis(n, axis, size) for n, (axis, size) in enumerate(zip("ijk", SHAPE), 1))


def oracle_sql() -> dict[str, str]:
    return {
        "src01_scan": "SELECT * REPLACE (CASE WHEN NOT isnan(x) THEN x END AS x, CASE WHEN NOT isnan(y) THEN y END AS y, CASE WHEN NOT isnan(z) THEN z END AS z, CASE WHEN NOT isnan(radius) THEN radius END AS radius, strftime(traced_at, '%Y-%m-%d %H:%M:%S.%f') AS traced_at, strftime(loaded_at, '%Y-%m-%d %H:%M:%S.%f') AS loaded_at) FROM neurons",
        "src09_file_names": f"""WITH f AS (SELECT DISTINCT file_id, {_STEM} AS stem FROM neurons) SELECT file_id,
            CASE WHEN regexp_matches(stem, '^\\d+_\\d+_') THEN regexp_extract(stem, '^(\\d+)_(\\d+)_', 2) WHEN regexp_matches(stem, '^H\\d+(\\.\\d+){{6}}_\\d+') THEN regexp_extract(stem, '^(H\\d+(\\.\\d+){{6}})_(\\d+)', 1) ELSE stem END AS subject,
            CASE WHEN regexp_matches(stem, '^\\d+_\\d+_') THEN regexp_extract(stem, '^(\\d+)_(\\d+)_', 1) WHEN regexp_matches(stem, '^H\\d+(\\.\\d+){{6}}_\\d+') THEN regexp_extract(stem, '^(H\\d+(\\.\\d+){{6}})_(\\d+)', 3) ELSE stem END AS neuron_id FROM f""",
        "flt01_neurons_by_acronym": f"SELECT DISTINCT file_id, neuron_id, subject FROM neurons WHERE region_acronym IN ({_NAMES})",
        "flt02_neurons_by_region_id": f"SELECT DISTINCT file_id, neuron_id, subject FROM neurons WHERE region_id IN ({_IDS}) AND type IN (2, 3)",
        "flt04_excluding_large": "SELECT file_id, node_id, type FROM neurons WHERE file_id NOT IN (SELECT file_id FROM neurons GROUP BY file_id ORDER BY COUNT(*) DESC, file_id LIMIT 5)",
        "flt05_axon_nodes": f"WITH {NODES} SELECT file_id, node_id FROM nodes WHERE type = 2",
        "flt07_rows_of_largest": f"WITH {NODES} SELECT file_id, node_id, parent_id FROM nodes WHERE file_id IN (SELECT file_id FROM nodes GROUP BY file_id ORDER BY COUNT(*) DESC, file_id LIMIT 3)",
        "flt08_somas": f"WITH {NODES} SELECT file_id, node_id, neuron_id, region_acronym FROM nodes WHERE type = 1",
        "flt10_neurons_in_mask": f"WITH {HEAT} SELECT DISTINCT file_id, neuron_id, subject FROM (SELECT *, {VOX} FROM nodes WHERE {OK}) n SEMI JOIN dense USING (i, j, k)",
        "flt11_mask_bounds": f"WITH {HEAT} SELECT " + ", ".join(f"GREATEST(0.0, (MIN({n}) - 0.5) * {SIZE}) AS {c}_low, (MAX({n}) + 1.5) * {SIZE} AS {c}_high" for n, c in zip("ijk", "xyz")) + " FROM dense",
        "flt15_soma_radius": f"WITH {SOMAS} SELECT n.file_id, n.node_id FROM nodes n JOIN somas s ON n.file_id = s.file_id WHERE isfinite(n.x) AND isfinite(n.y) AND isfinite(n.z) AND SQRT((n.x - s.x) * (n.x - s.x) + (n.y - s.y) * (n.y - s.y) + (n.z - s.z) * (n.z - s.z)) <= 300",
        "flt16_slab_segments": f"WITH {EDGES} SELECT file_id, node_id FROM edges WHERE isfinite(z) AND isfinite(parent_z) AND GREATEST(z, parent_z) >= 4500 AND LEAST(z, parent_z) <= 5500",
        "flt17_slab_somas": f"WITH {NODES} SELECT file_id, node_id FROM nodes WHERE type = 1 AND isfinite(z) AND z BETWEEN 3000 AND 7000",
        "flt18_render_valid": f"WITH {FLAT} SELECT file_id, node_id FROM valid WHERE xy AND isfinite(fd) AND (fd >= 0 OR fd = -1)",
        "jn01_edges": f"WITH {EDGES} SELECT file_id, node_id, parent_id FROM edges",
        "jn02_cable_length": f"WITH {EDGES} SELECT file_id, ROUND(SUM(SQRT((x - parent_x) * (x - parent_x) + (y - parent_y) * (y - parent_y) + (z - parent_z) * (z - parent_z))), 3) AS length, COUNT(*) AS n_edges FROM edges WHERE {OK} AND isfinite(parent_x) AND isfinite(parent_y) AND isfinite(parent_z) GROUP BY 1",
        "jn03_termini_per_neuron": f"WITH {CHILDLESS} SELECT file_id, COUNT(*) AS n_termini FROM childless WHERE type = 2 GROUP BY 1",
        "jn03_termini": f"WITH {CHILDLESS} SELECT file_id, node_id, type FROM childless WHERE type IN (2, 3)",
        "jn03_termini_in_region": f"WITH {CHILDLESS} SELECT file_id, node_id FROM childless WHERE type = 2 AND region_acronym IN ({_NAMES})",
        "jn09_soma_distance": f"WITH {SOMAS} SELECT n.file_id, ROUND(MAX(ABS(n.x - s.x)), 4) AS reach_x FROM nodes n JOIN somas s ON n.file_id = s.file_id WHERE isfinite(n.x) GROUP BY 1",
        "jn13_new_files": "SELECT file_id, node_id FROM neurons_copy c WHERE NOT EXISTS (SELECT 1 FROM neurons n WHERE n.file_id = c.file_id)",
        "jn14_region_names": f"WITH {NODES} SELECT file_id, node_id, COALESCE(a.region_name, '') AS region_name, COALESCE(a.acronym, '') AS region_acronym FROM nodes n LEFT JOIN atlas_regions a ON n.region_id = a.region_id",
        "jn16_annotated": f"WITH {ANNOTATION}, n AS (SELECT *, CASE WHEN {OK} THEN CAST(TRUNC(x / {SIZE}) AS BIGINT) END AS vi, CASE WHEN {OK} THEN CAST(TRUNC(y / {SIZE}) AS BIGINT) END AS vj, CASE WHEN {OK} THEN CAST(TRUNC(z / {SIZE}) AS BIGINT) END AS vk FROM nodes) SELECT file_id, node_id, COALESCE(a.region_id, 0) AS region_id FROM n LEFT JOIN annotation a ON vi = a.i AND vj = a.j AND vk = a.k",
        "agg01_regions": f"WITH {NODES} SELECT region_id, MAX(region_name) AS region_name, MAX(region_acronym) AS region_acronym, COUNT(*) AS n_nodes FROM nodes WHERE region_id > 0 GROUP BY 1",
        "agg02_neurons_per_region": "SELECT region_acronym, COUNT(DISTINCT file_id) AS n_neurons FROM neurons WHERE region_acronym <> '' GROUP BY 1",
        "agg03_soma_locations": f"WITH {NODES} SELECT file_id, neuron_id, ROUND(AVG(x), 4) AS x, ROUND(AVG(y), 4) AS y, ROUND(AVG(z), 4) AS z, MAX(region_acronym) AS region_acronym FROM nodes WHERE type = 1 AND {OK} GROUP BY 1, 2",
        "agg04_statistics": f"WITH {NODES} SELECT COUNT(*) AS n_nodes, COUNT(DISTINCT file_id) AS n_files, COUNT(DISTINCT subject) AS n_subjects, COUNT(DISTINCT CASE WHEN region_acronym <> '' THEN region_acronym END) AS n_regions FROM nodes",
        "agg06_hemispheres": f"WITH {NODES}, s AS (SELECT file_id, z AS v FROM nodes WHERE type = 1 AND isfinite(z)), k AS (SELECT *, {SIDE} AS side FROM s) SELECT COUNT(*) AS n_somas, COUNT(DISTINCT file_id) AS n_neurons, COUNT(*) FILTER (side = 'left') AS n_left, COUNT(*) FILTER (side = 'midline') AS n_midline, COUNT(*) FILTER (side = 'right') AS n_right, ROUND(MIN(v), 4) AS least, ROUND(AVG(v), 4) AS mean, ROUND(MAX(v), 4) AS greatest FROM k",
        "agg08_flat_somas": f"WITH {FLAT} SELECT file_id, ROUND(AVG(fx), 9) AS x, ROUND(AVG(fy), 9) AS y, ROUND(AVG(ABS(fd)), 9) AS depth, COUNT(*) AS n_nodes FROM valid WHERE type = 1 AND xy AND isfinite(fd) GROUP BY 1",
        "agg09_heatmap": f"WITH {HEAT} SELECT * FROM heat WHERE i BETWEEN 0 AND {SHAPE[0] - 1} AND j BETWEEN 0 AND {SHAPE[1] - 1} AND k BETWEEN 0 AND {SHAPE[2] - 1}",
        "agg09_heatmap_deep_planes": f"""WITH {SOMAS}, near AS (SELECT n.* FROM nodes n JOIN somas s ON n.file_id = s.file_id WHERE isfinite(n.x) AND isfinite(n.y) AND isfinite(n.z) AND SQRT((n.x - s.x) * (n.x - s.x) + (n.y - s.y) * (n.y - s.y) + (n.z - s.z) * (n.z - s.z)) <= 500),
            v AS (SELECT {VOX} FROM near WHERE type IN (2, 3)) SELECT CAST(FLOOR(i / 4) AS BIGINT) AS i, j, k, COUNT(*) AS n FROM v WHERE i BETWEEN 0 AND {SHAPE[0] - 1} AND j BETWEEN 0 AND {SHAPE[1] - 1} AND k BETWEEN 0 AND {SHAPE[2] - 1} GROUP BY 1, 2, 3""",
        "agg10_flat_heatmap": f"WITH {FLAT} SELECT {BINS}, COUNT(*) AS n FROM valid WHERE drawn GROUP BY 1, 2, 3",
        "agg10_flat_heatmap_collapsed": f"WITH {FLAT} SELECT CAST(0 AS BIGINT) AS d, \"by\", bx, COUNT(*) AS n FROM (SELECT {BINS} FROM valid WHERE drawn) GROUP BY 2, 3",
        "agg11_flat_statistics": f"WITH {FLAT} SELECT COUNT(*) AS n_nodes, COUNT(*) FILTER (xy) AS n_xy, COUNT(*) FILTER (drawn) AS n_drawn, COUNT(*) FILTER (fd = -1) AS n_marked, COUNT(DISTINCT file_id) AS n_files, COUNT(DISTINCT CASE WHEN drawn THEN file_id END) AS n_files_drawn FROM valid",
        "agg12_layer_heatmap": f"""WITH {FLAT}, layers AS (SELECT region_id, lower(regexp_extract(region_name, '(?i)(?:,|/)\\s*(?:layer\\s+)?(2/3|6a|6b|1|4|5)\\s*$', 1)) AS layer FROM atlas_regions a WHERE NOT EXISTS (SELECT 1 FROM atlas_regions b WHERE b.parent_region_id = a.region_id))
            SELECT layer, "by", bx, COUNT(*) AS n FROM (SELECT l.layer, {XY_BINS} FROM valid v JOIN layers l ON v.region_id = l.region_id WHERE xy AND layer <> '') GROUP BY 1, 2, 3""",
        "agg13_flat_bounds": f"WITH {FLAT} SELECT MIN(fx) FILTER (xy) AS x_low, MAX(fx) FILTER (xy) AS x_high, MIN(fy) FILTER (xy) AS y_low, MAX(fy) FILTER (xy) AS y_high, MIN(fd) FILTER (drawn) AS depth_low, MAX(fd) FILTER (drawn) AS depth_high FROM valid",
        "agg14_recovered": f"WITH {NODES} SELECT file_id, MAX(type) AS label FROM nodes GROUP BY 1",
        "agg15_neuron_summary": f"""WITH {NODES} SELECT file_id, MAX(neuron_id) AS neuron_id, MAX(subject) AS subject, {', '.join(f'ROUND(AVG(CASE WHEN type = 1 AND {OK} THEN {c} END), 4) AS soma_{c}' for c in 'xyz')}, MAX(CASE WHEN type = 1 AND {OK} THEN region_acronym END) AS soma_region, COUNT(*) AS n_nodes FROM nodes GROUP BY 1""",
        "agg16_neuron_sums": f"WITH {COUNTS} SELECT * FROM sums",
        "agg17_input_nodes": f"WITH {NODES} SELECT COUNT(*) AS n_nodes FROM nodes WHERE {OK}",
        "agg20_coverage": f"WITH {CHILDLESS} SELECT n.file_id, COUNT(c.node_id) FILTER (c.type = 2) AS n_termini, COUNT(c.node_id) FILTER (c.type <> 2 OR c.type IS NULL) AS n_other FROM (SELECT DISTINCT file_id FROM nodes) n LEFT JOIN childless c ON n.file_id = c.file_id GROUP BY 1",
        "agg20_coverage_summary": f"WITH {CHILDLESS}, c AS (SELECT n.file_id, COUNT(c.node_id) FILTER (c.type = 2) AS t, COUNT(c.node_id) FILTER (c.type <> 2 OR c.type IS NULL) AS o FROM (SELECT DISTINCT file_id FROM nodes) n LEFT JOIN childless c ON n.file_id = c.file_id GROUP BY 1) SELECT COUNT(*) FILTER (t > 0) AS n_with, COUNT(*) FILTER (t = 0) AS n_without, CAST(SUM(t) AS BIGINT) AS n_termini, CAST(SUM(o) AS BIGINT) AS n_other FROM c",
        "agg24_cluster_counts": f"WITH {NODES}, {_LABELS} SELECT CASE WHEN label < 5 THEN label END AS label, COUNT(*) AS n_neurons FROM label GROUP BY 1",
        "agg25_projection_summary": f"WITH {_FM}, part AS (SELECT COUNT(*) AS n_partial_files FROM (SELECT file_id FROM projected GROUP BY 1 HAVING bool_or(projection_valid) AND NOT bool_and(projection_valid))) SELECT invalid_code, depth_mode, COUNT(*) AS n_nodes, COUNT(DISTINCT file_id) AS n_files, ANY_VALUE(n_partial_files) AS n_partial_files FROM projected CROSS JOIN part GROUP BY 1, 2",
        "agg26_grouped_heatmap": f"WITH {FLAT}, {_LABELS} SELECT CASE WHEN label < 5 THEN label END AS cluster, d, \"by\", bx, COUNT(*) AS n FROM (SELECT file_id, {BINS} FROM valid WHERE drawn) v LEFT JOIN label USING (file_id) GROUP BY 1, 2, 3, 4",
        "agg28_histogram": f"WITH {HEAT}, e AS (SELECT CAST(MIN(n) AS DOUBLE) AS low, CAST(MAX(n) AS DOUBLE) AS high FROM heat), b AS (SELECT CAST(LEAST(FLOOR((n - low) / ((high - low) / 64)), 63) AS INT) AS bin, COUNT(*) AS c FROM heat CROSS JOIN e GROUP BY 1) SELECT CAST(r.range AS INT) AS bin, COALESCE(c, 0) AS n FROM range(64) r LEFT JOIN b ON r.range = b.bin",
        "agg35_centre": f"WITH {NODES} SELECT {', '.join(f'ROUND(AVG({c}), 3) AS {c}' for c in 'xyz')} FROM nodes WHERE type = 1 AND {OK}",
        "win03_majority_labels": f"WITH {ANNOTATION} SELECT i, j, k, region_id, n, n_labels FROM annotation",
        "win05_planar_labels": f"WITH {NODES}, c AS (SELECT j, k, region_id, COUNT(*) AS n FROM (SELECT {VOX}, region_id FROM nodes WHERE {OK} AND region_id > 0) GROUP BY 1, 2, 3), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY j, k ORDER BY n DESC, region_id) AS place, COUNT(*) OVER (PARTITION BY j, k) AS n_labels FROM c) SELECT j, k, region_id, n, n_labels FROM r WHERE place = 1",
        "win06_vertex_index": f"WITH {NODES} SELECT file_id, node_id, ROW_NUMBER() OVER (PARTITION BY file_id ORDER BY node_id) - 1 AS vertex FROM nodes",
        "top01_largest": f"WITH {NODES} SELECT file_id, COUNT(*) AS n_nodes FROM nodes GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
        "top02_remaps": _TWINS + " SELECT lr AS from_value, rr AS to_value, COUNT(*) AS n_rows FROM pairs WHERE lr IS DISTINCT FROM rr GROUP BY 1, 2 ORDER BY 3 DESC, 1 NULLS LAST, 2 NULLS LAST LIMIT 20",
        "set01_concatenated": "SELECT file_id, COUNT(*) AS n_rows FROM (SELECT file_id FROM neurons UNION ALL SELECT file_id FROM neurons_copy) GROUP BY 1",
        "set04_mask_union": f"WITH {ANNOTATION} SELECT i, j, k FROM annotation WHERE region_id IN ({_IDS})",
        "set05_with_termini": f"WITH {CHILDLESS} SELECT n.file_id, COUNT(c.node_id) > 0 AS has_termini FROM (SELECT DISTINCT file_id FROM nodes) n LEFT JOIN childless c ON n.file_id = c.file_id AND c.type = 2 GROUP BY 1",
        "xf03_soma_sides": f"WITH {NODES}, m AS (SELECT file_id, AVG(CASE WHEN type = 1 AND isfinite(z) THEN z END) AS v FROM nodes GROUP BY 1) SELECT file_id, ROUND(v, 4) AS soma, {SIDE} AS side FROM m",
        "xf05_flipped": f"WITH {NODES}, m AS (SELECT file_id, AVG(CASE WHEN type = 1 AND isfinite(z) THEN z END) AS v FROM nodes GROUP BY 1), k AS (SELECT file_id, {SIDE} AS side FROM m) SELECT n.file_id, node_id, ROUND(CASE WHEN side = 'right' THEN {2 * MIDLINE} - z ELSE z END, 6) AS z FROM nodes n JOIN k ON n.file_id = k.file_id WHERE isfinite(z)",
        "reg04_descendants": f"SELECT region_id FROM atlas_regions WHERE structure_id_path LIKE '%/{TOP}/%'",
        "reg05_ancestors": f"WITH {DEEP}, a AS (SELECT region_id, unnest(ids) AS ancestor_id, generate_subscripts(ids, 1) - 1 AS depth FROM path) SELECT a.region_id, CAST(depth AS INT) AS depth, ancestor_id, r.acronym AS ancestor_acronym FROM a LEFT JOIN atlas_regions r ON a.ancestor_id = r.region_id WHERE ancestor_id <> a.region_id",
        "reg06_children": "SELECT parent_region_id, string_agg(CAST(region_id AS VARCHAR), ',' ORDER BY region_id) AS child_ids FROM atlas_regions WHERE parent_region_id <> -1 GROUP BY 1",
        "reg07_represented": f"SELECT DISTINCT n.region_id FROM neurons n JOIN atlas_regions a ON n.region_id = a.region_id WHERE a.structure_id_path LIKE '%/{TOP}/%'",
        "reg08_layers": "SELECT region_id, lower(regexp_extract(region_name, '(?i)(?:,|/)\\s*(?:layer\\s+)?(2/3|6a|6b|1|4|5)\\s*$', 1)) AS layer FROM atlas_regions a WHERE regexp_matches(region_name, '(?i)(?:,|/)\\s*(?:layer\\s+)?(2/3|6a|6b|1|4|5)\\s*$') AND NOT EXISTS (SELECT 1 FROM atlas_regions b WHERE b.parent_region_id = a.region_id)",
        "reg10_all_descendants": f"WITH {DEEP} SELECT unnest(ids) AS ancestor_id, region_id AS descendant_id FROM path",
        "reg12_layer_report": "SELECT lower(regexp_extract(region_name, '(?i)(?:,|/)\\s*(?:layer\\s+)?(2/3|6a|6b|1|4|5)\\s*$', 1)) AS layer, COUNT(*) AS n_regions, MIN(region_id) AS least_id FROM atlas_regions a WHERE regexp_matches(region_name, '(?i)(?:,|/)\\s*(?:layer\\s+)?(2/3|6a|6b|1|4|5)\\s*$') AND NOT EXISTS (SELECT 1 FROM atlas_regions b WHERE b.parent_region_id = a.region_id) GROUP BY 1",
        "agg30_region_occupancy": f"WITH {ANNOTATION} SELECT region_id, i, j, k, n FROM counted",
        "cor01_pearson": f"WITH {COUNTS}, u AS ({_PEARSON}) SELECT a AS swc_id_1, b AS swc_id_2, ROUND(r, 6) AS r FROM u UNION ALL SELECT b, a, ROUND(r, 6) FROM u UNION ALL SELECT file_id, file_id, 1.0 FROM sums",
        "cor02_square": f"WITH {COUNTS}, u AS ({_PEARSON}), ids AS (SELECT DISTINCT file_id FROM nodes) SELECT x.file_id AS swc_id_1, y.file_id AS swc_id_2, CASE WHEN x.file_id = y.file_id THEN 1.0 ELSE COALESCE(ROUND(r, 6), -1.0) END AS r FROM ids x CROSS JOIN ids y LEFT JOIN u ON u.a = LEAST(x.file_id, y.file_id) AND u.b = GREATEST(x.file_id, y.file_id)",
        "cor04_dense_pearson": f"""WITH {COUNTS}, u AS (SELECT x.file_id AS a, y.file_id AS b, CASE WHEN (v * x.q - x.s * x.s) * (v * y.q - y.s * y.s) > 0 THEN (v * COALESCE(sxy, 0) - x.s * y.s) / SQRT((v * x.q - x.s * x.s) * (v * y.q - y.s * y.s)) ELSE 0 END AS r
            FROM sums x JOIN sums y ON x.file_id < y.file_id LEFT JOIN pairs p ON p.a = x.file_id AND p.b = y.file_id CROSS JOIN total) SELECT a AS swc_id_1, b AS swc_id_2, ROUND(GREATEST(-1, LEAST(1, r)), 6) AS r FROM u UNION ALL SELECT b, a, ROUND(GREATEST(-1, LEAST(1, r)), 6) FROM u UNION ALL SELECT file_id, file_id, 1.0 FROM sums""",
        "cl07_soma_pairs": f"WITH {SOMAS} SELECT a.file_id AS a, b.file_id AS b, ROUND(SQRT((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)), 4) AS d FROM somas a JOIN somas b ON a.file_id < b.file_id WHERE SQRT((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) <= 300",
        "cl09_contingency": f"WITH {NODES} SELECT label_a, label_b, COUNT(*) AS n FROM (SELECT file_id, MAX(type) AS label_a, CAST(length(file_id) AS INT) AS label_b FROM nodes GROUP BY 1) GROUP BY 1, 2",
        "cl09_adjusted_rand": f"WITH {NODES}, c AS (SELECT a, b, COUNT(*) AS n FROM (SELECT file_id, MAX(type) AS a, length(file_id) AS b FROM nodes GROUP BY 1) GROUP BY 1, 2), s AS (SELECT (SELECT SUM(n * (n - 1) / 2.0) FROM c) AS cells, (SELECT SUM(n) FROM c) AS total, (SELECT SUM(s * (s - 1) / 2.0) FROM (SELECT SUM(n) AS s FROM c GROUP BY a)) AS ra, (SELECT SUM(s * (s - 1) / 2.0) FROM (SELECT SUM(n) AS s FROM c GROUP BY b)) AS rb) SELECT ROUND((cells - ra * rb / (total * (total - 1) / 2.0)) / ((ra + rb) / 2.0 - ra * rb / (total * (total - 1) / 2.0)), 6) AS ari FROM s",
        "ras02_merged": f"WITH {NODES} SELECT {VOX}, COUNT(*) AS n FROM nodes WHERE {OK} AND type IN (2, 3) GROUP BY 1, 2, 3",
        "ras03_isolated": f"WITH {ANNOTATION}, heat AS (SELECT {VOX}, COUNT(*) AS n FROM nodes WHERE {OK} GROUP BY ALL) SELECT h.i, h.j, h.k, h.n FROM heat h SEMI JOIN (SELECT * FROM annotation WHERE region_id IN ({_IDS})) a ON h.i = a.i AND h.j = a.j AND h.k = a.k",
        "ras06_threshold": f"WITH {HEAT} SELECT i, j, k FROM heat WHERE n BETWEEN 10 AND 100",
        "ras07_region_mask": f"WITH {ANNOTATION} SELECT i, j, k FROM annotation WHERE region_id IN (876, 399369387, 1072)",
        "ras09_voxel_numbers": f"WITH {HEAT} SELECT i, j, k, ROW_NUMBER() OVER (ORDER BY i, j, k) - 1 AS voxel_id FROM dense",
        "fm01_projection": f"WITH {_FM} SELECT file_id, node_id, ROUND(x_flat, 6) AS x_flat, ROUND(y_flat, 6) AS y_flat, depth_um, invalid_code, depth_mode FROM projected",
        "fm08_exposed_faces": f"WITH {_FACES} SELECT i, j, k, axis, side FROM faces",
        "fm08_vertices": f"""WITH {_FACES} SELECT DISTINCT i + CASE WHEN axis = 'i' THEN (side + 1) // 2 ELSE u END AS i, j + CASE WHEN axis = 'j' THEN (side + 1) // 2 WHEN axis = 'i' THEN u ELSE w END AS j, k + CASE WHEN axis = 'k' THEN (side + 1) // 2 ELSE w END AS k
            FROM faces CROSS JOIN (VALUES (0), (1)) a(u) CROSS JOIN (VALUES (0), (1)) b(w)""",
        "fm09_outlines": f"WITH {_FACES} SELECT i, j, k, axis, side FROM faces WHERE axis <> 'i'",
        "fm10_components": f"""WITH RECURSIVE {HEAT}, step AS (SELECT a.i AS i, a.j AS j, a.k AS k, b.i AS bi, b.j AS bj, b.k AS bk FROM dense a JOIN dense b ON ABS(a.i - b.i) + ABS(a.j - b.j) + ABS(a.k - b.k) = 1),
            reach AS (SELECT i, j, k, i AS ci, j AS cj, k AS ck FROM dense UNION SELECT s.bi, s.bj, s.bk, r.ci, r.cj, r.ck FROM reach r JOIN step s ON r.i = s.i AND r.j = s.j AND r.k = s.k)
            SELECT i, j, k, least // 1000000 AS ci, least // 1000 % 1000 AS cj, least % 1000 AS ck FROM (SELECT i, j, k, MIN(ci * 1000000 + cj * 1000 + ck) AS least FROM reach GROUP BY 1, 2, 3)""",
        "agg29_step_curve": f"WITH {HEAT}, e AS (SELECT CAST(MIN(n) AS DOUBLE) AS low, CAST(MAX(n) AS DOUBLE) AS high FROM heat), b AS (SELECT CAST(LEAST(FLOOR((n - low) / ((high - low) / 64)), 63) AS INT) AS bin, COUNT(*) AS c FROM heat CROSS JOIN e GROUP BY 1) SELECT CAST(r.range AS INT) AS bin, side, ROUND(low + (r.range + side) * (high - low) / 64, 4) AS x, COALESCE(c, 0) AS height FROM range(64) r CROSS JOIN (VALUES (0), (1)) v(side) CROSS JOIN e LEFT JOIN b ON r.range = b.bin",
        "snk04_swc_lines": f"WITH {NODES} SELECT file_id, node_id, concat_ws(' ', CAST(node_id AS VARCHAR), CAST(COALESCE(type, 0) AS VARCHAR), {_NUM('x')}, {_NUM('y')}, {_NUM('z')}, {_NUM('radius')}, CAST(COALESCE(parent_id, -1) AS VARCHAR)) AS value FROM nodes",
        "src07_parsed_lines": f"WITH {NODES} SELECT file_id, node_id, COALESCE(type, 0) AS type, {', '.join(f'CASE WHEN isfinite({c}) THEN CAST({_NUM(c)} AS DOUBLE) END AS {c}' for c in ('x', 'y', 'z', 'radius'))}, COALESCE(parent_id, -1) AS parent_id FROM nodes",
        "src08_failed_files": f"WITH {NODES} SELECT DISTINCT file_id, CASE WHEN length(file_id) % 3 = 0 THEN 'no nodes' ELSE 'a field that is no number' END AS reason FROM nodes WHERE length(file_id) % 3 = 0 OR length(file_id) % 2 = 0",
        "src10_node_table": f"""WITH {ANNOTATION}, n AS (SELECT *, {_STEM} AS stem, {', '.join(f'CASE WHEN {OK} THEN CAST(TRUNC(CAST({_NUM(c)} AS DOUBLE) / {SIZE}) AS BIGINT) END AS v{i}' for c, i in zip('xyz', 'ijk'))} FROM nodes)
            SELECT file_id, node_id, COALESCE(an.region_id, 0) AS region_id, COALESCE(r.region_name, '') AS region_name, COALESCE(r.acronym, '') AS region_acronym,
            CASE WHEN regexp_matches(stem, '^\\d+_\\d+_') THEN regexp_extract(stem, '^(\\d+)_(\\d+)_', 2) WHEN regexp_matches(stem, '^H\\d+(\\.\\d+){{6}}_\\d+') THEN regexp_extract(stem, '^(H\\d+(\\.\\d+){{6}})_(\\d+)', 1) ELSE stem END AS subject,
            CASE WHEN regexp_matches(stem, '^\\d+_\\d+_') THEN regexp_extract(stem, '^(\\d+)_(\\d+)_', 1) WHEN regexp_matches(stem, '^H\\d+(\\.\\d+){{6}}_\\d+') THEN regexp_extract(stem, '^(H\\d+(\\.\\d+){{6}})_(\\d+)', 3) ELSE stem END AS neuron_id
            FROM n LEFT JOIN annotation an ON vi = an.i AND vj = an.j AND vk = an.k LEFT JOIN atlas_regions r ON an.region_id = r.region_id""",
        "fm02_mirrored_projection": f"""WITH {_MIRRORED}
            SELECT file_id, node_id, ROUND(CASE WHEN dxy THEN ox WHEN mxy THEN mx END, 6) AS x_flat, ROUND(CASE WHEN dxy THEN oy WHEN mxy THEN my END, 6) AS y_flat, CASE WHEN NOT dxy AND mxy THEN CASE WHEN mdd THEN md END WHEN dd THEN od WHEN mdd THEN md END AS depth_um,
              CASE WHEN dxy AND dd THEN 'direct' WHEN dxy AND mdd THEN 'mirrored_depth' WHEN dxy THEN 'direct' WHEN mxy THEN 'mirrored' ELSE 'unmapped' END AS lookup_mode FROM f""",
        "src18_points": CSV_POINTS + " SELECT * FROM points",
        "agg21_point_groups": CSV_POINTS + " SELECT label, origin_csv AS origin, COUNT(*) AS n_points FROM points GROUP BY 1, 2",
        "agg22_point_volumes": CSV_POINTS + f" SELECT label, origin_csv AS origin, {_ROUNDED}, COUNT(*) AS n FROM points GROUP BY ALL",
        "agg23_label_volumes": CSV_POINTS + f" SELECT label, {_ROUNDED}, COUNT(*) AS n FROM points GROUP BY ALL",
        "pt05_atlas_check": CSV_POINTS + f""", c AS (SELECT p.*, a.region_id AS rid, a.acronym AS ra, a.region_name AS rn, CASE WHEN z < {MIDLINE - 1} THEN 'left' WHEN z > {MIDLINE + 1} THEN 'right' ELSE 'midline' END AS side FROM points p LEFT JOIN atlas_regions a ON p.id = a.region_id),
            m AS (SELECT unnest([CASE WHEN id IS NOT NULL AND rid IS NULL THEN 'id' END, CASE WHEN acronym IS NOT NULL AND NOT COALESCE(acronym = trim(ra), FALSE) THEN 'acronym' END, CASE WHEN region_name IS NOT NULL AND NOT COALESCE({_KEY('region_name')} = {_KEY('rn')}, FALSE) THEN 'region_name' END,
              CASE WHEN hemisphere IS NOT NULL AND NOT COALESCE(lower(hemisphere) = side, FALSE) THEN 'hemisphere' END]) AS field FROM c) SELECT field, COUNT(*) AS n_points FROM m WHERE field IS NOT NULL GROUP BY 1""",
        "cl07_soma_dbscan": dbscan_sql(SOMAS, 300, 3),
        "ras04_otsu_mask": f"""WITH {_HEAT_IN}, e AS (SELECT MIN(n) AS low, MAX(n) AS high, LEAST(256, COUNT(*)) AS bins FROM box), h AS (SELECT LEAST(FLOOR((n - low) / ((high - low) / bins)), bins - 1) AS b, COUNT(*) AS c FROM box CROSS JOIN e GROUP BY 1),
            f AS (SELECT r.range AS b, COALESCE(c, 0) AS c, low + (r.range + 0.5) * ((high - low) / bins) AS mid FROM e CROSS JOIN range(256) r LEFT JOIN h ON h.b = r.range WHERE r.range < bins),
            w AS (SELECT b, mid, SUM(c) OVER u AS nb, SUM(c * mid) OVER u AS sb, SUM(c) OVER () - SUM(c) OVER u AS na, SUM(c * mid) OVER () - SUM(c * mid) OVER u AS sa, b = MAX(b) OVER () AS last FROM f WINDOW u AS (ORDER BY b)),
            t AS (SELECT mid FROM w WHERE NOT last ORDER BY ROUND(nb * na * POW(sb / GREATEST(nb, 1) - sa / GREATEST(na, 1), 2), 3) DESC, b LIMIT 1) SELECT i, j, k FROM box WHERE n >= (SELECT mid FROM t)""",
        "ras08_dilated": f"""WITH {HEAT}, o AS (SELECT range - 12 AS v FROM range(25)), far AS (SELECT i + a.v AS i, j + b.v AS j, k + c.v AS k, MIN(a.v * a.v + b.v * b.v + c.v * c.v) AS d2 FROM dense CROSS JOIN o a CROSS JOIN o b CROSS JOIN o c WHERE a.v * a.v + b.v * b.v + c.v * c.v <= 144
              AND i + a.v BETWEEN 0 AND {SHAPE[0] - 1} AND j + b.v BETWEEN 0 AND {SHAPE[1] - 1} AND k + c.v BETWEEN 0 AND {SHAPE[2] - 1} GROUP BY 1, 2, 3),
            upto AS (SELECT d2, SUM(COUNT(*)) OVER (ORDER BY d2) AS n FROM far GROUP BY d2), edge AS (SELECT MIN(d2) AS d2 FROM upto WHERE n >= 1.5 * (SELECT COUNT(*) FROM dense)) SELECT i, j, k FROM far WHERE d2 <= (SELECT d2 FROM edge)""",
        "ras01_smoothed": f"WITH {_HEAT_IN}, w AS (SELECT range - 4 AS o, EXP(-0.5 * (range - 4) * (range - 4)) / (SELECT SUM(EXP(-0.5 * (r2.range - 4) * (r2.range - 4))) FROM range(9) r2) AS w FROM range(9)), " + _SMOOTH + " SELECT i, j, k, ROUND(n, 6) AS n FROM s3",

        "jn10_flat_segments": f"WITH {FLAT} SELECT a.file_id, a.node_id, a.parent_id, ROUND(b.fx, 9) AS x0, ROUND(b.fy, 9) AS y0, ROUND(b.fd, 9) AS d0, ROUND(a.fx, 9) AS x1, ROUND(a.fy, 9) AS y1, ROUND(a.fd, 9) AS d1 FROM valid a JOIN valid b ON a.file_id = b.file_id AND a.parent_id = b.node_id WHERE a.drawn AND b.drawn AND a.parent_id >= 0",
        "jn10_segment_bins": f"WITH {FLAT}, seg AS (SELECT b.fx AS x0, b.fy AS y0, b.fd AS d0, a.fd AS d1 FROM valid a JOIN valid b ON a.file_id = b.file_id AND a.parent_id = b.node_id WHERE a.drawn AND b.drawn AND a.parent_id >= 0) SELECT CAST(LEAST(GREATEST(FLOOR(x0 * 50), 0), 49) AS BIGINT) AS bx, CAST(LEAST(GREATEST(FLOOR(y0 * 50), 0), 49) AS BIGINT) AS \"by\", COUNT(*) AS n_segments, COUNT(*) FILTER (d1 > d0) AS n_deeper FROM seg GROUP BY 1, 2",
        "xf09_pixels": f"WITH {FLAT} SELECT file_id, node_id, ROUND(GREATEST(-0.5, LEAST(49.5, fx * 50 - 0.5)), 4) AS px FROM valid WHERE xy",
        "jn12_difference_counts": _TWINS + f" SELECT COUNT(*) AS n_rows, COUNT(*) FILTER (lf IS NULL) AS only_right, COUNT(*) FILTER (rf IS NULL) AS only_left, COUNT(*) FILTER (lp IS DISTINCT FROM rp) AS differs_parent_id, COUNT(*) FILTER (lt IS DISTINCT FROM rt) AS differs_type, ROUND(MIN(total), 3) AS least_sum, ROUND(MAX(total), 3) AS greatest_sum, COUNT(*) FILTER (ABS(total - {2 * MIDLINE}) > 0.01) AS bad_sums, ROUND(MAX(ABS(total - {2 * MIDLINE})), 3) AS largest_error FROM pairs",
        "asg08_restricted": f"WITH {NODES} SELECT file_id, MAX(type) AS label FROM nodes WHERE file_id IN (SELECT file_id FROM nodes GROUP BY 1 ORDER BY COUNT(*) DESC, 1 LIMIT 50) GROUP BY 1",
        "snk13_labelled_nodes": f"WITH {NODES}, {_LABELS} SELECT file_id, node_id, label FROM nodes LEFT JOIN label USING (file_id)",
        "snk14_selected_rows": f"WITH {NODES} SELECT CAST(length(file_id) AS INT) AS row_order, file_id, node_id FROM nodes WHERE file_id IN (SELECT file_id FROM nodes GROUP BY 1 ORDER BY COUNT(*) DESC, 1 LIMIT 3)",
        "fn09_region_keys": "SELECT region_id, trim(regexp_replace(regexp_replace(lower(region_name), '\\s*/\\s*', ', ', 'g'), '\\s+', ' ', 'g'), ' ,') AS key, trim(regexp_replace(lower(region_name), '[^0-9a-z]+', '_', 'g'), '_') AS slug, NULLIF(lower(regexp_extract(region_name, '(?i)(?:,|/)\\s*(?:layer\\s+)?(2/3|6a|6b|1|4|5)\\s*$', 1)), '') AS layer FROM atlas_regions",
        "vox_rules": f"WITH {NODES} SELECT CAST(TRUNC(x / 25.0) AS BIGINT) AS a, CAST(FLOOR(x / 25.0) AS BIGINT) AS b, CAST(ROUND_EVEN(x / 25.0, 0) AS BIGINT) AS c, CAST(FLOOR(x / 25.0 + 0.5) AS BIGINT) AS e, COUNT(*) AS n FROM nodes WHERE {OK} GROUP BY 1, 2, 3, 4",
        "sql26_adhoc": "SELECT type, COUNT(*) AS n FROM neurons WHERE region_acronym <> '' AND type >= 2 GROUP BY 1",
    }
