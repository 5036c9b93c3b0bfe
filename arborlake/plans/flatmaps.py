"""Queries on flat-map columns, region caches, partitions and exports, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborlake.operators import assignments as A
from arborlake.operators import augment as AU
from arborlake.operators import clustering as CL
from arborlake.operators import compare as CMP
from arborlake.operators import correlation as COR
from arborlake.operators import exports as EX
from arborlake.operators import flatcorr as FC
from arborlake.operators import flatmap as FM
from arborlake.operators import nodes as N
from arborlake.operators import points as P
from arborlake.operators import regioncache as RC
from arborlake.operators import regions as R
from arborlake.operators import voxels as V
from arborlake.plans import morphology as M
from arborlake.plans.dealt import CSV_POINTS
from arborlake.plans.morphology import ANNOTATION, MIDLINE, NODES, OK, SHAPE, SIZE, VOX, annotation, labels, nodes
from arborlake.runtime import read_table as t
from arborlake.runtime import times_as_text, written
from arborlake.sources import tables

#: Grid of the stored flat-map columns: x spans both hemispheres.
STORED = FM.Grid((0.0, 2.01), (0.0, 8000.0), 40, (0.0, 1900.0), 100.0)
CACHE = {"shaped": FM.Grid((0.0, 1.0), (0.0, 1.0), 50, (0.0, 600.0), 50.0), "square": FM.Grid((0.0, 2.0), (0.0, 1.0), 50, (0.0, 600.0), 50.0)}
FLOATS = ("x_flat_shaped", "y_flat_shaped", "x_flat_square", "y_flat_square", "depth_um", "x_flat", "y_flat")


def stored(s, d):
    """Nodes with the stored newer flat-map column; y and depth are made of the coordinates, somas at the depth mark."""
    rest = ("parent_id", "type", "x", "y", "z", "region_id")
    n = t(s, d, "neurons").groupBy("file_id", "node_id").agg(*[F.min(c).alias(c) for c in rest], F.max("x_flat_shaped").alias("x_flat_shaped"))
    return n.withColumns({"y_made": F.col("y"), "depth_made": F.when(F.col("type") == 1, -1.0).otherwise(F.col("z") / 6.0)})


def both_styles(s, d, of=None):
    """Lookup of both styles over the label volume: holes of the first where j is low, of the second every seventh plane, depths on one side only."""
    a = annotation(s, d) if of is None else of
    hole, other = F.col("j") < 20, F.col("k") % 7 == 0
    pick = lambda h, v: F.when(h, -1.0).otherwise(v)
    return a.select("i", "j", "k", pick(hole, F.col("i") / 133.0).alias("x_shaped"), pick(hole, F.col("k") / 116.0).alias("y_shaped"), pick(other, F.col("i") / 66.5).alias("x_square"), pick(other, F.col("j") / 81.0).alias("y_square"), F.when(F.col("k") < 58, F.col("k") * 10.0).otherwise(-1.0).alias("depth"))


def _plain(df, digits=5):
    """Floats rounded, NaN as null."""
    return df.withColumns({c: F.round(F.when(~F.isnan(c), F.col(c)).cast("double"), digits) for c in FLOATS if c in df.columns})


def _rendered(s, d, collapse=False):
    return FC.rendered(stored(s, d), "x_flat_shaped", "y_made", "depth_made", STORED, True, collapse)


def _bins(s, d, style):
    a = written(annotation(s, d))
    return RC.binned_voxels(a, both_styles(s, d, a), style, CACHE[style], SHAPE)


def _unions(s, d):
    return written(RC.region_unions(written(RC.occupancy(_bins(s, d, "square"))), t(s, d, "atlas_regions")))


def _of_unions(s, d, f):
    u = _unions(s, d)
    return f(u, RC.footprints(u))


def _clustered(s, d):
    return CL.correlation_clusters(COR.voxel_counts(nodes(s, d), SIZE), 8)


def _ordered_distances(s, d):
    counts = written(COR.voxel_counts(nodes(s, d), SIZE))
    return EX.cohort_distances(counts, CL.correlation_clusters(counts, 8))


def _points_of_groups(s, d):
    """Points of the three largest groups."""
    points = M.points(s, d)
    top = P.groups(points).orderBy(F.desc("n_points"), "label", "origin").limit(3).collect()
    return P.of_groups(points, [(x["label"], x["origin"]) for x in top])


def _states(s, d):
    """Several states of each file by the time of loading."""
    return t(s, d, "neurons").where("loaded_at is not null").groupBy("file_id", "loaded_at").agg(F.max("type").alias("label"))


def _flat_somas(s, d):
    somas = FM.flat_somas(stored(s, d).withColumn("depth_made", F.abs("depth_made")), "x_flat_shaped", "y_made", "depth_made")
    return FC.scaled_somas(somas, FC.soma_scales(stored(s, d), "x_flat_shaped", "y_made", "depth_made", 0.5, STORED))


def queries() -> dict:
    r = M._r
    augmented = lambda s, d: M.with_annotation(s, d, [], lambda n, a: AU.augmented(n, written(both_styles(s, d, a)), SIZE, SHAPE))
    return {
        "snk11_augmented": lambda s, d: _plain(augmented(s, d).select("file_id", "node_id", *[c for style in AU.STYLES for c in AU.style_columns(style)], *AU.DEPTH_COLUMNS)),
        "snk11_counts": lambda s, d: AU.augmentation_counts(augmented(s, d)),
        "snk12_augmented_single": lambda s, d: _plain(M.with_annotation(s, d, [], lambda n, a: AU.augmented_single(n, written(M.lookup(s, d, a)), SIZE, SHAPE, MIDLINE)).select("file_id", "node_id", *AU.SINGLE_COLUMNS)),
        "agg34_lookup_stats": lambda s, d: r(AU.lookup_stats(both_styles(s, d), "x_square", "y_square", "depth"), "x_low", "x_high", "y_low", "y_high"),
        "cor03_flat_counts": lambda s, d: FC.bin_counts(_rendered(s, d)),
        "cor03_unassigned": lambda s, d: FC.unassigned(stored(s, d), FC.bin_counts(_rendered(s, d))),
        "cor03_masked_counts": lambda s, d: FC.bin_counts(FC.rendered(stored(s, d), "x_flat_shaped", "y_made", "depth_made", STORED, mask=_rendered(s, d).where("region_id > 0").select("d", "by", "bx"))),
        "cor05_flat_pearson": lambda s, d: r(FC.correlated(FC.bin_counts(_rendered(s, d))), "r"),
        "cor05_flat_pearson_collapsed": lambda s, d: r(FC.correlated(FC.bin_counts(_rendered(s, d, True))), "r"),
        "cor05_flat_clusters": lambda s, d: FC.correlation_clusters(stored(s, d), "x_flat_shaped", "y_made", "depth_made", 6, STORED),
        "agg18_flat_input_nodes": lambda s, d: FC.input_nodes(stored(s, d), "x_flat_shaped", "y_made", "depth_made", STORED),
        "cor07_scaled_somas": lambda s, d: r(_flat_somas(s, d), "x", "y", "z", digits=9),
        "cor07_soma_dbscan": lambda s, d: CL.soma_dbscan(_flat_somas(s, d), 0.05, 3),
        "snk22_occupancy": lambda s, d: RC.occupancy(_bins(s, d, "square")),
        "snk22_occupancy_shaped": lambda s, d: RC.occupancy(_bins(s, d, "shaped")),
        "snk22_labels": lambda s, d: RC.bin_labels(RC.occupancy(_bins(s, d, "square"))),
        "snk22_collisions": lambda s, d: RC.collisions(RC.bin_labels(RC.occupancy(_bins(s, d, "square")))),
        "hlp21_unions": _unions,
        "hlp21_footprints": lambda s, d: RC.footprints(_unions(s, d)),
        "fm12_surfaces": lambda s, d: _of_unions(s, d, RC.surfaces),
        "fm12_components": lambda s, d: _of_unions(s, d, RC.footprint_components),
        "exp01_ordered_clusters": lambda s, d: r(EX.ordered_clusters(nodes(s, d), _clustered(s, d)), "soma_x", "soma_y", "soma_z", digits=4),
        "snk17_extended": lambda s, d: EX.extended(t(s, d, "neurons"), labels(s, d)).select("file_id", "node_id", "cluster_assignment"),
        "snk19_distances": lambda s, d: r(_ordered_distances(s, d), "distance"),
        "snk21_projected_rows": lambda s, d: tables.projected_rows(nodes(s, d).select("file_id", "node_id", "parent_id", "type", "region_id")).select("file_id", "node_id", "parent_id", "type", "region_id", "x_flat", "allen_layer_label"),
        "cl09_mutual_information": lambda s, d: r(A.mutual_information(labels(s, d), labels(s, d, "name")), "nmi"),
        "cl09_compared_linkages": lambda s, d: r(CL.compare_linkages(COR.voxel_counts(nodes(s, d), SIZE)), "ari", "nmi"),
        "agg28_common_histograms": lambda s, d: V.common_histograms(V.binned(nodes(s, d), SIZE).groupBy(F.col("type").cast("string").alias("name"), "i", "j", "k").agg(F.count(F.lit(1)).alias("n")), 32).select("name", "bin", "n"),
        "set07_sources_excluded": lambda s, d: V.neurons_in_masks(nodes(s, d), M.dense(s, d), SIZE, N.largest_neurons(nodes(s, d), 40), nodes(s, d).where("type = 1").select("file_id")),
        "flt12_world_bounds": lambda s, d: V.world_bounds(M.dense(s, d), SIZE),
        "reg02_region_at": lambda s, d: V.region_at(N.soma_rows(nodes(s, d)), annotation(s, d), t(s, d, "atlas_regions"), SIZE).select("file_id", "node_id", "region_id", "acronym"),
        "reg09_layer_hierarchy": lambda s, d: R.layer_hierarchy(t(s, d, "atlas_regions"), R.layer_map(t(s, d, "atlas_regions"))),
        "agg36_layer_counts": lambda s, d: FM.plane_counts(FM.layer_heatmap(M.flat_nodes(s, d), R.layer_map(t(s, d, "atlas_regions")), "fx", "fy", M.GRID)),
        "flt13_points_of_groups": lambda s, d: _points_of_groups(s, d).select("origin_csv", "line_no", "label"),
        "flt22_filtered": lambda s, d: A.filtered(A.active_map(nodes(s, d), labels(s, d).where("label < 5")), [2, 3], True),
        "win07_first_state": lambda s, d: times_as_text(A.latest_state(_states(s, d), "loaded_at"), "loaded_at"),
        "hlp38_last_state": lambda s, d: times_as_text(A.latest_state(_states(s, d), "loaded_at", keep="last"), "loaded_at"),
        "top02_mismatches": lambda s, d: CMP.mismatches(M._twins(s, d), "region_id", ["file_id", "node_id"], 15).select("file_id", "node_id", F.col("l.region_id").alias("left_region"), F.col("r.region_id").alias("right_region")),
        "sort03_leaf_order": lambda s, d: R.leaf_order(t(s, d, "atlas_regions")),
        "asg05_members": lambda s, d: A.members(labels(s, d), 4),
        "hlp07_labels_by_text": lambda s, d: A.labels_by_text(nodes(s, d).select("file_id").distinct(), labels(s, d).select("file_id", F.when(F.col("label") == 4, "").otherwise(F.col("label").cast("string")).alias("label"))),
        "hlp13_plot_series": lambda s, d: r(V.plot_series(V.binned(nodes(s, d), SIZE).groupBy(F.col("type").cast("string").alias("name"), "i", "j", "k").agg(F.count(F.lit(1)).alias("n")), 32), "x", digits=4).select("name", "bin", "side", "x", F.col("y").alias("height")),
        "hlp14_region_voxels": lambda s, d: V.voxel_numbers(V.region_mask(annotation(s, d), [M.IDS[2]])),
        "hlp49_added": lambda s, d: A.string_members(nodes(s, d).select("file_id").distinct(), N.largest_neurons(nodes(s, d), 25)),
        "hlp05_inferred_validity": lambda s, d: FM.inferred_validity(M.flat_nodes(s, d), "fx", "fy", "fd").select("file_id", "node_id", "flatmap_valid", "depth_valid"),
        "pt05_at_place": lambda s, d: P.checked_at_place(M.points(s, d), annotation(s, d), t(s, d, "atlas_regions"), MIDLINE, SIZE).select("origin_csv", "line_no", "label", "place_id", "place_acronym", "place_side", "mismatches"),
    }


_DIMS = " AND ".join(f"v{n} BETWEEN 0 AND {limit - 1}" for n, limit in zip("ijk", SHAPE))
_BOTH = f"""{ANNOTATION}, lookup2 AS (SELECT i, j, k, CASE WHEN j < 20 THEN -1.0 ELSE i / 133.0 END AS x1, CASE WHEN j < 20 THEN -1.0 ELSE k / 116.0 END AS y1,
  CASE WHEN k % 7 = 0 THEN -1.0 ELSE i / 66.5 END AS x2, CASE WHEN k % 7 = 0 THEN -1.0 ELSE j / 81.0 END AS y2, CASE WHEN k < 58 THEN k * 10.0 ELSE -1.0 END AS depth, region_id FROM annotation)"""
_V3 = f"""{_BOTH}, placed AS (SELECT *, COALESCE({OK}, FALSE) AS ok, {', '.join(f'CASE WHEN {OK} THEN CAST(FLOOR({c} / {SIZE} + 0.5) AS BIGINT) END AS v{n}' for c, n in zip('xyz', 'ijk'))} FROM nodes),
  looked AS (SELECT p.*, COALESCE(ok AND {_DIMS}, FALSE) AS inside, o.x1, o.y1, o.x2, o.y2, o.depth AS od, m.depth AS md FROM placed p
    LEFT JOIN lookup2 o ON vi = o.i AND vj = o.j AND vk = o.k LEFT JOIN lookup2 m ON vi = m.i AND vj = m.j AND {SHAPE[2] - 1} - vk = m.k),
  flags AS (SELECT *, COALESCE(inside AND x1 IS NOT NULL AND NOT (x1 = -1 AND y1 = -1), FALSE) AS one, COALESCE(inside AND x2 IS NOT NULL AND NOT (x2 = -1 AND y2 = -1), FALSE) AS two, COALESCE(inside AND od >= 0, FALSE) AS own, COALESCE(inside AND md >= 0, FALSE) AS far FROM looked)"""
_FLOAT = lambda when, v: f"ROUND(CAST(CAST(CASE WHEN {when} THEN {v} END AS FLOAT) AS DOUBLE), 5)"
_CODE = lambda xy: f"CAST(CASE WHEN NOT ok THEN 1 WHEN NOT inside THEN 2 {f'WHEN NOT {xy} THEN 3' if xy else ''} WHEN NOT (own OR far) THEN 4 ELSE 0 END AS TINYINT)"
_STYLE = lambda s, xy, n: f"""{_FLOAT(xy, f'x{n}')} AS x_flat_{s}, {_FLOAT(xy, f'y{n}')} AS y_flat_{s}, {xy} AS flatmap_{s}_valid, {xy} AND (own OR far) AS flatmap_{s}_projection_valid,
  {_CODE(xy)} AS flatmap_{s}_invalid_code, CASE WHEN {xy} THEN 'direct' ELSE 'unmapped' END AS flatmap_{s}_lookup_mode"""  # noqa: E731
_DEPTH = f"""{_FLOAT('own OR far', 'CASE WHEN own THEN od ELSE md END')} AS depth_um, own OR far AS depth_valid, {_CODE('')} AS depth_invalid_code, CASE WHEN own THEN 'direct' WHEN far THEN 'mirrored_depth' ELSE 'unmapped' END AS depth_lookup_mode"""
_STORED = f"""stored AS (SELECT file_id, node_id, MIN(type) AS type, MIN(y) AS fy, MAX(x_flat_shaped) AS fx, MIN(region_id) AS region_id, CASE WHEN MIN(type) = 1 THEN -1.0 ELSE MIN(z) / 6.0 END AS fd FROM neurons GROUP BY 1, 2),
  drawn AS (SELECT *, CASE WHEN fd = -1 THEN 0 ELSE CAST(LEAST(GREATEST(FLOOR(fd / 100.0), 0), 19) AS BIGINT) + 1 END AS d, CAST(LEAST(GREATEST(FLOOR(fy / 8000.0 * 40), 0), 39) AS BIGINT) AS "by", CAST(LEAST(GREATEST(FLOOR(CAST(fx AS DOUBLE) / 2.01 * 40), 0), 39) AS BIGINT) AS bx
    FROM stored WHERE isfinite(fx) AND isfinite(fy) AND NOT (fx = -1 AND fy = -1) AND isfinite(fd) AND (fd >= 0 OR fd = -1))"""


_STATES = "WITH st AS (SELECT file_id, loaded_at, MAX(type) AS label FROM neurons WHERE loaded_at IS NOT NULL GROUP BY 1, 2)"


def _pearson_sql(voxel: str) -> str:
    return f"""WITH {_STORED}, counts AS (SELECT file_id, {voxel} AS voxel, COUNT(*) AS n FROM drawn GROUP BY 1, 2), sums AS (SELECT file_id, CAST(SUM(n) AS DOUBLE) AS s, CAST(SUM(n * n) AS DOUBLE) AS q FROM counts GROUP BY 1),
  total AS (SELECT CAST(COUNT(DISTINCT voxel) AS DOUBLE) AS v FROM counts), pairs AS (SELECT a.file_id AS a, b.file_id AS b, CAST(SUM(a.n * b.n) AS DOUBLE) AS sxy FROM counts a JOIN counts b USING (voxel) WHERE a.file_id < b.file_id GROUP BY 1, 2),
  u AS (SELECT x.file_id AS a, y.file_id AS b, CASE WHEN (v * x.q - x.s * x.s) * (v * y.q - y.s * y.s) > 0 THEN (v * COALESCE(sxy, 0) - x.s * y.s) / SQRT((v * x.q - x.s * x.s) * (v * y.q - y.s * y.s)) ELSE 0 END AS r
    FROM sums x JOIN sums y ON x.file_id < y.file_id LEFT JOIN pairs p ON p.a = x.file_id AND p.b = y.file_id CROSS JOIN total)
  SELECT a AS swc_id_1, b AS swc_id_2, ROUND(GREATEST(-1, LEAST(1, r)), 6) AS r FROM u UNION ALL SELECT b, a, ROUND(GREATEST(-1, LEAST(1, r)), 6) FROM u UNION ALL SELECT file_id, file_id, 1.0 FROM sums"""


def _occupancy_sql(n: int, x_high: float) -> str:
    return f"""{_BOTH}, deep AS (SELECT a.region_id, a.x{n} AS fx, a.y{n} AS fy, CASE WHEN a.depth >= 0 THEN a.depth ELSE b.depth END AS depth, NOT (a.depth >= 0) AS mirrored FROM lookup2 a
    LEFT JOIN (SELECT * FROM lookup2 WHERE depth >= 0) b ON a.i = b.i AND a.j = b.j AND {SHAPE[2] - 1} - a.k = b.k WHERE NOT (a.x{n} = -1 AND a.y{n} = -1)),
  occ AS (SELECT region_id, CAST(LEAST(GREATEST(FLOOR(depth / 50.0), 0), 12) AS BIGINT) AS d, CAST(LEAST(GREATEST(FLOOR(fy * 50), 0), 49) AS BIGINT) AS "by", CAST(LEAST(GREATEST(FLOOR(fx / {x_high} * 50), 0), 49) AS BIGINT) AS bx, COUNT(*) AS n, COUNT(*) FILTER (mirrored) AS n_mirrored
    FROM deep WHERE depth IS NOT NULL GROUP BY 1, 2, 3, 4)"""


_OCC = _occupancy_sql(2, 2.0)
_LABELLED = _OCC + """, binned AS (SELECT d, "by", bx, region_id, n, ROW_NUMBER() OVER (PARTITION BY d, "by", bx ORDER BY n DESC, region_id) AS place, COUNT(*) OVER (PARTITION BY d, "by", bx) AS n_regions FROM occ)"""
_UNION = _OCC + """, below AS (SELECT CAST(unnest(list_filter(string_split(structure_id_path, '/'), lambda p: p <> '')) AS INT) AS a, region_id AS b FROM atlas_regions UNION SELECT region_id, region_id FROM occ),
  unions AS (SELECT DISTINCT a AS region_id, d, "by", bx FROM below JOIN occ ON b = occ.region_id)"""
_PRINTS = _UNION + """, lists AS (SELECT region_id, list((d, "by", bx) ORDER BY d, "by", bx) AS bins FROM unions GROUP BY 1), prints AS (SELECT region_id, MIN(region_id) OVER (PARTITION BY bins) AS footprint, len(bins) AS n_bins FROM lists)"""


def oracle_sql() -> dict[str, str]:
    sides = "VALUES ('d', -1, -1, 0, 0), ('d', 1, 1, 0, 0), ('by', -1, 0, -1, 0), ('by', 1, 0, 1, 0), ('bx', -1, 0, 0, -1), ('bx', 1, 0, 0, 1)"
    somas = f"{NODES}, lab AS (SELECT file_id, MAX(type) AS a, CAST(length(file_id) AS INT) AS b FROM nodes GROUP BY 1), c AS (SELECT a, b, COUNT(*) AS n FROM lab GROUP BY 1, 2), tot AS (SELECT SUM(n) AS t FROM c)"
    return {
        "snk11_augmented": f"WITH {_V3} SELECT file_id, node_id, {_STYLE('shaped', 'one', 1)}, {_STYLE('square', 'two', 2)}, {_DEPTH} FROM flags",
        "snk11_counts": f"""WITH {_V3} SELECT COUNT(*) AS n_rows, COUNT(*) FILTER (one) AS n_shaped_valid, COUNT(*) FILTER (one AND (own OR far)) AS n_shaped_projection_valid, COUNT(*) FILTER (two) AS n_square_valid, COUNT(*) FILTER (two AND (own OR far)) AS n_square_projection_valid,
            COUNT(*) FILTER (own) AS n_depth_direct, COUNT(*) FILTER (far AND NOT own) AS n_depth_mirrored_depth, COUNT(*) FILTER (NOT own AND NOT far) AS n_depth_unmapped FROM flags""",
        "snk12_augmented_single": f"""WITH {M._MIRRORED}, u AS (SELECT *, dxy OR mxy AS xy, CASE WHEN NOT dxy AND mxy THEN CASE WHEN mdd THEN md END WHEN dd THEN od WHEN mdd THEN md END AS deep FROM f)
            SELECT file_id, node_id, {_FLOAT('xy', 'CASE WHEN dxy THEN ox ELSE mx END')} AS x_flat, {_FLOAT('xy', 'CASE WHEN dxy THEN oy ELSE my END')} AS y_flat, {_FLOAT('TRUE', 'deep')} AS depth_um, xy AS flatmap_valid, deep IS NOT NULL AS depth_valid, xy AND deep IS NOT NULL AS flatmap_projection_valid,
              CAST(CASE WHEN xy AND deep IS NOT NULL THEN 0 WHEN NOT ok THEN 1 WHEN NOT din AND NOT xy THEN 2 WHEN NOT xy THEN 3 ELSE 4 END AS TINYINT) AS flatmap_invalid_code, CASE WHEN dxy AND dd THEN 'direct' WHEN dxy AND mdd THEN 'mirrored_depth' WHEN dxy THEN 'direct' WHEN mxy THEN 'mirrored' ELSE 'unmapped' END AS flatmap_lookup_mode FROM u""",
        "cor07_soma_dbscan": M.dbscan_sql(f"{_STORED}, somas AS (SELECT file_id, AVG(CAST(fx AS DOUBLE)) / 1.005 AS x, AVG(fy) / 8000 AS y, AVG(ABS(fd)) / 1900 * 0.5 AS z FROM drawn WHERE type = 1 GROUP BY 1)", 0.05, 3),
        "fm12_components": f"""WITH RECURSIVE {_PRINTS}, b AS (SELECT u.* FROM unions u JOIN prints p ON u.region_id = p.region_id AND p.footprint = p.region_id), reach AS (SELECT region_id, d, "by", bx, d * 10000 + "by" * 100 + bx AS r FROM b UNION
            SELECT o.region_id, o.d, o."by", o.bx, q.r FROM reach q JOIN b o ON q.region_id = o.region_id AND ABS(q.d - o.d) + ABS(q."by" - o."by") + ABS(q.bx - o.bx) = 1), least AS (SELECT region_id, d, "by", bx, MIN(r) AS m FROM reach GROUP BY ALL) SELECT region_id AS footprint, COUNT(DISTINCT m) AS n_components FROM least GROUP BY 1""",
        "agg34_lookup_stats": f"WITH {_BOTH} SELECT ROUND(MIN(x2) FILTER (v), 6) AS x_low, ROUND(MAX(x2) FILTER (v), 6) AS x_high, ROUND(MIN(y2) FILTER (v), 6) AS y_low, ROUND(MAX(y2) FILTER (v), 6) AS y_high, MIN(depth) FILTER (depth >= 0) AS depth_low, MAX(depth) FILTER (depth >= 0) AS depth_high, COUNT(*) FILTER (v) AS n_xy, COUNT(*) FILTER (depth >= 0) AS n_depth FROM (SELECT *, NOT (x2 = -1 AND y2 = -1) AS v FROM lookup2)",
        "cor03_flat_counts": f"WITH {_STORED} SELECT file_id, (d * 40 + \"by\") * 40 + bx AS voxel, COUNT(*) AS n FROM drawn GROUP BY 1, 2",
        "cor03_unassigned": f"WITH {_STORED} SELECT DISTINCT file_id FROM stored WHERE file_id NOT IN (SELECT file_id FROM drawn)",
        "cor03_masked_counts": f"WITH {_STORED} SELECT file_id, (d * 40 + \"by\") * 40 + bx AS voxel, COUNT(*) AS n FROM drawn SEMI JOIN (SELECT d, \"by\", bx FROM drawn WHERE region_id > 0) USING (d, \"by\", bx) GROUP BY 1, 2",
        "cor05_flat_pearson": _pearson_sql('(d * 40 + "by") * 40 + bx'),
        "cor05_flat_pearson_collapsed": _pearson_sql('"by" * 40 + bx'),
        "agg18_flat_input_nodes": f"WITH {_STORED} SELECT COUNT(*) AS n_nodes FROM drawn",
        "cor07_scaled_somas": f"WITH {_STORED} SELECT file_id, ROUND(AVG(CAST(fx AS DOUBLE)) / 1.005, 9) AS x, ROUND(AVG(fy) / 8000, 9) AS y, ROUND(AVG(ABS(fd)) / 1900 * 0.5, 9) AS z FROM drawn WHERE type = 1 GROUP BY 1",
        "snk22_occupancy": f"WITH {_OCC} SELECT * FROM occ",
        "snk22_occupancy_shaped": f"WITH {_occupancy_sql(1, 1.0)} SELECT * FROM occ",
        "snk22_labels": f'WITH {_LABELLED} SELECT d, "by", bx, region_id, n, n_regions FROM binned WHERE place = 1',
        "snk22_collisions": f"WITH {_LABELLED} SELECT COUNT(*) AS n_bins, COUNT(*) FILTER (n_regions > 1) AS n_collisions FROM binned WHERE place = 1",
        "hlp21_unions": f"WITH {_UNION} SELECT * FROM unions",
        "hlp21_footprints": f"WITH {_PRINTS} SELECT * FROM prints",
        "fm12_surfaces": f"""WITH {_PRINTS}, b AS (SELECT u.* FROM unions u JOIN prints p ON u.region_id = p.region_id AND p.footprint = p.region_id)
            SELECT region_id AS footprint, d, "by", bx, axis, side FROM b CROSS JOIN ({sides}) f(axis, side, dd, dy, dx) WHERE NOT EXISTS (SELECT 1 FROM b o WHERE o.region_id = b.region_id AND o.d = b.d + dd AND o."by" = b."by" + dy AND o.bx = b.bx + dx)""",
        "snk17_extended": "SELECT file_id, node_id, MAX(type) OVER (PARTITION BY file_id) AS cluster_assignment FROM neurons",
        "snk21_projected_rows": f"WITH {NODES} SELECT COALESCE(file_id, 'NaN') AS file_id, COALESCE(CAST(node_id AS VARCHAR), 'NaN') AS node_id, COALESCE(CAST(parent_id AS VARCHAR), 'NaN') AS parent_id, COALESCE(CAST(type AS VARCHAR), 'NaN') AS type, COALESCE(CAST(region_id AS VARCHAR), 'NaN') AS region_id, 'NaN' AS x_flat, 'NaN' AS allen_layer_label FROM nodes",
        "cl09_mutual_information": f"""WITH {somas}, h AS (SELECT (SELECT -SUM(s / t * LN(s / t)) FROM (SELECT SUM(n) AS s FROM c GROUP BY a), tot) AS ha, (SELECT -SUM(s / t * LN(s / t)) FROM (SELECT SUM(n) AS s FROM c GROUP BY b), tot) AS hb, (SELECT -SUM(n / t * LN(n / t)) FROM c, tot) AS hab)
            SELECT ROUND(GREATEST(0, (ha + hb - hab) / ((ha + hb) / 2)), 6) AS nmi FROM h""",
        "agg28_common_histograms": f"""WITH {NODES}, heat AS (SELECT CAST(type AS VARCHAR) AS name, {VOX}, CAST(COUNT(*) AS DOUBLE) AS n FROM nodes WHERE {OK} GROUP BY ALL), e AS (SELECT MIN(n) AS low, MAX(n) AS high FROM heat),
            c AS (SELECT name, CAST(LEAST(FLOOR((n - low) / ((high - low) / 32)), 31) AS INT) AS bin, COUNT(*) AS c FROM heat CROSS JOIN e GROUP BY 1, 2) SELECT h.name, CAST(r.range AS INT) AS bin, COALESCE(c, 0) AS n FROM (SELECT DISTINCT name FROM heat) h CROSS JOIN range(32) r LEFT JOIN c ON c.name = h.name AND c.bin = r.range""",
        "set07_sources_excluded": f"""WITH {M.HEAT} SELECT DISTINCT file_id, neuron_id, subject FROM (SELECT *, {VOX} FROM nodes WHERE {OK}) n SEMI JOIN dense USING (i, j, k)
            WHERE file_id NOT IN (SELECT file_id FROM nodes GROUP BY file_id ORDER BY COUNT(*) DESC, file_id LIMIT 40) AND file_id IN (SELECT file_id FROM nodes WHERE type = 1)""",
        "flt12_world_bounds": f"WITH {M.HEAT} SELECT " + ", ".join(f"GREATEST(0.0, (MIN({n}) - 0.5) * {SIZE}) AS {c}_low, (MAX({n}) + 1.5) * {SIZE} AS {c}_high" for n, c in zip("ijk", "zyx")) + " FROM dense",
        "reg02_region_at": f"WITH {ANNOTATION} SELECT n.file_id, n.node_id, a.region_id, r.acronym FROM nodes n JOIN annotation a ON CAST(TRUNC(n.x / {SIZE}) AS BIGINT) = a.i AND CAST(TRUNC(n.y / {SIZE}) AS BIGINT) = a.j AND CAST(TRUNC(n.z / {SIZE}) AS BIGINT) = a.k JOIN atlas_regions r ON a.region_id = r.region_id WHERE n.type = 1 AND isfinite(n.x) AND isfinite(n.y) AND isfinite(n.z)",
        "reg09_layer_hierarchy": "WITH l AS (SELECT region_id, trim(acronym) AS acronym, trim(region_name) AS region_name, lower(regexp_extract(region_name, '(?i)(?:,|/)\\s*(?:layer\\s+)?(2/3|6a|6b|1|4|5)\\s*$', 1)) AS layer FROM atlas_regions a WHERE NOT EXISTS (SELECT 1 FROM atlas_regions b WHERE b.parent_region_id = a.region_id)) SELECT layer, CAST(ROW_NUMBER() OVER (PARTITION BY layer ORDER BY lower(region_name), lower(acronym), region_id) AS INT) AS position, region_id, acronym, region_name FROM l WHERE layer <> ''",
        "agg36_layer_counts": f"WITH {M.FLAT}, layers AS (SELECT region_id, lower(regexp_extract(region_name, '(?i)(?:,|/)\\s*(?:layer\\s+)?(2/3|6a|6b|1|4|5)\\s*$', 1)) AS layer FROM atlas_regions a WHERE NOT EXISTS (SELECT 1 FROM atlas_regions b WHERE b.parent_region_id = a.region_id)) SELECT layer, COUNT(*) AS n_nodes FROM valid v JOIN layers l ON v.region_id = l.region_id WHERE xy AND layer <> '' GROUP BY 1",
        "pt05_at_place": CSV_POINTS + f""", {ANNOTATION}, c AS (SELECT p.*, COALESCE(an.region_id, 0) AS place_id, CASE WHEN z < {MIDLINE - 1} THEN 'left' WHEN z > {MIDLINE + 1} THEN 'right' ELSE 'midline' END AS place_side FROM points p
            LEFT JOIN annotation an ON CAST(ROUND_EVEN(z / {SIZE}, 0) AS BIGINT) = an.i AND CAST(ROUND_EVEN(y / {SIZE}, 0) AS BIGINT) = an.j AND CAST(ROUND_EVEN(x / {SIZE}, 0) AS BIGINT) = an.k),
            r AS (SELECT c.*, COALESCE(a.acronym, '') AS place_acronym, COALESCE(a.region_name, '') AS place_name FROM c LEFT JOIN atlas_regions a ON c.place_id = a.region_id)
            SELECT origin_csv, line_no, label, place_id, place_acronym, place_side, NULLIF(concat_ws(',', CASE WHEN id <> place_id THEN 'id' END, CASE WHEN acronym <> trim(place_acronym) THEN 'acronym' END, CASE WHEN {M._KEY('region_name')} <> {M._KEY('place_name')} THEN 'region_name' END, CASE WHEN hemisphere IS NOT NULL AND lower(hemisphere) <> place_side THEN 'hemisphere' END), '') AS mismatches FROM r""",
        "flt13_points_of_groups": CSV_POINTS + " SELECT origin_csv, line_no, label FROM points SEMI JOIN (SELECT label, origin_csv FROM points GROUP BY 1, 2 ORDER BY COUNT(*) DESC, 1, 2 LIMIT 3) USING (label, origin_csv)",
        "flt22_filtered": f"WITH {NODES}, {M._LABELS} SELECT file_id, CASE WHEN label < 5 THEN label END AS label FROM label WHERE label IN (2, 3) OR label >= 5",
        "win07_first_state": _STATES + " SELECT file_id, strftime(loaded_at, '%Y-%m-%d %H:%M:%S.%f') AS loaded_at, label FROM st QUALIFY ROW_NUMBER() OVER (PARTITION BY file_id ORDER BY st.loaded_at) = 1",
        "hlp38_last_state": _STATES + " SELECT file_id, strftime(loaded_at, '%Y-%m-%d %H:%M:%S.%f') AS loaded_at, label FROM st QUALIFY ROW_NUMBER() OVER (PARTITION BY file_id ORDER BY st.loaded_at DESC) = 1",
        "top02_mismatches": M._TWINS.replace("SELECT l.file_id AS lf,", "SELECT l.file_id AS lf, COALESCE(l.file_id, r.file_id) AS file_id, COALESCE(l.node_id, r.node_id) AS node_id,") + " SELECT file_id, node_id, lr AS left_region, rr AS right_region FROM pairs WHERE lr IS DISTINCT FROM rr ORDER BY file_id NULLS FIRST, node_id NULLS FIRST LIMIT 15",
        "sort03_leaf_order": "SELECT region_id, acronym, region_name FROM atlas_regions",
        "asg05_members": f"WITH {NODES}, {M._LABELS} SELECT file_id FROM label WHERE label = 4",
        "hlp07_labels_by_text": f"WITH {NODES}, {M._LABELS} SELECT file_id, CASE WHEN label <> 4 THEN CAST(label AS VARCHAR) END AS label FROM label",
        "hlp13_plot_series": f"""WITH {NODES}, heat AS (SELECT CAST(type AS VARCHAR) AS name, {VOX}, CAST(COUNT(*) AS DOUBLE) AS n FROM nodes WHERE {OK} GROUP BY ALL), e AS (SELECT MIN(n) AS low, MAX(n) AS high FROM heat),
            c AS (SELECT name, CAST(LEAST(FLOOR((n - low) / ((high - low) / 32)), 31) AS INT) AS bin, COUNT(*) AS c FROM heat CROSS JOIN e GROUP BY 1, 2) SELECT h.name, CAST(q.range AS INT) AS bin, side, ROUND(low + (q.range + side) * (high - low) / 32, 4) AS x, COALESCE(c, 0) AS height
            FROM (SELECT DISTINCT name FROM heat) h CROSS JOIN range(32) q CROSS JOIN (VALUES (0), (1)) v(side) CROSS JOIN e LEFT JOIN c ON c.name = h.name AND c.bin = q.range""",
        "hlp14_region_voxels": f"WITH {ANNOTATION} SELECT i, j, k, ROW_NUMBER() OVER (ORDER BY i, j, k) - 1 AS voxel_id FROM annotation WHERE region_id = {M.IDS[2]}",
        "hlp49_added": f"WITH {NODES} SELECT DISTINCT file_id, file_id IN (SELECT file_id FROM nodes GROUP BY 1 ORDER BY COUNT(*) DESC, 1 LIMIT 25) AS added FROM nodes",
        "hlp05_inferred_validity": f"WITH {M.FLAT} SELECT file_id, node_id, COALESCE(xy, FALSE) AS flatmap_valid, COALESCE(isfinite(fd) AND fd >= 0, FALSE) AS depth_valid FROM valid",
    }
