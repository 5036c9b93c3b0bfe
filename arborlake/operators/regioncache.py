"""Regions in flat-map bins: occupancy, labels, unions of descendants with their surfaces, and the stored cache of them."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.functions.columns import plain_bin
from arborlake.operators.augment import STYLES, style_of
from arborlake.operators.flatmap import Grid, depth_bin, xy_valid
from arborlake.operators.regions import all_descendants, digest
from arborlake.operators.voxels import IJK
from arborlake.runtime import is_number

VERSION = 1
TABLES = ("occupancy", "labels", "footprints", "surfaces")
MANIFEST = "manifest.json"


def valid_regions(ids: list[int]) -> list[int]:
    """Sorted positive ids, each once; none left is an error."""
    out = sorted({int(v) for v in ids if v is not None and int(v) > 0})
    if not out:
        raise ValueError("no region with a positive id")
    return out


def binned_voxels(annotation: DataFrame, lookup: DataFrame, style: str, grid: Grid, shape: tuple[int, int, int], mirror_axis: str = "k", mirrored_depth: bool = True) -> DataFrame:
    """Annotated voxels with a flat-map bin: region_id, d, by, bx, mirrored.

    XY are those of the voxel; a voxel without depth takes that of the
    mirrored voxel, if asked for.
    """
    s = style_of(style)
    own = lookup.select(*IJK, F.col(f"x_{s}").alias("fx"), F.col(f"y_{s}").alias("fy"), F.col("depth").alias("own"))
    rows = annotation.where("region_id > 0").join(own, list(IJK))
    rows = rows.where(xy_valid("fx", "fy"))
    has = lambda c: F.coalesce(is_number(c) & (F.col(c) >= 0), F.lit(False))
    if mirrored_depth:
        there = lookup.where(has("depth")).select(*[(F.lit(shape["ijk".index(n)] - 1) - F.col(n) if n == mirror_axis else F.col(n)).alias(n) for n in IJK], F.col("depth").alias("far"))
        rows = rows.join(there, list(IJK), "left")
    else:
        rows = rows.withColumn("far", F.lit(None).cast("double"))
    rows = rows.withColumns({"depth": F.when(has("own"), F.col("own")).otherwise(F.col("far")), "mirrored": ~has("own")}).where("depth is not null")
    return rows.select("region_id", depth_bin("depth", grid).alias("d"), plain_bin("fy", *grid.y, grid.bins).alias("by"), plain_bin("fx", *grid.x, grid.bins).alias("bx"), "mirrored")


def occupancy(voxels: DataFrame) -> DataFrame:
    """Voxels per region and bin; map-side counts are merged by the shuffle. Output: region_id, d, by, bx, n, n_mirrored."""
    return voxels.groupBy("region_id", "d", "by", "bx").agg(F.count(F.lit(1)).alias("n"), F.count_if("mirrored").alias("n_mirrored"))


def bin_labels(occupied: DataFrame) -> DataFrame:
    """Region of most voxels per bin, ties to the least id, and how many regions meet there: d, by, bx, region_id, n, n_regions."""
    best = F.max(F.struct(F.col("n").alias("n"), (-F.col("region_id")).alias("r")))
    return occupied.groupBy("d", "by", "bx").agg(best.alias("b"), F.count(F.lit(1)).alias("n_regions")).select("d", "by", "bx", (-F.col("b.r")).alias("region_id"), F.col("b.n").alias("n"), "n_regions")


def collisions(labels: DataFrame) -> DataFrame:
    """Bins, and those in which several regions meet."""
    return labels.agg(F.count(F.lit(1)).alias("n_bins"), F.count_if(F.col("n_regions") > 1).alias("n_collisions"))


def region_slice(occupied: DataFrame, region_id: int) -> DataFrame:
    """Bins of one region."""
    return occupied.where(F.col("region_id") == region_id).select("d", "by", "bx", "n")


def region_unions(occupied: DataFrame, regions: DataFrame) -> DataFrame:
    """Bins of each region together with all below it: region_id, d, by, bx. Regions that are in no catalogue stand for themselves."""
    below = all_descendants(regions).select(F.col("ancestor_id").alias("region_id"), F.col("descendant_id").alias("of"))
    own = occupied.select(F.col("region_id"), F.col("region_id").alias("of")).distinct()
    pairs = below.unionByName(own).distinct()
    bins = occupied.select(F.col("region_id").alias("of"), "d", "by", "bx")
    return pairs.join(bins, "of").select("region_id", "d", "by", "bx").distinct()


def footprints(unions: DataFrame) -> DataFrame:
    """The footprint that each region's bins make; equal sets of bins are one footprint.

    Sets are compared by their number of bins and two sums of 64-bit hashes,
    which need no list of bins. A footprint is named by its least region.
    Output: region_id, footprint, n_bins.
    """
    half = lambda salt: F.sum(F.xxhash64(F.lit(salt), "d", "by", "bx").cast("decimal(38,0)"))
    prints = unions.groupBy("region_id").agg(F.count(F.lit(1)).alias("n_bins"), half(1).alias("h1"), half(2).alias("h2"))
    named = prints.groupBy("n_bins", "h1", "h2").agg(F.min("region_id").alias("footprint"))
    return prints.join(named, ["n_bins", "h1", "h2"]).select("region_id", "footprint", "n_bins")


def surfaces(unions: DataFrame, of: DataFrame) -> DataFrame:
    """Exposed faces of each footprint, built once: footprint, d, by, bx, axis, side. Faces along by and bx are the outlines of the planes."""
    once = of.where("region_id = footprint").select("region_id")
    bins = unions.join(once, "region_id", "left_semi").withColumnRenamed("region_id", "footprint")
    axes = ("d", "by", "bx")
    sides = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.lit(s).alias("side")) for a in axes for s in (-1, 1)])).alias("f")
    faces = bins.select("footprint", *axes, sides).select("footprint", *axes, "f.axis", "f.side")
    next_ = {a: F.when(F.col("axis") == a, F.col(a) + F.col("side")).otherwise(F.col(a)) for a in axes}
    faces = faces.withColumns({f"n_{a}": v for a, v in next_.items()})
    there = bins.select(F.col("footprint").alias("_p"), *[F.col(a).alias(f"_{a}") for a in axes])
    same = F.col("footprint") == F.col("_p")
    for a in axes:
        same = same & (F.col(f"n_{a}") == F.col(f"_{a}"))
    return faces.join(there, same, "left_anti").select("footprint", *axes, "axis", "side")


def surface_of(cache: dict, style: str, region_id: int) -> DataFrame:
    """Faces of one region of an opened cache."""
    of = cache["tables"]["footprints"].where((F.col("style") == style_of(style)) & (F.col("region_id") == region_id)).select("footprint")
    return cache["tables"]["surfaces"].where(F.col("style") == style_of(style)).join(of, "footprint", "left_semi").select("d", "by", "bx", "axis", "side")


def outlines_of(cache: dict, style: str, region_id: int) -> DataFrame:
    return surface_of(cache, style, region_id).where("axis <> 'd'")


def atlas_family(name: str) -> str:
    """An atlas name without the resolution at its end."""
    return re.sub(r"_\d+(?:\.\d+)?um$", "", name.strip())


def build_cache(annotation: DataFrame, lookup: DataFrame, regions: DataFrame, grids: dict[str, Grid], path: str, shape: tuple[int, int, int], about: dict, mirror_axis: str = "k", mirrored_depth: bool = True) -> dict:
    """Build and publish the cache: tables of occupancy, labels, footprints and surfaces by style, and a manifest.

    ``about`` names lookup_set_id, atlas, version, resolution_um (of the
    annotation) and lookup_shape, lookup_resolution_um. Both grids of voxels
    must be of one shape and resolution, and both styles of one range of depth.
    """
    from arborlake.sources import store

    if tuple(about.get("lookup_shape", shape)) != tuple(shape):
        raise ValueError(f"shapes differ: annotation {tuple(shape)}, lookup {tuple(about['lookup_shape'])}")
    if about.get("lookup_resolution_um", about.get("resolution_um")) != about.get("resolution_um"):
        raise ValueError("resolutions of annotation and lookup differ")
    depths = {(g.depth, g.depth_step) for g in grids.values()}
    if len(depths) > 1:
        raise ValueError(f"the styles have different ranges of depth: {sorted(depths)}")
    spark, staged = annotation.sparkSession, store.staging(path)
    counts = {}
    for style, grid in grids.items():
        at = lambda table: f"{staged}/{table}/style={style_of(style)}"  # noqa: E731, B023
        occupancy(binned_voxels(annotation, lookup, style, grid, shape, mirror_axis, mirrored_depth)).write.parquet(at("occupancy"))
        occupied = spark.read.parquet(at("occupancy"))
        bin_labels(occupied).write.parquet(at("labels"))
        unions = region_unions(occupied, regions)
        footprints(unions).write.parquet(at("footprints"))
        of = spark.read.parquet(at("footprints"))
        surfaces(unions, of).write.parquet(at("surfaces"))
        counts[style_of(style)] = {t: spark.read.parquet(at(t)).count() for t in TABLES}
    manifest = {
        "version": VERSION, **about, "family": atlas_family(about.get("atlas", "")), "shape": list(shape), "catalogue": digest(regions), "mirror_axis": mirror_axis, "mirrored_depth": mirrored_depth, "rows": counts,
        "grids": {style_of(s): {"x": list(g.x), "y": list(g.y), "bins": g.bins, "depth": list(g.depth), "depth_step": g.depth_step} for s, g in grids.items()},
    }
    store.write_text(spark, f"{staged}/{MANIFEST}", json.dumps(manifest, sort_keys=True))
    store.publish(spark, staged, path)
    return manifest


def open_cache(spark: SparkSession, path: str) -> dict:
    """Manifest and tables of a cache; raises if the manifest is missing or of another version, or a table does not fit it."""
    from arborlake.sources import store

    manifest = json.loads(store.read_text(spark, f"{path}/{MANIFEST}"))
    if manifest.get("version") != VERSION:
        raise ValueError(f"cache version {manifest.get('version')}, not {VERSION}")
    styles, tables = set(manifest.get("rows") or {}), {}
    if not styles or not styles <= set(STYLES):
        raise ValueError(f"no known styles: {sorted(styles)}")
    for t in TABLES:
        if not store.exists(spark, f"{path}/{t}"):
            raise ValueError(f"the table {t} is missing")
        tables[t] = spark.read.parquet(f"{path}/{t}")
        rows = {r["style"]: r["count"] for r in tables[t].groupBy("style").count().collect()}
        if wrong := [s for s in styles if rows.get(s, 0) != manifest["rows"][s][t]]:
            raise ValueError(f"{t} has other rows than the manifest says: {wrong}")
    return {"manifest": manifest, "tables": tables}


def mismatches(manifest: dict, style: str | None = None, **wanted) -> list[str]:
    """Why a cache does not fit what is wanted; an empty list if it does. Atlases are compared without their resolution."""
    out = []
    if "atlas" in wanted:
        wanted["family"] = atlas_family(wanted.pop("atlas"))
    for name, value in wanted.items():
        there = manifest.get(name)
        value = list(value) if isinstance(value, tuple) else value
        if value is not None and there != value:
            out.append(f"{name} differs: {there!r}, wanted {value!r}")
    if style is not None and style_of(style) not in manifest["rows"]:
        out.append(f"no style {style!r}")
    return out


def compatible(manifests: list[dict], **wanted) -> list[dict]:
    return [m for m in manifests if not mismatches(m, **dict(wanted))]


def footprint_components(unions: DataFrame, of: DataFrame) -> DataFrame:
    """Number of 6-connected parts of each footprint: footprint, n_components."""
    from arborlake.operators.components import connected_components

    once = of.where("region_id = footprint").select("region_id")
    bins = unions.join(once, "region_id", "left_semi").select(F.col("region_id").alias("p"), "d", "by", "bx")
    v = bins.withColumn("v", F.struct("p", "d", "by", "bx"))
    steps = F.explode(F.array(*[F.struct(F.col("p"), *[(F.col(n) + (1 if n == a else 0)).alias(n) for n in ("d", "by", "bx")]) for a in ("d", "by", "bx")])).alias("w")
    edges = v.select("v", steps).join(v.select(F.col("v").alias("w")), "w", "left_semi").select("v", "w")
    labels = connected_components(edges)
    joined = v.join(labels, F.col("v") == F.col("vertex"), "left").select("p", F.coalesce("component", "v").alias("c")).distinct()
    return joined.groupBy(F.col("p").alias("footprint")).agg(F.count(F.lit(1)).alias("n_components"))
