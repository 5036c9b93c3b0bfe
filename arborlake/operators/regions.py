"""Region catalogue: ancestors, descendants, layers."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arborlake.functions.columns import layer_of, path_ids


def catalogue(regions: DataFrame) -> DataFrame:
    """Regions with their path as ids."""
    return regions.withColumn("path", path_ids("structure_id_path"))


def descendants(regions: DataFrame, region_id: int) -> DataFrame:
    """The region and all below it."""
    return catalogue(regions).where(F.array_contains("path", region_id)).select("region_id")


def all_descendants(regions: DataFrame) -> DataFrame:
    """Every (ancestor, descendant), each region being its own."""
    return catalogue(regions).select(F.explode("path").alias("ancestor_id"), F.col("region_id").alias("descendant_id"))


def ancestors(regions: DataFrame) -> DataFrame:
    """Ancestors of each region from the top, with depth; ids that are no region have no acronym."""
    rows = catalogue(regions).select("region_id", F.posexplode("path").alias("depth", "ancestor_id")).where("ancestor_id <> region_id")
    names = regions.select(F.col("region_id").alias("_r"), F.col("acronym").alias("ancestor_acronym"))
    return rows.join(names, F.col("ancestor_id") == F.col("_r"), "left").drop("_r")


def children(regions: DataFrame) -> DataFrame:
    """Sorted child ids of each parent."""
    return regions.where("parent_region_id <> -1").groupBy("parent_region_id").agg(F.array_sort(F.collect_list("region_id")).alias("child_ids"))


def represented(regions: DataFrame, nodes: DataFrame, selection: list[int]) -> DataFrame:
    """Regions of the data that lie in the selection or below it."""
    below = all_descendants(regions).where(F.col("ancestor_id").isin(selection)).select(F.col("descendant_id").alias("region_id")).distinct()
    return nodes.where("region_id > 0").select("region_id").distinct().join(below, "region_id", "left_semi")


def layer_map(regions: DataFrame, root: int | None = None) -> DataFrame:
    """Terminal regions (below the root, if given) whose name ends with a layer. Output: region_id, layer."""
    parents = regions.select(F.col("parent_region_id").alias("_p")).distinct()
    rows = catalogue(regions).join(parents, F.col("region_id") == F.col("_p"), "left_anti")
    if root is not None:
        rows = rows.where(F.array_contains("path", root))
    return rows.select("region_id", layer_of("region_name").alias("layer")).where("layer is not null")


def require_layers(layers: DataFrame, wanted: tuple[str, ...] = ("1", "2/3", "4", "5", "6a", "6b")) -> None:
    """Raise if a layer has no region."""
    there = {r["layer"] for r in layers.select("layer").distinct().collect()}
    missing = [x for x in wanted if x not in there]
    if missing:
        raise ValueError(f"layers without a region: {missing}")


def layer_report(regions: DataFrame) -> DataFrame:
    """Regions per layer."""
    return layer_map(regions).groupBy("layer").agg(F.count(F.lit(1)).alias("n_regions"), F.min("region_id").alias("least_id"))


def leaf_order(regions: DataFrame) -> DataFrame:
    """Regions by lower-cased name, acronym and id."""
    return regions.select("region_id", "acronym", "region_name").orderBy(F.lower("region_name"), "acronym", "region_id")


def with_names(nodes: DataFrame, regions: DataFrame) -> DataFrame:
    """Name and acronym by region_id; '' where the id is unknown."""
    dim = regions.select(F.col("region_id").alias("_r"), F.col("region_name").alias("_name"), F.col("acronym").alias("_acronym"))
    keep = [c for c in nodes.columns if c not in ("region_name", "region_acronym")]
    return nodes.join(dim, F.col("region_id") == F.col("_r"), "left").select(*keep, F.coalesce("_name", F.lit("")).alias("region_name"), F.coalesce("_acronym", F.lit("")).alias("region_acronym"))


def digest(regions: DataFrame) -> str:
    """SHA-256 of the catalogue (a small, fixed table)."""
    rows = sorted((r["region_id"], r["acronym"], r["structure_id_path"]) for r in regions.select("region_id", "acronym", "structure_id_path").collect())
    return hashlib.sha256(json.dumps(rows, separators=(",", ":")).encode()).hexdigest()


def layer_hierarchy(regions: DataFrame, layers: DataFrame) -> DataFrame:
    """The catalogue by layers: one row a terminal region, in order of layer, lower-cased name, acronym and id.

    ``layers`` is region_id, layer. A region of several layers, or one that
    the catalogue does not name, raises. Output: layer, position (from 1
    within its layer), region_id, acronym, region_name.
    """
    per = layers.groupBy("region_id").agg(F.countDistinct("layer").alias("n")).where("n > 1").select("region_id").limit(5).collect()
    if per:
        raise ValueError(f"regions of more than one layer: {[r[0] for r in per]}")
    dim = regions.select(F.col("region_id").alias("_r"), F.trim("acronym").alias("acronym"), F.trim("region_name").alias("region_name"))
    rows = layers.distinct().join(dim, F.col("region_id") == F.col("_r"), "left")
    bad = rows.where("coalesce(acronym, '') = '' or coalesce(region_name, '') = ''").select("region_id").limit(5).collect()
    if bad:
        raise ValueError(f"regions without a name or acronym: {[r[0] for r in bad]}")
    by = Window.partitionBy("layer").orderBy(F.lower("region_name"), F.lower("acronym"), "region_id")  # rows of the catalogue
    return rows.select("layer", F.row_number().over(by).alias("position"), "region_id", "acronym", "region_name")
