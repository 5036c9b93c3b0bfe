"""Tree operators: edges, segments, termini and their coverage, slabs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.operators.nodes import member

KEY = ("file_id", "node_id")


def edges(nodes: DataFrame) -> DataFrame:
    """Node-to-parent edges; a parent that is not there gives none.

    Both sides hash on (file, id), so no file is ever gathered.
    """
    child = nodes.where("parent_id >= 0").select("file_id", "node_id", "parent_id", "x", "y", "z")
    parent = nodes.select(F.col("file_id").alias("_f"), F.col("node_id").alias("_n"), *[F.col(c).alias(f"parent_{c}") for c in "xyz"])
    return child.join(parent, (F.col("file_id") == F.col("_f")) & (F.col("parent_id") == F.col("_n"))).drop("_f", "_n")


def childless(nodes: DataFrame, children: DataFrame | None = None) -> DataFrame:
    """Nodes that are nobody's parent. All nodes count as children, whatever their type or region.

    ``children`` may be the table as delivered: repeated rows name the same
    parents, so they need not be made distinct first.
    """
    parents = (nodes if children is None else children).select(F.col("file_id").alias("_f"), F.col("parent_id").alias("_p")).where("_p is not null")
    return nodes.join(parents, (F.col("file_id") == F.col("_f")) & (F.col("node_id") == F.col("_p")), "left_anti")


def termini(nodes: DataFrame, types: list[int] | None = None, regions: list[str] | None = None, files: list[str] | None = None, children: DataFrame | None = None) -> DataFrame:
    """Childless nodes of the types and regions. Types and regions filter what is reported, never the children."""
    return member(member(childless(member(nodes, "file_id", files), children), "type", types), "region_acronym", regions)


def coverage(nodes: DataFrame, types: list[int], requested: DataFrame | None = None, children: DataFrame | None = None) -> DataFrame:
    """Childless nodes per cell: of the types, and others. Requested cells without nodes count 0."""
    tally = childless(nodes, children).groupBy("file_id").agg(F.count_if(F.col("type").isin(types)).alias("n_termini"), F.count_if(~F.col("type").isin(types) | F.col("type").isNull()).alias("n_other"))
    if requested is None:
        requested = (nodes if children is None else children).select("file_id").distinct()
    return requested.select("file_id").distinct().join(tally, "file_id", "left").select("file_id", F.coalesce("n_termini", F.lit(0)).alias("n_termini"), F.coalesce("n_other", F.lit(0)).alias("n_other"))


def coverage_summary(covered: DataFrame) -> DataFrame:
    """Cells with and without termini, termini and other childless nodes in all."""
    return covered.agg(F.count_if(F.col("n_termini") > 0).alias("n_with"), F.count_if(F.col("n_termini") == 0).alias("n_without"), F.coalesce(F.sum("n_termini"), F.lit(0)).alias("n_termini"), F.coalesce(F.sum("n_other"), F.lit(0)).alias("n_other"))


def slab_segments(edge_rows: DataFrame, axis: str, position: float, tolerance: float) -> DataFrame:
    """Edges that reach into the slab, flattened to its plane."""
    a, b = F.col(axis), F.col(f"parent_{axis}")
    hit = (F.greatest(a, b) >= position - tolerance) & (F.least(a, b) <= position + tolerance)
    return edge_rows.where(hit).withColumns({axis: F.lit(float(position)), f"parent_{axis}": F.lit(float(position))})


def slab_points(nodes: DataFrame, axis: str, position: float, tolerance: float) -> DataFrame:
    """Nodes in the slab, borders included."""
    return nodes.where(F.col(axis).between(position - tolerance, position + tolerance))


def cable_length(edge_rows: DataFrame) -> DataFrame:
    """Length of all edges per file."""
    d = sum(((F.col(c) - F.col(f"parent_{c}")) * (F.col(c) - F.col(f"parent_{c}")) for c in "xyz"), F.lit(0.0))
    return edge_rows.groupBy("file_id").agg(F.sum(F.sqrt(d)).alias("length"), F.count(F.lit(1)).alias("n_edges"))
