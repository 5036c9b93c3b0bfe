"""Correlation and clusters of neurons over flat-map bins, from stored flat-map columns."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlake.operators import clustering, correlation
from arborlake.operators.flatmap import Grid, flat_bins
from arborlake.operators.nodes import member
from arborlake.runtime import is_number, written

#: Fixed value: largest grid that a correlation or heatmap may have.
MOST_VOXELS = 100_000_000


def render_bounds(nodes: DataFrame, x: str, y: str, depth: str) -> tuple[tuple[float, float], ...]:
    """Observed bounds of finite values (depth of 0 or more), whatever the validity columns say; raises without any."""
    deep = is_number(depth) & (F.col(depth) >= 0)
    pick = lambda f, c, ok: f(F.when(ok, F.col(c).cast("double")))
    r = nodes.agg(*[pick(f, c, ok) for c, ok in ((x, is_number(x)), (y, is_number(y)), (depth, deep)) for f in (F.min, F.max)]).first()
    if any(v is None for v in r):
        raise ValueError("no flat-map coordinates")
    return (r[0], r[1]), (r[2], r[3]), (r[4], r[5])


def _padded(low: float, high: float) -> tuple[float, float]:
    pad = max(abs(low) * 0.01, 0.5) if high <= low else 0.0
    return low - pad, high + pad


def grid_for(nodes: DataFrame, x: str, y: str, depth: str, bins: int, depth_step: float, canonical: Grid | None = None) -> Grid:
    """Grid of a correlation: canonical bounds if the table names them, else the observed ones."""
    bx, by, bd = (canonical.x, canonical.y, canonical.depth) if canonical else render_bounds(nodes, x, y, depth)
    return Grid(_padded(*bx), _padded(*by), bins, _padded(*bd), depth_step)


def check_size(grid: Grid, collapse: bool, sentinel: bool) -> None:
    n = grid.bins * grid.bins * (1 if collapse else grid.depth_bins + sentinel)
    if n > MOST_VOXELS:
        raise ValueError(f"{n} voxels are too many: use fewer bins or deeper planes")


def rendered(nodes: DataFrame, x: str, y: str, depth: str, grid: Grid, sentinel: bool = True, collapse: bool = False, mask: DataFrame | None = None) -> DataFrame:
    """Drawable rows with their bins and the number of their voxel, (d * bins + by) * bins + bx; with a mask (d, by, bx), only its rows."""
    check_size(grid, collapse, sentinel)
    rows = flat_bins(nodes, x, y, depth, grid, sentinel)
    if mask is not None:
        rows = rows.join(mask.select("d", "by", "bx").distinct(), ["d", "by", "bx"], "left_semi")
    if collapse:
        rows = rows.withColumn("d", F.lit(0).cast("long"))
    return rows.withColumn("voxel", (F.col("d") * grid.bins + F.col("by")) * grid.bins + F.col("bx"))


def bin_counts(rows: DataFrame) -> DataFrame:
    """Nodes per neuron and voxel."""
    return rows.groupBy("file_id", "voxel").agg(F.count(F.lit(1)).alias("n"))


def input_nodes(nodes: DataFrame, x: str, y: str, depth: str, grid: Grid, files: list[str] | None = None, sentinel: bool = True) -> DataFrame:
    """Exact number of nodes that a correlation would use. The depth being collapsed does not change it."""
    return flat_bins(member(nodes, "file_id", files), x, y, depth, grid, sentinel).agg(F.count(F.lit(1)).alias("n_nodes"))


def unassigned(files: DataFrame, counts: DataFrame) -> DataFrame:
    """Files of the cohort without any rendered node."""
    return files.select("file_id").distinct().join(counts.select("file_id").distinct(), "file_id", "left_anti")


def _as_volume(counts: DataFrame) -> DataFrame:
    return counts.select("file_id", F.col("voxel").alias("i"), F.lit(0).cast("long").alias("j"), F.lit(0).cast("long").alias("k"), "n")


def correlated(counts: DataFrame) -> DataFrame:
    """Pearson r of all pairs of neurons over the occupied voxels: swc_id_1, swc_id_2, r."""
    return correlation.dense_pearson(_as_volume(counts))


def correlation_clusters(nodes: DataFrame, x: str, y: str, depth: str, k: int, grid: Grid, method: str = "average", sentinel: bool = True, collapse: bool = False, mask: DataFrame | None = None, files: list[str] | None = None) -> DataFrame:
    """From stored columns to clusters: file_id, label, leaf; unassigned files have nulls. Raises for fewer than two neurons."""
    cohort = member(nodes, "file_id", files)
    counts = written(bin_counts(rendered(cohort, x, y, depth, grid, sentinel, collapse, mask)))
    n = counts.select("file_id").distinct().limit(2).count()
    if n < 2:
        raise ValueError("a correlation takes at least two neurons with rendered nodes")
    labelled = clustering.correlation_clusters(_as_volume(counts), k, method, dense=True)
    none = unassigned(cohort, counts).select("file_id", F.lit(None).cast("int").alias("label"), F.lit(None).cast("int").alias("leaf"))
    return labelled.unionByName(none)


def soma_scales(nodes: DataFrame, x: str, y: str, depth: str, depth_scale: float = 1.0, canonical: Grid | None = None) -> dict[str, float]:
    """Divisors that bring one hemisphere to unit span. Canonical bounds span two hemispheres, so half of x counts; observed ones do not."""
    if depth_scale < 0:
        raise ValueError("the depth scale must not be negative")
    if canonical is None:
        warnings.warn("observed bounds: distances hold within this table only", stacklevel=2)
    bx, by, bd = (canonical.x, canonical.y, canonical.depth) if canonical else render_bounds(nodes, x, y, depth)
    out = {"x": (bx[1] - bx[0]) / (2 if canonical else 1), "y": by[1] - by[0], "depth": bd[1] - bd[0]}
    if bad := [c for c, v in out.items() if not v > 0]:
        raise ValueError(f"no positive span: {bad}")
    return out | {"depth_scale": float(depth_scale)}


def scaled_somas(somas: DataFrame, scales: dict[str, float], with_depth: bool = True) -> DataFrame:
    """Mean flat-map somas (file_id, x, y, depth) on the unit hemisphere: file_id, x, y, z; z is 0 where the depth is left out."""
    z: Column = F.col("depth") / scales["depth"] * scales["depth_scale"] if with_depth else F.lit(0.0)
    return somas.select("file_id", (F.col("x") / scales["x"]).alias("x"), (F.col("y") / scales["y"]).alias("y"), z.alias("z"))
