"""Flat-map projection by lookup volumes, bins, layers, segments and bounds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlake.functions.columns import finite, plain_bin, voxel
from arborlake.runtime import is_number

#: Codes and reasons of rows without a projection.
REASONS = {0: "valid", 1: "missing_input", 2: "out_of_bounds", 3: "invalid_flatmap", 4: "invalid_depth"}


@dataclass(frozen=True)
class Grid:
    """Bounds and bins of a flat map."""

    x: tuple[float, float]
    y: tuple[float, float]
    bins: int
    depth: tuple[float, float] = (0.0, 2000.0)
    depth_step: float = 100.0

    @property
    def depth_bins(self) -> int:
        return max(1, int((self.depth[1] - self.depth[0]) // self.depth_step) + 1)


def xy_valid(x: Column | str, y: Column | str, zero_is_hole: bool = False) -> Column:
    """Finite, not (-1, -1), and not (0, 0) if that marks a hole; both components must match a mark."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    ok = is_number(x) & is_number(y) & ~((x == -1) & (y == -1))
    return F.coalesce(ok & ~((x == 0) & (y == 0)) if zero_is_hole else ok, F.lit(False))


def _lookup(nodes: DataFrame, lookup: DataFrame, at: tuple[Column, Column, Column], prefix: str) -> DataFrame:
    names = [c for c in lookup.columns if c not in ("i", "j", "k")]
    table = lookup.select(*[F.col(c).alias(f"{prefix}{c}") for c in ("i", "j", "k")], *[F.col(c).alias(f"{prefix}{c}") for c in names], F.lit(True).alias(f"{prefix}in"))
    on = (at[0] == F.col(f"{prefix}i")) & (at[1] == F.col(f"{prefix}j")) & (at[2] == F.col(f"{prefix}k"))
    return nodes.join(table, on, "left").drop(f"{prefix}i", f"{prefix}j", f"{prefix}k")


def project(nodes: DataFrame, lookup: DataFrame, size: float, shape: tuple[int, int, int], zero_is_hole: bool = False) -> DataFrame:
    """Flat-map position of each node. XY come from its own voxel only; depth from it or else from the mirrored voxel.

    The lookup is a table i, j, k, x_flat, y_flat, depth; marks of holes are
    (-1, -1), on request (0, 0), and a depth below 0. Codes by precedence:
    missing input, out of bounds, invalid flat map, invalid depth, valid.
    Adds x_flat, y_flat, depth_um, flatmap_valid, depth_valid,
    projection_valid, invalid_code, depth_mode.
    """
    ok = finite("x", "y", "z")
    index = {f"_{n}": F.when(ok, voxel(c, size, "half_up")) for n, c in zip("ijk", "xyz")}
    keep = [c for c in nodes.columns if c not in ("x_flat", "y_flat", "depth_um", "flatmap_valid", "depth_valid")]
    out = nodes.select(*keep).withColumns(index)
    inside = ok
    for n, limit in zip("ijk", shape):
        inside = inside & F.coalesce(F.col(f"_{n}").between(0, limit - 1), F.lit(False))
    out = out.withColumn("_inside", inside)
    out = _lookup(out, lookup, (F.col("_i"), F.col("_j"), F.col("_k")), "_o")
    mirrored = lookup.select("i", "j", "k", "depth")
    out = _lookup(out, mirrored, (F.col("_i"), F.col("_j"), F.lit(shape[2] - 1) - F.col("_k")), "_m")
    xy = F.col("_inside") & F.coalesce(F.col("_oin"), F.lit(False)) & xy_valid("_ox_flat", "_oy_flat", zero_is_hole)
    own = F.col("_inside") & F.coalesce(is_number("_odepth") & (F.col("_odepth") >= 0), F.lit(False))
    far = F.col("_inside") & F.coalesce(is_number("_mdepth") & (F.col("_mdepth") >= 0), F.lit(False))
    deep = own | far
    code = F.when(~ok, 1).when(~F.col("_inside"), 2).when(~xy, 3).when(~deep, 4).otherwise(0)
    return out.select(
        *keep,
        F.when(xy, F.col("_ox_flat")).alias("x_flat"), F.when(xy, F.col("_oy_flat")).alias("y_flat"),
        F.when(own, F.col("_odepth")).when(far, F.col("_mdepth")).alias("depth_um"),
        xy.alias("flatmap_valid"), deep.alias("depth_valid"), (xy & deep).alias("projection_valid"), code.alias("invalid_code"),
        F.when(own, "direct").when(far, "mirrored_depth").otherwise("unmapped").alias("depth_mode"),
    )


def project_with_mirror(nodes: DataFrame, lookup: DataFrame, size: float, shape: tuple[int, int, int], midline: float) -> DataFrame:
    """Single-style projection: a node without valid XY is looked up at its mirrored coordinate as a whole,
    one with XY but no depth takes the depth from there. Adds x_flat, y_flat, depth_um, lookup_mode."""
    names = nodes.columns
    direct = project(nodes.withColumn("_row_z", F.col("z")), lookup, size, shape)
    there = project(nodes.withColumn("_row_z", F.col("z")).withColumn("z", 2 * F.lit(float(midline)) - F.col("z")), lookup, size, shape)
    one = lambda df, p: df.select("file_id", "node_id", *[F.col(c).alias(f"{p}{c}") for c in ("x_flat", "y_flat", "depth_um", "flatmap_valid", "depth_mode")])
    both = nodes.join(one(direct, "d_"), ["file_id", "node_id"]).join(one(there, "m_"), ["file_id", "node_id"])
    own_depth, far_depth = F.col("d_depth_mode") == "direct", F.col("m_depth_mode") == "direct"
    full = ~F.col("d_flatmap_valid") & F.col("m_flatmap_valid")
    mode = F.when(F.col("d_flatmap_valid") & own_depth, "direct").when(F.col("d_flatmap_valid") & far_depth, "mirrored_depth").when(F.col("d_flatmap_valid"), "direct").when(full, "mirrored").otherwise("unmapped")
    return both.select(
        *names, F.when(full, F.col("m_x_flat")).otherwise(F.col("d_x_flat")).alias("x_flat"), F.when(full, F.col("m_y_flat")).otherwise(F.col("d_y_flat")).alias("y_flat"),
        F.when(full, F.when(far_depth, F.col("m_depth_um"))).when(own_depth, F.col("d_depth_um")).when(far_depth, F.col("m_depth_um")).alias("depth_um"), mode.alias("lookup_mode"),
    )


def render_valid(x: str, y: str, depth: str, sentinel: bool = False) -> Column:
    """Rows that can be drawn: valid XY, and a depth of 0 or more, or -1 where that has a plane of its own."""
    deep = is_number(depth) & (F.col(depth) >= 0)
    if sentinel:
        deep = deep | F.coalesce(F.col(depth) == -1, F.lit(False))
    return xy_valid(x, y) & deep


def depth_bin(depth: str, grid: Grid, sentinel: bool = False) -> Column:
    """Plane of a depth; with a sentinel plane, -1 is plane 0 and the others move up by one."""
    raw = F.least(F.greatest(F.floor((F.col(depth) - grid.depth[0]) / grid.depth_step), F.lit(0)), F.lit(grid.depth_bins - 1))
    return F.when(F.col(depth) == -1, F.lit(0)).otherwise(raw + 1) if sentinel else raw


def flat_bins(nodes: DataFrame, x: str, y: str, depth: str, grid: Grid, sentinel: bool = False) -> DataFrame:
    """Drawable rows with their bins d, by, bx."""
    return nodes.where(render_valid(x, y, depth, sentinel)).withColumns({"d": depth_bin(depth, grid, sentinel), "by": plain_bin(y, *grid.y, grid.bins), "bx": plain_bin(x, *grid.x, grid.bins)})


def flat_heatmap(nodes: DataFrame, x: str, y: str, depth: str, grid: Grid, by: list[str] | None = None, collapse: bool = False, sentinel: bool = False) -> DataFrame:
    """Nodes per flat-map bin, optionally per group and with all depths in one plane."""
    rows = flat_bins(nodes, x, y, depth, grid, sentinel)
    if collapse:
        rows = rows.withColumn("d", F.lit(0).cast("long"))
    return rows.groupBy(*(by or []), "d", "by", "bx").agg(F.count(F.lit(1)).alias("n"))


def flat_statistics(nodes: DataFrame, x: str, y: str, depth: str) -> DataFrame:
    """Nodes and files: all, with valid XY, drawable, at the depth mark. One pass."""
    xy, drawn = xy_valid(x, y), render_valid(x, y, depth)
    return nodes.agg(
        F.count(F.lit(1)).alias("n_nodes"), F.count_if(xy).alias("n_xy"), F.count_if(drawn).alias("n_drawn"), F.count_if(F.coalesce(F.col(depth) == -1, F.lit(False))).alias("n_marked"),
        F.countDistinct("file_id").alias("n_files"), F.countDistinct(F.when(drawn, F.col("file_id"))).alias("n_files_drawn"),
    )


def flat_bounds(nodes: DataFrame, x: str, y: str, depth: str) -> DataFrame:
    """Least and greatest x, y of rows with valid XY, and depth of those that have one."""
    xy, deep = xy_valid(x, y), render_valid(x, y, depth)
    edge = lambda f, c, ok, n: f(F.when(ok, F.col(c))).alias(n)
    return nodes.agg(*[edge(f, c, ok, f"{n}_{w}") for c, ok, n in ((x, xy, "x"), (y, xy, "y"), (depth, deep, "depth")) for f, w in ((F.min, "low"), (F.max, "high"))])


def flat_somas(nodes: DataFrame, x: str, y: str, depth: str) -> DataFrame:
    """Mean flat-map position of each file's valid somas."""
    return nodes.where((F.col("type") == 1) & render_valid(x, y, depth)).groupBy("file_id").agg(F.avg(x).alias("x"), F.avg(y).alias("y"), F.avg(depth).alias("depth"), F.count(F.lit(1)).alias("n_nodes"))


def layer_heatmap(nodes: DataFrame, layers: DataFrame, x: str, y: str, grid: Grid) -> DataFrame:
    """Nodes per cortical layer and flat-map bin; layers is region_id, layer."""
    rows = nodes.where(xy_valid(x, y)).join(layers.select(F.col("region_id").alias("_r"), "layer"), F.col("region_id") == F.col("_r"))
    return rows.groupBy("layer", plain_bin(y, *grid.y, grid.bins).alias("by"), plain_bin(x, *grid.x, grid.bins).alias("bx")).agg(F.count(F.lit(1)).alias("n"))


def flat_segments(nodes: DataFrame, x: str, y: str, depth: str, most: int | None = None) -> DataFrame:
    """Parent-to-child segments whose ends are both drawable."""
    rows = nodes.where(render_valid(x, y, depth))
    parent = rows.select(F.col("file_id").alias("_f"), F.col("node_id").alias("_n"), F.col(x).alias("x0"), F.col(y).alias("y0"), F.col(depth).alias("d0"))
    out = rows.where("parent_id >= 0").join(parent, (F.col("file_id") == F.col("_f")) & (F.col("parent_id") == F.col("_n"))).select("file_id", "node_id", "parent_id", "x0", "y0", "d0", F.col(x).alias("x1"), F.col(y).alias("y1"), F.col(depth).alias("d1"))
    if most is not None and out.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} segments")
    return out


def pixel(c: Column | str, low: float, high: float, bins: int) -> Column:
    """Continuous pixel coordinate of a value, within the image."""
    c = F.col(c) if isinstance(c, str) else c
    return F.greatest(F.lit(-0.5), F.least(F.lit(bins - 0.5), (c - low) / (high - low) * bins - 0.5))


def projection_summary(projected: DataFrame) -> DataFrame:
    """Rows per reason and mode, with the files that are only partly projected."""
    part = projected.groupBy("file_id").agg(F.bool_or("projection_valid").alias("any"), F.bool_and("projection_valid").alias("all"))
    partial = part.agg(F.count_if(F.col("any") & ~F.col("all")).alias("n_partial_files"))
    return projected.groupBy("invalid_code", "depth_mode").agg(F.count(F.lit(1)).alias("n_nodes"), F.countDistinct("file_id").alias("n_files")).crossJoin(F.broadcast(partial))


def grouped_heatmap(per_file: DataFrame, assignment: DataFrame) -> DataFrame:
    """Bins per file summed up by cluster; files without one have a null cluster, ordered last."""
    a = assignment.select(F.col("file_id").alias("_f"), F.col("label").alias("cluster"))
    return per_file.join(a, F.col("file_id") == F.col("_f"), "left").groupBy("cluster", "d", "by", "bx").agg(F.sum("n").alias("n"))


def plane_labels(grid: Grid, sentinel: bool = False) -> list[str]:
    """What each depth plane holds, for people: the range of depths in µm, or the mark."""
    low = [grid.depth[0] + k * grid.depth_step for k in range(grid.depth_bins)]
    return ["no depth"] * sentinel + [f"{v:g}-{v + grid.depth_step:g} µm" for v in low]


def plane_counts(heatmap: DataFrame, plane: str = "layer") -> DataFrame:
    """Nodes of each plane or layer of a heatmap."""
    return heatmap.groupBy(plane).agg(F.sum("n").alias("n_nodes"))


def inferred_validity(nodes: DataFrame, x: str = "x_flat", y: str = "y_flat", depth: str = "depth_um") -> DataFrame:
    """Validity columns where a table lacks them: XY by finiteness and marks, depth by being 0 or more."""
    out = nodes
    if "flatmap_valid" not in nodes.columns:
        out = out.withColumn("flatmap_valid", xy_valid(x, y))
    if "depth_valid" not in nodes.columns:
        out = out.withColumn("depth_valid", F.coalesce(is_number(depth) & (F.col(depth) >= 0), F.lit(False)))
    return out
