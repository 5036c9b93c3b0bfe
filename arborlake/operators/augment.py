"""Node tables with flat-map columns of both bilateral styles, or of one style, from lookup volumes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlake.functions.columns import finite, voxel
from arborlake.operators.flatmap import Grid, _lookup, flat_segments, project_with_mirror, projection_summary, xy_valid
from arborlake.runtime import is_number

#: Bilateral styles, their short and long names, and the columns of the augmented table.
STYLES = ("shaped", "square")
STYLE_NAMES = {"shaped": "shaped", "square": "square", "both_shaped": "shaped", "both_square": "square", "bilateral_shaped": "shaped", "bilateral_square": "square"}
DEPTH_COLUMNS = ("depth_um", "depth_valid", "depth_invalid_code", "depth_lookup_mode")
SINGLE_COLUMNS = ("x_flat", "y_flat", "depth_um", "flatmap_valid", "depth_valid", "flatmap_projection_valid", "flatmap_invalid_code", "flatmap_lookup_mode")
VERSION = 3


def style_of(name: str) -> str:
    """Short name of a bilateral style; others raise."""
    if name not in STYLE_NAMES:
        raise ValueError(f"not a bilateral style: {name!r}")
    return STYLE_NAMES[name]


def style_columns(style: str) -> tuple[str, ...]:
    s = style_of(style)
    return (f"x_flat_{s}", f"y_flat_{s}", *(f"flatmap_{s}_{c}" for c in ("valid", "projection_valid", "invalid_code", "lookup_mode")))


def _code(ok: Column, inside: Column, xy: Column | None, deep: Column | None) -> Column:
    """Reason by precedence: 1 no coordinates, 2 outside, 3 hole of the flat map, 4 no depth, 0 valid."""
    out = F.when(~ok, 1).when(~inside, 2)
    if xy is not None:
        out = out.when(~xy, 3)
    if deep is not None:
        out = out.when(~deep, 4)
    return out.otherwise(0).cast("byte")


def augmented(nodes: DataFrame, lookup: DataFrame, size: float, shape: tuple[int, int, int], zero_is_hole: bool = False, mirror_axis: str = "k", origin: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """Nodes with the columns of both styles and the depth.

    The lookup is a table i, j, k, x_shaped, y_shaped, x_square, y_square,
    depth; marks of holes are (-1, -1), on request (0, 0), and a depth below
    0. XY come from the node's nearest voxel only; the depth from there or
    else from the voxel mirrored along an axis. Columns of the same names are
    replaced; all other columns and all rows are kept. Values that are not
    valid are NaN.
    """
    ok = finite("x", "y", "z")
    made = {*DEPTH_COLUMNS, *(c for s in STYLES for c in style_columns(s))}
    keep = [c for c in nodes.columns if c not in made]
    out = nodes.select(*keep).withColumns({f"_{n}": F.when(ok, voxel(F.col(c) - o, size, "half_up")) for n, c, o in zip("ijk", "xyz", origin)})
    inside = ok
    for n, limit in zip("ijk", shape):
        inside = inside & F.coalesce(F.col(f"_{n}").between(0, limit - 1), F.lit(False))
    out = out.withColumn("_inside", inside)
    at = {n: F.col(f"_{n}") for n in "ijk"}
    out = _lookup(out, lookup, tuple(at.values()), "_o")
    mirrored = at | {mirror_axis: F.lit(shape["ijk".index(mirror_axis)] - 1) - at[mirror_axis]}
    out = _lookup(out, lookup.select("i", "j", "k", "depth"), tuple(mirrored.values()), "_m")
    within = F.col("_inside")
    own, far = (within & F.coalesce(is_number(c) & (F.col(c) >= 0), F.lit(False)) for c in ("_odepth", "_mdepth"))
    deep, columns = own | far, []
    nan = F.lit(float("nan")).cast("float")
    for s in STYLES:
        xy = within & F.coalesce(F.col("_oin"), F.lit(False)) & xy_valid(f"_ox_{s}", f"_oy_{s}", zero_is_hole)
        pick = lambda c, xy=xy: F.when(xy, F.col(c).cast("float")).otherwise(nan)
        values = (pick(f"_ox_{s}"), pick(f"_oy_{s}"), xy, xy & deep, _code(ok, within, xy, deep), F.when(xy, "direct").otherwise("unmapped"))
        columns += [v.alias(n) for v, n in zip(values, style_columns(s))]
    depth = F.when(own, F.col("_odepth").cast("float")).when(far, F.col("_mdepth").cast("float")).otherwise(nan)
    mode = F.when(own, "direct").when(far, "mirrored_depth").otherwise("unmapped")
    columns += [v.alias(n) for v, n in zip((depth, deep, _code(ok, within, None, deep), mode), DEPTH_COLUMNS)]
    return out.select(*keep, *columns)


def augmented_single(nodes: DataFrame, lookup: DataFrame, size: float, shape: tuple[int, int, int], midline: float, files: list[str] | None = None) -> DataFrame:
    """Nodes with the columns of one style, with the whole-point mirror as a way out; optionally of some files only."""
    from arborlake.operators.nodes import member

    base = member(nodes, "file_id", files)
    keep = [c for c in base.columns if c not in SINGLE_COLUMNS]
    p = project_with_mirror(base.select(*keep), lookup, size, shape, midline)
    ok = finite("x", "y", "z")
    inside = ok
    for c, limit in zip("xyz", shape):
        inside = inside & F.coalesce(voxel(c, size, "half_up").between(0, limit - 1), F.lit(False))
    xy, deep = F.col("x_flat").isNotNull(), F.col("depth_um").isNotNull()
    nan = F.lit(float("nan")).cast("float")
    value = lambda c: F.coalesce(F.col(c).cast("float"), nan)
    values = (value("x_flat"), value("y_flat"), value("depth_um"), xy, deep, xy & deep, F.when(xy & deep, F.lit(0).cast("byte")).otherwise(_code(ok, inside | xy, xy, deep)), F.col("lookup_mode"))
    return p.select(*keep, *[v.alias(n) for v, n in zip(values, SINGLE_COLUMNS)])


def augmentation_counts(table: DataFrame) -> DataFrame:
    """Rows, valid ones per style and by mode of the depth, in one pass."""
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return table.agg(
        F.count(F.lit(1)).alias("n_rows"), *[n(F.col(f"flatmap_{s}_{c}")).alias(f"n_{s}_{c}") for s in STYLES for c in ("valid", "projection_valid")],
        *[n(F.col("depth_lookup_mode") == m).alias(f"n_depth_{m}") for m in ("direct", "mirrored_depth", "unmapped")],
    )


def transform_info(columns: list[str], metadata: dict | None = None) -> dict:
    """What flat-map columns a table has: styles, depth, single style, version and canonical grids."""
    names = set(columns)
    styles = [s for s in STYLES if set(style_columns(s)) <= names]
    meta = metadata or {}
    return {
        "styles": styles, "has_depth": "depth_um" in names, "has_v3_depth": set(DEPTH_COLUMNS) <= names, "has_flatmap": bool(styles) or {"x_flat", "y_flat"} <= names,
        "version": meta.get("version", VERSION if styles else 2 if {"x_flat", "y_flat"} <= names else None), "grids": {s: g for s in STYLES if (g := grid_of(meta, s))},
    }


def grid_of(metadata: dict, style: str) -> Grid | None:
    """Canonical grid of a style from the table's metadata; None where it is not there or does not parse."""
    try:
        spec = metadata["lookup_set"]["styles"][style_of(style)]
        return Grid(tuple(map(float, spec["x_bounds"])), tuple(map(float, spec["y_bounds"])), int(spec.get("bins", 100)), tuple(map(float, spec["depth_bounds_um"])), float(spec.get("depth_step", 100.0)))
    except (KeyError, TypeError, ValueError):
        return None


def lookup_stats(lookup: DataFrame, x: str, y: str, depth: str, zero_is_hole: bool = False) -> DataFrame:
    """Bounds and valid voxels of a lookup volume in one pass.

    A degenerate XY span is padded by 1 % of its value (0.5 at least); a
    degenerate depth span ends 1 above. Without valid values the bounds are null.
    """
    xy, deep = xy_valid(x, y, zero_is_hole), F.coalesce(is_number(depth) & (F.col(depth) >= 0), F.lit(False))
    edge = lambda f, c, ok: f(F.when(ok, F.col(c).cast("double")))
    raw = lookup.agg(*[edge(f, c, ok).alias(f"{n}_{w}") for c, ok, n in ((x, xy, "x"), (y, xy, "y"), (depth, deep, "depth")) for f, w in ((F.min, "low"), (F.max, "high"))], F.count_if(xy).alias("n_xy"), F.count_if(deep).alias("n_depth"))
    out = {}
    for n in "xy":
        low, high = F.col(f"{n}_low"), F.col(f"{n}_high")
        pad = F.when(high <= low, F.greatest(F.abs(low) * 0.01, F.lit(0.5))).otherwise(0.0)
        out |= {f"{n}_low": low - pad, f"{n}_high": high + pad}
    return raw.withColumns(out | {"depth_high": F.when(F.col("depth_high") <= F.col("depth_low"), F.col("depth_low") + 1.0).otherwise(F.col("depth_high"))})


def lookup_set(lookup: DataFrame, size: float, shape: tuple[int, int, int], bins: int = 100, depth_step: float = 100.0) -> dict:
    """Description of a lookup set for a table's metadata: canonical bounds per style and an identity of its content."""
    content = lookup.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*lookup.columns).cast("decimal(38,0)"))).first()
    styles = {}
    for s in STYLES:
        r = lookup_stats(lookup, f"x_{s}", f"y_{s}", "depth").first()
        if r["n_xy"] == 0 or r["n_depth"] == 0:
            raise ValueError(f"the lookup of style {s!r} has no valid values")
        styles[s] = {"x_bounds": [r["x_low"], r["x_high"]], "y_bounds": [r["y_low"], r["y_high"]], "depth_bounds_um": [r["depth_low"], r["depth_high"]], "bins": bins, "depth_step": depth_step}
    return {"lookup_set_id": f"{content[0]:x}-{int(content[1] or 0) % (1 << 64):016x}", "resolution_um": size, "shape": list(shape), "styles": styles}


def write_augmented(nodes: DataFrame, lookup: DataFrame, size: float, shape: tuple[int, int, int], path: str, **rules) -> dict:
    """Write the augmented table (zstd, published by one rename) with its lookup set as metadata; returns the counts."""
    from arborlake.sources.tables import write_table

    meta = {"version": VERSION, "lookup_set": lookup_set(lookup, size, shape)}
    write_table(augmented(nodes, lookup, size, shape, **rules), path, meta, "zstd")
    return augmentation_counts(nodes.sparkSession.read.parquet(path)).first().asDict()


def projected_view(nodes: DataFrame, lookup: DataFrame, size: float, shape: tuple[int, int, int], midline: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Projection of one style with its parent-child segments and its summary."""
    p = augmented_single(nodes, lookup, size, shape, midline)
    summary = projection_summary(p.select("file_id", F.col("flatmap_projection_valid").alias("projection_valid"), F.col("flatmap_invalid_code").alias("invalid_code"), F.col("flatmap_lookup_mode").alias("depth_mode")))
    return p, flat_segments(p, "x_flat", "y_flat", "depth_um"), summary


def stats_reusable(stats: dict, shape: tuple[int, ...], zero_is_hole: bool, negative_is_hole: bool = True) -> bool:
    """Whether statistics of a lookup (shape, zero_is_hole, negative_is_hole) hold for another use of it."""
    return (tuple(stats.get("shape", ())), stats.get("zero_is_hole"), stats.get("negative_is_hole", True)) == (tuple(shape), zero_is_hole, negative_is_hole)
