"""Results for people: sentences, colours, checks of schemas and inputs. All work on small frames or on one pass of counts."""

from __future__ import annotations

import colorsys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.functions.columns import NODE_TYPES
from arborlake.operators.morphology import childless, coverage, coverage_summary
from arborlake.operators.nodes import member, soma_sides

#: Columns that termini must and may have, in order.
TERMINUS_BASE = ("file_id", "node_id", "parent_id", "type", "x", "y", "z")
TERMINUS_MORE = ("subject", "radius", "region_id", "region_name", "region_acronym", "x_flat_shaped", "y_flat_shaped", "x_flat_square", "y_flat_square", "depth_um")
#: Resolutions (µm) that an atlas comes in.
RESOLUTIONS = (10, 25, 50, 100)
GREY = (0.5, 0.5, 0.5, 1.0)


def terminus_columns(columns: list[str]) -> list[str]:
    """Columns of a terminus table that a node table supports; missing base columns raise."""
    if missing := [c for c in TERMINUS_BASE if c not in columns]:
        raise ValueError(f"termini need the columns {missing}")
    return [*TERMINUS_BASE, *(c for c in TERMINUS_MORE if c in columns)]


def detected_termini(nodes: DataFrame, types: list[int] | None = None, files: list[str] | None = None) -> DataFrame:
    """Termini with every column that the table supports."""
    return member(childless(member(nodes, "file_id", files)), "type", types).select(*terminus_columns(nodes.columns))


def coverage_sentence(nodes: DataFrame, types: list[int] | None, requested: DataFrame | None = None) -> str:
    """One line on what a search for termini found and left out."""
    chosen = types if types is not None else sorted(NODE_TYPES)
    r = coverage_summary(coverage(nodes, chosen, requested)).first()
    kinds = "all node types" if types is None else " / ".join(NODE_TYPES.get(t, f"type {t}") for t in types) or "no node types"
    text = f"{r['n_termini']:,} termini ({kinds}) in {r['n_with']:,} of {r['n_with'] + r['n_without']:,} neurons"
    text += f"; {r['n_without']:,} neurons without any" if r["n_without"] else ""
    return text + (f"; {r['n_other']:,} childless nodes of other types not counted" if r["n_other"] else "")


def soma_text(summary: DataFrame, path: str, column: str, midline: float, tolerance: float = 1.0) -> str:
    """The hemisphere summary as lines."""
    r = summary.first()
    n = r["n_somas"]
    part = lambda c: f"  {c}: {r[f'n_{c}']} ({100.0 * r[f'n_{c}'] / n if n else 0.0:.2f} %)"
    lines = [f"{path}: {n} somas of {r['n_neurons']} neurons", f"{column} against the midline {midline:.2f} µm, tolerance {tolerance:.2f} µm", *map(part, ("left", "midline", "right"))]
    if r["least"] is not None:
        lines.append(f"  {column}: {r['least']:.2f} to {r['greatest']:.2f} µm, mean {r['mean']:.2f} µm")
    return "\n".join(lines)


def mismatch_text(checked: DataFrame, n_points: int, examples: int = 5) -> str:
    """What a check of points against the atlas found: counts per field and the first examples by origin and line."""
    wrong = checked.where("mismatches is not null")
    fields = wrong.select(F.explode(F.split("mismatches", ",")).alias("f")).groupBy("f").count().orderBy("f").collect()
    if not fields:
        return f"{n_points} points checked, no mismatches"
    order = [c for c in ("origin_csv", "line_no", "label") if c in checked.columns]
    first = wrong.orderBy(*order).limit(examples).collect()
    named = "; ".join(f"{r['label']} [{r['mismatches']}]" for r in first)
    return f"{wrong.count()} of {n_points} points do not fit ({', '.join(f'{r[0]}: {r[1]}' for r in fields)}), among them {named}"


def point_properties(points: DataFrame, most: int = 100_000) -> dict[str, list]:
    """Columns other than the coordinates as lists, for a viewer; raises beyond ``most`` points."""
    rows = points.drop("x", "y", "z").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} points")
    return {c: [r[c] for r in rows] for c in points.columns if c not in ("x", "y", "z")}


def sides_by_atlas(nodes: DataFrame, sides: DataFrame, midline: float, size: float, column: str = "z") -> DataFrame:
    """Files whose soma's side by the midline differs from the atlas's side at its voxel (i, j, k, side).

    Somas outside the atlas and on the midline are not compared. Output: file_id, side, atlas_side.
    """
    from arborlake.operators.nodes import soma_locations
    from arborlake.operators.voxels import binned

    own = soma_sides(nodes, midline, column).select(F.col("file_id").alias("_f"), "side").where("side <> 'midline'")
    at = binned(soma_locations(nodes), size, "truncate").select("file_id", "i", "j", "k")
    there = at.join(sides.select("i", "j", "k", F.col("side").alias("atlas_side")), ["i", "j", "k"])
    return there.join(own, F.col("file_id") == F.col("_f")).where("side <> atlas_side").select("file_id", "side", "atlas_side")


def side_of(value: float, midline: float, tolerance: float = 1.0) -> str:
    """Side of one coordinate."""
    return "midline" if abs(value - midline) < tolerance else "left" if value < midline else "right"


def target_side(name: str) -> str:
    """A side that files can be brought to; the midline is none."""
    if name not in ("left", "right"):
        raise ValueError(f"not a side to bring files to: {name!r}")
    return name


def check_resolution(um: int) -> int:
    if um not in RESOLUTIONS:
        raise ValueError(f"no atlas of {um} µm; there are {RESOLUTIONS}")
    return um


def distinct_colours(n: int) -> list[tuple[float, float, float, float]]:
    """n colours, hues spread by the golden ratio, brightness in three steps."""
    return [(*colorsys.hsv_to_rgb((k * 0.618033988749895) % 1.0, 0.75, (0.95, 0.8, 0.65)[k % 3]), 1.0) for k in range(n)]


def hex_colour(rgba: tuple[float, ...]) -> str:
    return "#" + "".join(f"{round(255 * min(1.0, max(0.0, v))):02x}" for v in rgba[:3])


def recoloured(assignment: dict[str, int | None], label: int | None, grey_others: bool = True) -> dict[str, tuple[float, ...]]:
    """Distinct colours for the members of a cluster (None: the unclustered), grey for the others on request."""
    members = sorted(f for f, v in assignment.items() if v == label)
    out = dict(zip(members, distinct_colours(len(members))))
    return out | {f: GREY for f in assignment if grey_others and f not in out}


