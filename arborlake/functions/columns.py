"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from arborlake.runtime import is_number

#: Node types of SWC files.
NODE_TYPES = {0: "undefined", 1: "soma", 2: "axon", 3: "basal dendrite", 4: "apical dendrite", 5: "custom", 6: "unspecified neurite", 7: "glia process"}
#: Fixed value: the layer named at the end of a region's name.
LAYER = r"(?i)(?:,|/)\s*(?:layer\s+)?(2/3|6a|6b|1|4|5)\s*$"


def finite(*names: str) -> Column:
    """True where all the columns are finite numbers."""
    out = F.lit(True)
    for c in names:
        out = out & is_number(c)
    return out


def voxel(c: Column | str, size: float, rule: str = "floor") -> Column:
    """Voxel index of a finite coordinate. Rules: floor, truncate, round (half even), half_up (floor of v + 0.5)."""
    v = (F.col(c) if isinstance(c, str) else c) / F.lit(float(size))
    if rule == "floor":
        return F.floor(v)
    if rule == "truncate":
        return v.cast("long")
    if rule == "round":
        return F.rint(v).cast("long")
    if rule == "half_up":
        return F.floor(v + 0.5)
    raise ValueError(f"unknown voxel rule {rule!r}")


def plain_bin(c: Column | str, low: float, high: float, bins: int) -> Column:
    """Bin of a value in [low, high], the upper edge in the last bin; a degenerate range is padded."""
    if high <= low:
        pad = max(abs(low) * 0.01, 0.5)
        low, high = low - pad, high + pad
    c = F.col(c) if isinstance(c, str) else c
    raw = F.floor((c - F.lit(float(low))) / F.lit(float(high) - float(low)) * bins)
    return F.least(F.greatest(raw, F.lit(0)), F.lit(bins - 1))


def hemisphere(c: Column | str, midline: float, tolerance: float = 1.0) -> Column:
    """left, midline (strictly within the tolerance) or right; null for no value."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.abs(c - midline) < tolerance, "midline").when(c < midline, "left").when(c.isNotNull(), "right")


def region_key(c: Column | str) -> Column:
    """Region name for comparisons: lower case, slashes as commas, single blanks, no outer blanks or commas."""
    c = F.col(c) if isinstance(c, str) else c
    spaced = F.regexp_replace(F.regexp_replace(F.lower(c), r"\s*/\s*", ", "), r"\s+", " ")
    return F.regexp_replace(spaced, r"^[ ,]+|[ ,]+$", "")


def stripped(c: Column | str) -> Column:
    """Text without white space at either end."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def slug(c: Column | str) -> Column:
    """Lower-case name with runs of other characters as one underscore."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^0-9a-z]+", "_"), "^_+|_+$", "")


def origin_or(c: Column | str, blank: str = "(not recorded)") -> Column:
    """Trimmed provenance; blank and null become the placeholder."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.nullif(stripped(c), F.lit("")), F.lit(blank))


def layer_of(name: Column | str) -> Column:
    """Cortical layer key at the end of a region name, null if there is none."""
    name = F.col(name) if isinstance(name, str) else name
    return F.nullif(F.lower(F.regexp_extract(name, LAYER, 1)), F.lit(""))


def path_ids(path: Column | str) -> Column:
    """Ids of a ``/1/2/3/`` structure path, from the top."""
    path = F.col(path) if isinstance(path, str) else path
    return F.transform(F.filter(F.split(path, "/"), lambda p: p != ""), lambda p: p.cast("int"))
