"""Labelled point tables: groups, filters, checks against the atlas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.functions.columns import finite, origin_or, region_key, stripped, voxel
from arborlake.operators.voxels import binned

REQUIRED = ("label", "x", "y", "z")
OPTIONAL = {"region_name": "string", "acronym": "string", "id": "long", "hemisphere": "string"}


def standardised(points: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """Columns under their standard names and types, in the standard order, extras kept.

    Raises for missing required columns, doubled names, blank labels and
    coordinates that are no finite numbers, with their counts.
    """
    names = dict(mapping or {})  # column -> standard name
    if len(set(names.values())) != len(names):
        raise ValueError("a column is mapped twice")
    if missing := [old for old in names if old not in points.columns]:
        raise ValueError(f"mapped columns that are not there: {missing}")
    clash = [new for old, new in names.items() if new in points.columns and new != old and new not in names]
    if clash:
        raise ValueError(f"columns both mapped and there: {clash}")
    out = points.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in points.columns])
    if missing := [c for c in REQUIRED if c not in out.columns]:
        raise ValueError(f"missing columns: {missing}")
    extras = [c for c in out.columns if c not in REQUIRED and c not in OPTIONAL]
    typed = [stripped(F.col("label").cast("string")).alias("label"), *[F.expr(f"try_cast({c} as double)").alias(c) for c in "xyz"]]
    for c, kind in OPTIONAL.items():
        typed.append((F.expr(f"try_cast({c} as {kind})") if c in out.columns else F.lit(None).cast(kind)).alias(c))
    out = out.select(*typed, *[F.col(f"`{c}`") for c in extras])
    bad = out.agg(F.count_if(F.coalesce("label", F.lit("")) == "").alias("label"), *[F.count_if(~finite(c)).alias(c) for c in "xyz"]).first().asDict()
    if wrong := {c: n for c, n in bad.items() if n}:
        raise ValueError(f"invalid values: {wrong}")
    return out


def with_origin(points: DataFrame, origin: str | None = None) -> DataFrame:
    """Provenance filled in: the given origin, or the placeholder where it is blank."""
    there = F.col("origin_csv") if "origin_csv" in points.columns else F.lit(None).cast("string")
    return points.withColumn("origin_csv", origin_or(F.coalesce(there, F.lit(origin))))


def groups(points: DataFrame) -> DataFrame:
    """Points per label and origin."""
    return points.groupBy(stripped("label").alias("label"), origin_or("origin_csv").alias("origin")).agg(F.count(F.lit(1)).alias("n_points"))


def of_groups(points: DataFrame, keys: list[tuple[str, str]]) -> DataFrame:
    """Points of the (label, origin) pairs; blank origins are the placeholder."""
    if not keys:
        return points.where(F.lit(False))
    wanted = points.sparkSession.createDataFrame(list(dict.fromkeys(keys)), "_label string, _origin string").select(stripped("_label").alias("_label"), origin_or("_origin").alias("_origin")).distinct()
    return points.join(wanted, (stripped("label") == F.col("_label")) & (origin_or("origin_csv") == F.col("_origin")), "left_semi")


def group_volumes(points: DataFrame, size: float, shape: tuple[int, int, int] | None = None) -> DataFrame:
    """Points per label, origin and voxel (round half even, axes z, y, x)."""
    rows = binned(points, size, "round", shape, reverse=True)
    return rows.groupBy(stripped("label").alias("label"), origin_or("origin_csv").alias("origin"), "i", "j", "k").agg(F.count(F.lit(1)).alias("n"))


def atlas_check(points: DataFrame, regions: DataFrame, midline: float, column: str = "z") -> DataFrame:
    """Points whose given id, acronym, name or hemisphere does not fit the atlas.

    Values are compared stripped, names by their key, sides in lower case;
    what is not given is not compared. Exactly 1 µm off the midline is still
    midline here. Output: the point's columns and ``mismatches``.
    """
    dim = regions.select(F.col("region_id").alias("_id"), F.col("acronym").alias("_acronym"), F.col("region_name").alias("_name"))
    joined = points.join(dim, F.col("id") == F.col("_id"), "left")
    c = F.col(column)
    side = F.when(c < midline - 1, "left").when(c > midline + 1, "right").when(c.isNotNull(), "midline")
    given = lambda x: F.coalesce(stripped(x) != "", F.lit(False))
    differs = lambda a, b: given(a) & ~F.coalesce(b, F.lit(False))
    checks = {
        "id": F.col("id").isNotNull() & F.col("_id").isNull(),
        "acronym": differs("acronym", stripped("acronym") == stripped("_acronym")),
        "region_name": differs("region_name", region_key("region_name") == region_key("_name")),
        "hemisphere": differs("hemisphere", F.lower(stripped("hemisphere")) == side),
    }
    marks = F.concat_ws(",", *[F.when(wrong, F.lit(name)) for name, wrong in checks.items()])
    return joined.withColumn("mismatches", marks).where("mismatches <> ''").select(*points.columns, "mismatches")


def mismatch_counts(checked: DataFrame) -> DataFrame:
    """Mismatches per field."""
    return checked.select(F.explode(F.split("mismatches", ",")).alias("field")).groupBy("field").agg(F.count(F.lit(1)).alias("n_points"))


def appended(points: DataFrame, more: DataFrame) -> DataFrame:
    """Union of two point tables of the same columns, types and order; a table without provenance gets the placeholder."""
    if "origin_csv" not in points.columns and "origin_csv" in more.columns:
        points = points.withColumn("origin_csv", origin_or(F.lit(None).cast("string")))
    if points.dtypes != more.dtypes:
        raise ValueError(f"schemas differ: {points.dtypes} and {more.dtypes}")
    return points.unionByName(more)


def checked_at_place(points: DataFrame, annotation: DataFrame, regions: DataFrame, midline: float, size: float, column: str = "z") -> DataFrame:
    """What each point says of its region against the region of its voxel (round half even, axes z, y, x).

    A point outside the annotation or of an unknown region has id 0 and empty
    names. Rules of comparison as in ``atlas_check``. Output: the point's
    columns, place_id, place_acronym, place_name, place_side and ``mismatches``
    (null if nothing differs).
    """
    ok = finite("x", "y", "z")
    at = points.withColumns({f"_{n}": F.when(ok, voxel(c, size, "round")) for n, c in zip("ijk", "zyx")})
    a = annotation.select(*[F.col(n).alias(f"a{n}") for n in "ijk"], F.col("region_id").alias("place_id"))
    at = at.join(a, (F.col("_i") == F.col("ai")) & (F.col("_j") == F.col("aj")) & (F.col("_k") == F.col("ak")), "left").withColumn("place_id", F.coalesce("place_id", F.lit(0)))
    dim = regions.select(F.col("region_id").alias("_id"), F.col("acronym").alias("place_acronym"), F.col("region_name").alias("place_name"))
    c = F.col(column)
    side = F.when(c < midline - 1, "left").when(c > midline + 1, "right").when(c.isNotNull(), "midline")
    at = at.join(dim, F.col("place_id") == F.col("_id"), "left").withColumns({"place_acronym": F.coalesce("place_acronym", F.lit("")), "place_name": F.coalesce("place_name", F.lit("")), "place_side": side})
    given = lambda x: F.coalesce(stripped(x) != "", F.lit(False))
    checks = {
        "id": F.col("id").isNotNull() & (F.col("id") != F.col("place_id")),
        "acronym": given("acronym") & (stripped("acronym") != stripped("place_acronym")),
        "region_name": given("region_name") & (region_key("region_name") != region_key("place_name")),
        "hemisphere": given("hemisphere") & ~F.coalesce(F.lower(stripped("hemisphere")) == side, F.lit(False)),
    }
    marks = F.nullif(F.concat_ws(",", *[F.when(wrong, F.lit(name)) for name, wrong in checks.items()]), F.lit(""))
    return at.select(*points.columns, "place_id", "place_acronym", "place_name", "place_side", marks.alias("mismatches"))
