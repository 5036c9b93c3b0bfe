"""Schemas that drift between exports: lifespans of columns, changes, one consistent table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arborlake.runtime import written

#: Spellings of a field, reduced to lower-case letters and digits, and the column they go to.
ALIASES = {
    "xflat": "x_flat", "flatx": "x_flat", "yflat": "y_flat", "flaty": "y_flat",
    "xflatshaped": "x_flat_shaped", "yflatshaped": "y_flat_shaped",
    "clusterid": "cluster_id", "clusterassignment": "cluster_assignment",
    "clusterkmeans1": "cluster_assignment", "clusterward1": "cluster_assignment",
    "depthum": "depth_um", "neurongroup": "neuron_group", "group": "neuron_group", "neuronlabel": "neuron_label",
    "flatmapvalid": "flatmap_valid", "flatmapshapedvalid": "flatmap_shaped_valid",
}
#: Type of each column of the consistent table.
TARGETS = {
    "x_flat": "double", "y_flat": "double", "x_flat_shaped": "double", "y_flat_shaped": "double",
    "cluster_id": "int", "cluster_assignment": "int", "depth_um": "double",
    "neuron_group": "string", "neuron_label": "string", "flatmap_valid": "boolean", "flatmap_shaped_valid": "boolean",
}
KEYS = ("file_id", "node_id", "type", "x")


def export_fields(lines: DataFrame) -> DataFrame:
    """One row per line and field: its JSON kind and its value as text.

    Each line is parsed once, to variants by name. Lines that are no JSON
    object have no fields. Numbers of one kind and value have one text,
    however they are written (1.50 and 1.5, but not 1). Output: stream,
    export_id, exported_at, file_id, node_id, field, kind (boolean, integer,
    decimal, text; null for a JSON null), value.
    """
    parsed = lines.where(F.endswith(F.rtrim("payload"), F.lit("}"))).select("stream", "export_id", "exported_at", F.from_json("payload", "map<string,variant>").alias("fields"), F.when(F.col("payload").rlike("[0-9]{19}"), F.col("payload")).alias("long_numbers"))
    own = lambda name, kind: F.expr(f"try_variant_get(fields['{name}'], '$', '{kind}')").alias(name)
    pairs = parsed.select("stream", "export_id", "exported_at", own("file_id", "string"), own("node_id", "bigint"), "long_numbers", F.explode("fields").alias("field", "variant"))
    shape, text = F.schema_of_variant("variant"), F.expr("try_variant_get(variant, '$', 'string')")
    pairs = pairs.select("stream", "export_id", "exported_at", "file_id", "node_id", "field", shape.alias("shape"), text.alias("text"), "long_numbers")
    # A variant keeps 18.0 as a decimal without places. Integers are decimals only beyond 18 digits; there the text of the line tells.
    shape = F.col("shape")
    point_less = F.startswith(shape, F.lit("DECIMAL")) & F.endswith(shape, F.lit(",0)"))
    written_whole = F.rlike("long_numbers", F.concat(F.lit('"\\Q'), F.col("field"), F.lit('\\E"\\s*:\\s*'), F.col("text"), F.lit("\\s*[,}]")))
    is_whole = F.when(point_less & F.col("long_numbers").isNotNull(), written_whole).otherwise(False)
    decimal = F.startswith(shape, F.lit("DECIMAL")) | shape.isin("DOUBLE", "FLOAT")
    kind = F.when(shape == "BIGINT", "integer").when(shape == "VOID", None).when(shape == "BOOLEAN", "boolean").when(decimal, F.when(is_whole, "integer").otherwise("decimal")).otherwise("text")
    value = F.when(point_less, F.when(is_whole, F.col("text")).otherwise(F.concat("text", F.lit(".0")))).otherwise(F.col("text"))
    return pairs.select("stream", "export_id", "exported_at", "file_id", "node_id", "field", kind.alias("kind"), F.when(F.col("shape") != "VOID", value).alias("value"))


def _numbered_exports(lines: DataFrame) -> DataFrame:
    """Exports of each stream in order of time. One row an export, so the window is small."""
    exports = lines.groupBy("stream", "export_id").agg(F.min("exported_at").alias("exported_at"))
    by = Window.partitionBy("stream").orderBy("exported_at", "export_id")
    return exports.select("stream", "export_id", F.col("exported_at").alias("at"), F.row_number().over(by).alias("seq"))


def _catalogue(fields: DataFrame, exports: DataFrame) -> DataFrame:
    seen = fields.groupBy("stream", "export_id", "field").agg(
        F.count("value").alias("n_values"), F.count_if(F.col("value").isNull()).alias("n_nulls"),
        *[F.max(F.coalesce(F.col("kind") == k, F.lit(False))).alias(k) for k in ("boolean", "integer", "decimal", "text")],
    )
    mixed = F.col("boolean") & (F.col("integer") | F.col("decimal"))
    kind = F.when(F.col("text") | mixed, "text").when(F.col("boolean"), "boolean").when(F.col("decimal"), "decimal").when(F.col("integer"), "integer")
    return seen.join(exports, ["stream", "export_id"]).select("stream", "export_id", "at", "seq", "field", kind.alias("type"), "n_values", "n_nulls")


def column_catalogue(lines: DataFrame) -> DataFrame:
    """Which fields each export has, with the type of their non-null values.

    Mixed integers and decimals are decimal, any other mix is text; a field
    with nulls only has no type. Counts are combined before the shuffle.
    Output: stream, export_id, at, seq, field, type, n_values, n_nulls.
    """
    return _catalogue(export_fields(lines), _numbered_exports(lines))


def _islands(catalogue: DataFrame) -> DataFrame:
    """Islands of consecutive exports per stream, field and type. One row an export and field, so windows are small."""
    by = Window.partitionBy("stream", "field").orderBy("seq")
    goes_on = (F.lag("seq").over(by) == F.col("seq") - 1) & F.lag("type").over(by).eqNullSafe(F.col("type"))
    numbered = catalogue.withColumn("island", F.sum(F.when(goes_on, 0).otherwise(1)).over(by))
    return numbered.groupBy("stream", "field", "island", "type").agg(
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.min_by("export_id", "seq").alias("first_export"), F.max_by("export_id", "seq").alias("last_export"), F.count(F.lit(1)).alias("n_exports")
    ).drop("island")


def column_lifespans(lines: DataFrame) -> DataFrame:
    """Islands of consecutive exports with a field of one type, per stream.

    A field whose values are all null in an export keeps the type it had.
    Output: stream, field, type, first_seq, last_seq, first_export, last_export, n_exports.
    """
    upto = Window.partitionBy("stream", "field").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return _islands(column_catalogue(lines).withColumn("type", F.coalesce(F.col("type"), F.last("type", ignorenulls=True).over(upto))))


def column_casts(lines: DataFrame, aliases: dict[str, str] | None = None, targets: dict[str, str] | None = None) -> DataFrame:
    """The cast of every observed field and type into the consistent table, generated from the alias table.

    Fields without an alias have none. Output: field, type (null: nulls only),
    n_exports, column_name, column_type, cast_sql.
    """
    targets = targets or TARGETS
    seen = column_catalogue(lines).groupBy("field", "type").agg(F.count(F.lit(1)).alias("n_exports")).withColumn("column_name", target_column(aliases))
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in targets.items() for x in pair]), F.col("column_name"))
    name = F.concat(F.lit("`"), F.regexp_replace("field", "`", "``"), F.lit("`"))
    return seen.withColumn("column_type", kind).withColumn("cast_sql", F.concat(F.lit("try_cast("), name, F.lit(" AS "), F.col("column_type"), F.lit(") AS "), F.col("column_name")))


def _edges(catalogue: DataFrame, exports: DataFrame) -> DataFrame:
    """Starts and endings of the islands, and type changes between them, at the export where each shows."""
    by = Window.partitionBy("stream", "field").orderBy("first_seq")
    c = _islands(catalogue).select(
        "stream", "field", "type", "first_seq", "last_seq",
        F.lag("last_seq").over(by).alias("before"), F.lag("type").over(by).alias("type_before"), F.lead("first_seq").over(by).alias("after"),
    )
    follows = F.coalesce(F.col("before") == F.col("first_seq") - 1, F.lit(False))
    starts = (F.col("first_seq") > 1) & ~follows
    ends = F.coalesce(F.col("after") > F.col("last_seq") + 1, F.lit(True))
    retyped = follows & (F.col("type") != F.col("type_before"))
    event = lambda when, name, at: F.when(when, F.struct(F.lit(name).alias("change"), at.alias("seq")))
    events = F.array(event(starts, "added", F.col("first_seq")), event(ends, "removed", F.col("last_seq") + 1), event(retyped, "retyped", F.col("first_seq")))
    flat = c.select("stream", "field", F.explode(F.filter(events, lambda e: e.isNotNull())).alias("e")).select("stream", "field", "e.change", "e.seq")
    return flat.join(exports, ["stream", "seq"])  # an ending after the last export meets none


def schema_changes(lines: DataFrame) -> DataFrame:
    """Every change of each export against the one before it in its stream.

    A name that is gone and one that is new are one renamed field when, for
    the nodes in both exports, they hold the same values: equal counts and
    equal sums of two 64-bit hashes of (node, value), compared without
    listing pairs of values. A field without any value there is not matched.
    Where several names hold the same values, they are paired in order of
    name. Repeated and late lines count once. Nulls in node keys are values
    like any other; lines without a stream or export, and lines that are no
    JSON object, are left out. Output: stream, export_id, at, change, field,
    new_field.

    Lines are parsed once; fields, catalogue and edges are written to the
    shared folder, so that each following step has a short plan.
    """
    lines = lines.where(F.col("stream").isNotNull() & F.col("export_id").isNotNull())
    exports = written(_numbered_exports(lines).coalesce(1))  # one row an export
    fields = written(export_fields(lines).join(exports.select(F.col("stream").alias("_s"), F.col("export_id").alias("_e"), "seq"), (F.col("stream") == F.col("_s")) & (F.col("export_id") == F.col("_e"))).drop("_s", "_e", "exported_at"))
    edges = written(_edges(_catalogue(fields, exports), exports))
    moves = edges.where("change in ('added', 'removed')")
    both = moves.groupBy("stream", "seq").agg(F.count_if(F.col("change") == "added").alias("a"), F.count_if(F.col("change") == "removed").alias("r")).where("a > 0 and r > 0").select("stream", "seq")
    wanted = moves.join(both, ["stream", "seq"], "left_semi").select("stream", F.col("seq").alias("boundary"), "field", "change", (F.col("seq") - F.when(F.col("change") == "removed", 1).otherwise(0)).alias("seq"))
    values = fields.where("value is not null").select("stream", "seq", "file_id", "node_id", "field", "value")
    # Exports of each node, so that it shows whether the one before or after has it too.
    near = Window.partitionBy("stream", "file_id", "node_id").orderBy("seq")
    nodes = fields.select("stream", "seq", "file_id", "node_id").distinct()
    nodes = nodes.select("*", (F.lag("seq").over(near) == F.col("seq") - 1).alias("was"), (F.lead("seq").over(near) == F.col("seq") + 1).alias("stays"))
    asked = values.join(wanted, ["stream", "seq", "field"]).distinct()
    in_both = F.when(F.col("change") == "removed", F.col("stays")).otherwise(F.col("was"))
    kept = asked.join(nodes.withColumnsRenamed({c: f"n_{c}" for c in ("stream", "seq", "file_id", "node_id")}), _same(asked, ("stream", "seq", "file_id", "node_id"))).where(in_both)
    h = lambda salt: F.xxhash64(F.lit(salt), "file_id", "node_id", "value")
    sums = kept.groupBy("stream", "boundary", "field", "change").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(name) for name, c in (
            ("h1", F.shiftright(h(1), 32)), ("h2", h(1).bitwiseAND(0xFFFFFFFF)), ("h3", F.shiftright(h(2), 32)), ("h4", h(2).bitwiseAND(0xFFFFFFFF)))],
    )
    alike = ("stream", "boundary", "n", "h1", "h2", "h3", "h4")
    sums = written(sums.withColumn("k", F.row_number().over(Window.partitionBy(*alike, "change").orderBy("field"))))
    gone = sums.where("change = 'removed'").select(*alike, "k", "field")
    new = sums.where("change = 'added'").select(*alike, "k", F.col("field").alias("new_field"))
    renamed = written(gone.join(new, [*alike, "k"]).select("stream", F.col("boundary").alias("seq"), "field", "new_field"))
    out_names = renamed.select("stream", "seq", F.lit("removed").alias("change"), "field").unionByName(renamed.select("stream", "seq", F.lit("added").alias("change"), F.col("new_field").alias("field")))
    plain = edges.join(out_names, ["stream", "seq", "change", "field"], "left_anti").select("stream", "seq", "change", "field", F.lit("").alias("new_field"))
    changes = plain.unionByName(renamed.select("stream", "seq", F.lit("renamed").alias("change"), "field", "new_field"))
    return changes.join(exports, ["stream", "seq"]).select("stream", "export_id", "at", "change", "field", "new_field")


def _same(left: DataFrame, names: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for c in names:
        out = out & left[c].eqNullSafe(F.col(f"n_{c}"))
    return out


def target_column(aliases: dict[str, str] | None = None) -> Column:
    """Column of the consistent table that a field goes to, by the alias table; null if none."""
    reduced = F.lower(F.regexp_replace("field", "[^A-Za-z0-9]", ""))
    table = F.create_map(*[F.lit(x) for pair in (aliases or ALIASES).items() for x in pair])
    return F.element_at(table, reduced)


def _typed(kind: str) -> Column:
    """Value in a type of the consistent table, null if it does not fit; whole decimals are integers (18.0 is 18)."""
    cast = F.expr(f"try_cast(value as {kind})")
    if kind != "int":
        return cast
    whole = F.expr("try_cast(value as double) = rint(try_cast(value as double))")
    return F.coalesce(cast, F.when(whole, F.expr("try_cast(try_cast(value as double) as int)")))


def consistent_nodes(lines: DataFrame, aliases: dict[str, str] | None = None, targets: dict[str, str] | None = None) -> DataFrame:
    """One table of all exports: each node once, each field under one name and type.

    Names go through the alias table, values through its casts; of several
    exports the latest non-null value stands. A value that does not fit its
    type is null; integers may come in decimal form. Output: file_id, node_id, type, x and the target columns,
    last_export (time of the latest export with the node).
    """
    kinds = {"type": "int", "x": "double"} | (targets or TARGETS)
    fields = export_fields(lines).where("file_id is not null and node_id is not null")
    fields = fields.withColumn("target", F.when(F.col("field").isin("type", "x"), F.col("field")).otherwise(target_column(aliases)))
    fits = F.lit(False)
    for kind in sorted(set(kinds.values())):
        fits = F.when(F.col("target").isin([c for c, k in kinds.items() if k == kind]), _typed(kind).isNotNull()).otherwise(fits)
    # The latest value that fits, per node and column; only that one is cast.
    when = F.struct("exported_at", "export_id", "value")
    latest = fields.groupBy("file_id", "node_id", "target").agg(F.max_by("value", F.when(fits, when)).alias("value"), F.max("exported_at").alias("at"))
    pick = lambda c, k: F.max(F.when(F.col("target") == c, _typed(k))).alias(c)
    return latest.groupBy("file_id", "node_id").agg(*[pick(c, k) for c, k in kinds.items()], F.max("at").alias("last_export"))
