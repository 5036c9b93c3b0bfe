"""SWC text: discovery, parsing, node table, conversion, append and writing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.operators.nodes import flipped, parse_file_names, soma_sides
from arborlake.operators.regions import with_names
from arborlake.operators.voxels import annotate
from arborlake.runtime import is_number
from arborlake.sources import store

#: Columns of the node table.
NODE_COLUMNS = ("file_id", "node_id", "type", "x", "y", "z", "radius", "parent_id", "region_id", "region_name", "region_acronym", "subject", "neuron_id")


def discover(spark: SparkSession, folder: str, recursive: bool = False) -> list[str]:
    """SWC files of a folder, any case of the suffix, sorted."""
    return store.files_below(spark, folder, ".swc", recursive)


def chosen(spark: SparkSession, paths: list[str]) -> list[str]:
    """SWC files of a list, each real path once, sorted."""
    return sorted({store.real_path(spark, p): p for p in paths if p.lower().endswith(".swc")}.values())


def read_swc(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes of SWC files, and the files that failed with the reason.

    Comments and blank lines are skipped, inline comments cut, lines of fewer
    than seven fields ignored; more fields are allowed. Ids may be written as
    decimals. A file with a field that is no number, or without any node,
    fails as a whole. Files are split and read by lines in parallel.
    """
    if not paths:
        raise FileNotFoundError("no SWC files")
    lines = spark.read.text(paths).select(F.regexp_extract(F.input_file_name(), "([^/]+)$", 1).alias("file_id"), "value")
    lines = lines.withColumn("file_id", F.url_decode("file_id"))
    names = spark.createDataFrame([(p.rsplit("/", 1)[-1],) for p in paths], "file_id string").distinct()
    return parsed(lines, names)


def parsed(lines: DataFrame, names: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes of SWC lines (file_id, value), and the files that failed, by the rules of ``read_swc``.

    ``names`` (file_id) are the files that should be there; without it, those of the lines.
    """
    names = lines.select("file_id").distinct() if names is None else names
    parts = F.split(F.trim(F.regexp_replace(F.regexp_replace("value", "#.*$", ""), r"\s+", " ")), " ")
    rows = lines.select("file_id", parts.alias("p")).where(F.size("p") >= 7)
    number = lambda i: F.expr(f"try_cast(p[{i}] as double)")
    rows = rows.select("file_id", *[number(i).alias(f"v{i}") for i in range(7)])
    bad_row = F.lit(False)
    for i in range(7):
        bad_row = bad_row | F.col(f"v{i}").isNull()
    bad = rows.groupBy("file_id").agg(F.count_if(bad_row).alias("n_bad"))
    failed = names.join(bad, "file_id", "left").where("n_bad is null or n_bad > 0").select("file_id", F.when(F.col("n_bad").isNull(), "no nodes").otherwise("a field that is no number").alias("reason"))
    good = rows.join(bad.where("n_bad = 0").select("file_id"), "file_id", "left_semi")
    whole = lambda i, n: F.col(f"v{i}").cast("int").alias(n)
    return good.select("file_id", whole(0, "node_id"), whole(1, "type"), *[F.col(f"v{i}").alias(n) for i, n in ((2, "x"), (3, "y"), (4, "z"), (5, "radius"))], whole(6, "parent_id")), failed


def node_table(nodes: DataFrame, annotation: DataFrame | None, regions: DataFrame | None, size: float) -> DataFrame:
    """The 13 columns: parsed nodes, region by voxel, names by region, subject and neuron by file name."""
    subject, neuron = parse_file_names(F.col("file_id"))
    out = nodes.withColumns({"subject": subject, "neuron_id": neuron})
    out = annotate(out, annotation, size) if annotation is not None else out.withColumn("region_id", F.lit(0))
    out = with_names(out, regions) if regions is not None else out.withColumns({"region_name": F.lit(""), "region_acronym": F.lit("")})
    return out.select(*NODE_COLUMNS)


def convert(spark: SparkSession, paths: list[str], out: str, hemisphere: str | None = None, midline: float = 5695.0, annotation: DataFrame | None = None, regions: DataFrame | None = None, size: float = 25.0) -> dict:
    """Batch conversion to Parquet. Sides are settled before regions are looked up.

    With a hemisphere, files whose soma lies on the other side are mirrored;
    files without a soma fail. Returns counts and the failures.
    """
    nodes, failed = read_swc(spark, paths)
    failures = {r["file_id"]: r["reason"] for r in failed.collect()}
    counts = {"flipped": 0, "already": 0, "midline": 0}
    if hemisphere:
        sides = soma_sides(nodes, midline).select("file_id", "side")
        for r in sides.groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.collect_list(F.when(F.col("side").isNull(), F.col("file_id"))).alias("f")).collect():
            failures |= {f: "no soma" for f in r["f"]}
            if r["side"]:
                counts["midline" if r["side"] == "midline" else "already" if r["side"] == hemisphere else "flipped"] += r["n"]
        nodes = flipped(nodes.join(sides.where("side is not null").select("file_id"), "file_id", "left_semi"), hemisphere, midline)
    # Files lie together and in order, whatever tasks read them.
    ordered = node_table(nodes, annotation, regions, size).repartitionByRange("file_id", "node_id").sortWithinPartitions("file_id", "node_id")
    ordered.write.option("compression", "snappy").mode("overwrite").parquet(out)
    done = spark.read.parquet(out).agg(F.count(F.lit(1)), F.countDistinct("file_id")).first()
    return {"discovered": len(paths), "processed": done[1], "failed": len(failures), "rows": done[0], "failures": failures, **counts}


def new_files(nodes: DataFrame, existing: DataFrame) -> DataFrame:
    """Nodes of files that the table does not have yet."""
    return nodes.join(existing.select("file_id").distinct(), "file_id", "left_anti")


def append(spark: SparkSession, paths: list[str], table: str, **kw) -> int:
    """Append files that are not in the table yet; returns how many files were new."""
    there = spark.read.parquet(table)
    known = {r[0] for r in there.join(spark.createDataFrame([(p.rsplit("/", 1)[-1],) for p in paths], "file_id string"), "file_id", "left_semi").select("file_id").distinct().collect()}
    new = [p for p in paths if p.rsplit("/", 1)[-1] not in known]
    if new:
        nodes, _ = read_swc(spark, new)
        node_table(nodes, kw.get("annotation"), kw.get("regions"), kw.get("size", 25.0)).write.mode("append").parquet(table)
    return len(new)


def swc_lines(nodes: DataFrame) -> DataFrame:
    """SWC text lines of nodes, three decimals. A missing value is written as nan, so that no child loses its parent; a null type is 0, a null parent -1."""
    number = lambda c: F.when(is_number(c), F.format_string("%.3f", c)).otherwise("nan")
    whole = lambda c, none: F.coalesce(F.col(c), F.lit(none)).cast("string")
    f = F.concat_ws(" ", F.col("node_id").cast("string"), whole("type", 0), *[number(c) for c in ("x", "y", "z", "radius")], whole("parent_id", -1))
    return nodes.select("file_id", "node_id", f.alias("value"))


def write_swc(nodes: DataFrame, folder: str, rows_per_part: int = 1_000_000) -> None:
    """A folder of text per file, nodes in order.

    Nodes are divided by ranges of file and node, so that a file of many rows
    is written by several tasks; its parts follow each other by name.
    """
    lines = swc_lines(nodes)
    parts = max(1, -(-lines.count() // rows_per_part))
    lines.repartitionByRange(parts, "file_id", "node_id").sortWithinPartitions("file_id", "node_id").select("file_id", "value").write.partitionBy("file_id").mode("overwrite").text(folder)
