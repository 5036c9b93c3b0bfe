"""Filters, joins and aggregates on the node table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arborlake.functions.columns import finite, hemisphere

SOMA = 1
#: Longest id list that is put into the plan as literals; longer ones become a semi-join, with the same rows.
INLINE = 1000


def member(df: DataFrame, column: str, values: list | None) -> DataFrame:
    """Rows whose column is in the list. None restricts nothing, an empty list keeps nothing."""
    if values is None:
        return df
    if len(values) <= INLINE:
        return df.where(F.col(column).isin(list(values)) if values else F.lit(False))
    wanted = df.sparkSession.createDataFrame([(v,) for v in dict.fromkeys(values)], f"_wanted {dict(df.dtypes)[column]}")
    return df.join(wanted, F.col(column) == F.col("_wanted"), "left_semi")


def without(df: DataFrame, column: str, values: list | None) -> DataFrame:
    """Rows whose column is not in the list; an empty list or None excludes nothing. Null is in no list."""
    if not values:
        return df
    wanted = df.sparkSession.createDataFrame([(v,) for v in dict.fromkeys(values)], f"_wanted {dict(df.dtypes)[column]}")
    return df.join(wanted, F.col(column) == F.col("_wanted"), "left_anti")


def node_types(values: list[int] | None, soma_only: bool = False) -> list[int] | None:
    """Sorted unique node types; explicit types win over ``soma_only``."""
    if values is not None:
        return sorted({int(v) for v in values})
    return [SOMA] if soma_only else None


def neurons_touching(nodes: DataFrame, regions: list, by: str = "region_acronym", types: list[int] | None = None, soma_only: bool = False, files: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Distinct (file_id, neuron_id, subject) with a node in the regions. Descendants are not added."""
    kept = without(member(member(member(nodes, by, regions), "type", node_types(types, soma_only)), "file_id", files), "file_id", exclude)
    return kept.select("file_id", "neuron_id", "subject").distinct()


def file_rows(nodes: DataFrame, files: list[str] | None) -> DataFrame:
    """All columns of the files' nodes, ordered by file and node."""
    return member(nodes, "file_id", files).orderBy("file_id", "node_id")


def soma_rows(nodes: DataFrame, files: list[str] | None = None) -> DataFrame:
    return member(nodes.where(F.col("type") == SOMA), "file_id", files)


def region_counts(nodes: DataFrame) -> DataFrame:
    """Annotated regions with their nodes, most first."""
    return nodes.where("region_id > 0").groupBy("region_id").agg(F.max("region_name").alias("region_name"), F.max("region_acronym").alias("region_acronym"), F.count(F.lit(1)).alias("n_nodes")).orderBy(F.desc("n_nodes"), "region_id")


def neurons_per_region(nodes: DataFrame) -> DataFrame:
    return nodes.where("region_acronym <> ''").groupBy("region_acronym").agg(F.countDistinct("file_id").alias("n_neurons"))


def soma_locations(nodes: DataFrame) -> DataFrame:
    """Mean soma coordinates per file and neuron; nodes without coordinates are left out."""
    return nodes.where((F.col("type") == SOMA) & finite("x", "y", "z")).groupBy("file_id", "neuron_id").agg(*[F.avg(c).alias(c) for c in "xyz"], F.max("region_acronym").alias("region_acronym"))


def statistics(nodes: DataFrame) -> DataFrame:
    """Nodes, files, subjects and annotated regions; counts are exact."""
    return nodes.agg(F.count(F.lit(1)).alias("n_nodes"), F.countDistinct("file_id").alias("n_files"), F.countDistinct("subject").alias("n_subjects"), F.countDistinct(F.when(F.col("region_acronym") != "", F.col("region_acronym"))).alias("n_regions"))


def hemisphere_summary(nodes: DataFrame, midline: float, column: str = "z", tolerance: float = 1.0) -> DataFrame:
    """Somas by side of the midline, with least, mean and greatest coordinate."""
    somas = nodes.where((F.col("type") == SOMA) & finite(column)).withColumn("side", hemisphere(column, midline, tolerance))
    n = lambda s: F.count_if(F.col("side") == s)
    return somas.agg(F.count(F.lit(1)).alias("n_somas"), F.countDistinct("file_id").alias("n_neurons"), n("left").alias("n_left"), n("midline").alias("n_midline"), n("right").alias("n_right"), F.min(column).alias("least"), F.avg(column).alias("mean"), F.max(column).alias("greatest"))


def soma_sides(nodes: DataFrame, midline: float, column: str = "z", tolerance: float = 1.0) -> DataFrame:
    """Side of each file's mean soma; files without a soma have a null side (a failure in batch conversion)."""
    mean = nodes.groupBy("file_id").agg(F.avg(F.when((F.col("type") == SOMA) & finite(column), F.col(column))).alias("soma"))
    return mean.select("file_id", "soma", hemisphere("soma", midline, tolerance).alias("side"))


def flipped(nodes: DataFrame, target: str, midline: float, column: str = "z", tolerance: float = 1.0) -> DataFrame:
    """Files whose soma lies on the other side are mirrored at the midline; midline and soma-less ones stay."""
    if target not in ("left", "right"):
        raise ValueError("the target is left or right")
    sides = soma_sides(nodes, midline, column, tolerance).select(F.col("file_id").alias("_f"), "side")
    turn = F.col("side").isin("left", "right") & (F.col("side") != target)
    joined = nodes.join(sides, nodes["file_id"].eqNullSafe(F.col("_f")), "left")
    return joined.withColumn(column, F.when(turn, 2 * F.lit(float(midline)) - F.col(column)).otherwise(F.col(column))).select(*nodes.columns)


def largest_neurons(nodes: DataFrame, k: int) -> DataFrame:
    """The k files with most nodes, ties by name."""
    return nodes.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_nodes")).orderBy(F.desc("n_nodes"), "file_id").limit(k)


def soma_distance_filter(nodes: DataFrame, radius: float | None) -> DataFrame:
    """Nodes within the radius of their file's mean soma. None or a radius of 0 or less keeps all; with one, files without a soma vanish."""
    if radius is None or radius <= 0:
        return nodes
    somas = nodes.where((F.col("type") == SOMA) & finite("x", "y", "z")).groupBy(F.col("file_id").alias("_f")).agg(*[F.avg(c).alias(f"_{c}") for c in "xyz"])
    away = F.sqrt(sum(((F.col(c) - F.col(f"_{c}")) * (F.col(c) - F.col(f"_{c}")) for c in "xyz"), F.lit(0.0)))
    return nodes.join(somas, nodes["file_id"] == F.col("_f")).where(finite("x", "y", "z") & (away <= radius)).select(*nodes.columns)


def in_order(nodes: DataFrame, block_ids: int = 1 << 16) -> DataFrame:
    """Index of each node in its neuron by node_id, from 0.

    Nodes are numbered within blocks of ids, from where the block begins; so
    one window holds a block of ids, and only one row a block is summed up per
    file, however long the file is.
    """
    rows = nodes.select("file_id", "node_id", F.floor(F.col("node_id") / block_ids).alias("block"))
    counts = rows.groupBy("file_id", "block").agg(F.count(F.lit(1)).alias("n"))
    starts = counts.select(F.col("file_id").alias("_f"), F.col("block").alias("_b"), (F.sum("n").over(Window.partitionBy("file_id").orderBy("block")) - F.col("n")).alias("before"))
    number = F.col("before") + F.row_number().over(Window.partitionBy("file_id", "block").orderBy("node_id")) - 1
    joined = rows.join(starts, F.col("file_id").eqNullSafe(F.col("_f")) & F.col("block").eqNullSafe(F.col("_b")))
    return joined.select("file_id", "node_id", number.alias("vertex"))


def neuron_summary(nodes: DataFrame) -> DataFrame:
    """One row a neuron: mean soma, its region, subject and nodes."""
    soma = lambda c: F.when((F.col("type") == SOMA) & finite("x", "y", "z"), F.col(c))
    return nodes.groupBy("file_id").agg(F.max("neuron_id").alias("neuron_id"), F.max("subject").alias("subject"), *[F.avg(soma(c)).alias(f"soma_{c}") for c in "xyz"], F.max(soma("region_acronym")).alias("soma_region"), F.count(F.lit(1)).alias("n_nodes"))


def centre(nodes: DataFrame) -> DataFrame:
    """Mean coordinates: of somas if there are any, else of all nodes."""
    ok = finite("x", "y", "z")
    pick = lambda c: F.coalesce(F.avg(F.when(ok & (F.col("type") == SOMA), F.col(c))), F.avg(F.when(ok, F.col(c)))).alias(c)
    return nodes.agg(*[pick(c) for c in "xyz"])


def parse_file_names(names: Column) -> tuple[Column, Column]:
    """(subject, neuron_id) from a file name; the stem for both where no pattern fits."""
    # The two patterns are naming conventions of the data.
    stem = F.regexp_replace(F.regexp_replace(names, r"^.*/", ""), r"(?i)\.swc$", "")
    number, person = F.regexp_extract(stem, r"^(\d+)_(\d+)_", 1), F.regexp_extract(stem, r"^(\d+)_(\d+)_", 2)
    dotted, cell = F.regexp_extract(stem, r"^(H\d+(\.\d+){6})_(\d+)", 1), F.regexp_extract(stem, r"^(H\d+(\.\d+){6})_(\d+)", 3)
    subject = F.when(person != "", person).when(dotted != "", dotted).otherwise(stem)
    neuron = F.when(number != "", number).when(cell != "", cell).otherwise(stem)
    return subject, neuron
