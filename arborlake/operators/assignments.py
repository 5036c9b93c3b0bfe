"""Cluster assignments and annotations per neuron, and their way onto nodes."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest_state(state: DataFrame, order: str, keep: str = "first") -> DataFrame:
    """One entry per file_id: the first by ``order``, or the last."""
    by = F.asc(order) if keep == "first" else F.desc(order)
    return state.withColumn("_k", F.row_number().over(Window.partitionBy("file_id").orderBy(by))).where("_k = 1").drop("_k")


def assignment_column(name: str, taken: set[str] = frozenset()) -> str:
    """Column of an assignment set, free of collisions."""
    base = "cluster_" + (re.sub(r"[^0-9a-z]+", "_", name.lower()).strip("_") or "set")
    out, n = base, 2
    while out in taken:
        out, n = f"{base}_{n}", n + 1
    return out


def onto_nodes(nodes: DataFrame, per_file: DataFrame, columns: list[str]) -> DataFrame:
    """Per-file columns broadcast onto the nodes; columns of the same name are replaced, files without an entry get null."""
    keep = [c for c in nodes.columns if c not in columns]
    return nodes.select(*keep).join(per_file.select(F.col("file_id").alias("_f"), *columns), F.col("file_id") == F.col("_f"), "left").drop("_f")


def recovered(nodes: DataFrame, columns: list[str]) -> DataFrame:
    """Per-file columns back from nodes, by their greatest value."""
    return nodes.groupBy("file_id").agg(*[F.max(c).alias(c) for c in columns])


def members(assignment: DataFrame, label: int) -> DataFrame:
    """Files of a cluster, in order of name."""
    return assignment.where(F.col("label") == label).select("file_id").orderBy("file_id")


def restricted(assignment: DataFrame, cohort: DataFrame) -> DataFrame:
    """Assignments of a cohort; files without a label are left out."""
    return assignment.where("label is not null").join(cohort.select("file_id").distinct(), "file_id", "left_semi")


def active_map(files: DataFrame, assignment: DataFrame) -> DataFrame:
    """Label of every file, null where it has none."""
    return files.select("file_id").distinct().join(assignment.select("file_id", "label"), "file_id", "left")


def filtered(table: DataFrame, labels: list[int], unclustered: bool) -> DataFrame:
    """Rows of the clusters and, on request, of none; an empty choice keeps all."""
    if not labels and not unclustered:
        return table
    hit = F.coalesce(F.col("label").isin(labels), F.lit(False)) if labels else F.lit(False)
    return table.where(hit | F.col("label").isNull() if unclustered else hit)


def cluster_counts(table: DataFrame) -> DataFrame:
    """Neurons per cluster, unclustered last."""
    return table.groupBy("label").agg(F.count(F.lit(1)).alias("n_neurons")).orderBy(F.asc_nulls_last("label"))


def selected_rows(nodes: DataFrame, chosen: DataFrame) -> DataFrame:
    """Nodes of the chosen files (file_id, row_order) in their order, each file once."""
    first = chosen.groupBy(F.col("file_id").alias("_f")).agg(F.min("row_order").alias("row_order"))
    return nodes.join(first, F.col("file_id") == F.col("_f")).drop("_f").orderBy("row_order", "file_id", "node_id")


def contingency(a: DataFrame, b: DataFrame) -> DataFrame:
    """Files per pair of labels of two partitions."""
    return a.select("file_id", F.col("label").alias("label_a")).join(b.select("file_id", F.col("label").alias("label_b")), "file_id").groupBy("label_a", "label_b").agg(F.count(F.lit(1)).alias("n"))


def adjusted_rand(a: DataFrame, b: DataFrame) -> DataFrame:
    """Adjusted Rand index of two partitions; 1 where both are trivial."""
    c = contingency(a, b)
    pairs = lambda n: F.col(n) * (F.col(n) - 1) / 2
    cells = c.agg(F.sum(pairs("n")).alias("cells"), F.sum("n").alias("total"))
    rows = c.groupBy("label_a").agg(F.sum("n").alias("s")).agg(F.sum(pairs("s")).alias("rows"))
    cols = c.groupBy("label_b").agg(F.sum("n").alias("s")).agg(F.sum(pairs("s")).alias("cols"))
    expected = F.col("rows") * F.col("cols") / F.nullif(pairs("total"), F.lit(0))
    top = (F.col("rows") + F.col("cols")) / 2
    return cells.crossJoin(rows).crossJoin(cols).select(F.coalesce((F.col("cells") - expected) / F.nullif(top - expected, F.lit(0)), F.lit(1.0)).alias("ari"))


def leaf_sample(n: int, most: int) -> list[int]:
    """Evenly spaced positions of a leaf order, at most ``most``."""
    if n <= most:
        return list(range(n))
    return sorted({int(i * (n - 1) / (most - 1)) for i in range(most)}) if most > 1 else [0]


def mutual_information(a: DataFrame, b: DataFrame) -> DataFrame:
    """Normalised mutual information of two partitions, by the mean of their entropies; 1 where both are trivial."""
    c = contingency(a, b)
    total = c.agg(F.sum("n").cast("double").alias("t"))
    share = lambda rows, n: rows.crossJoin(F.broadcast(total)).withColumn("p", F.col(n) / F.col("t"))
    entropy = lambda by, name: share(c.groupBy(by).agg(F.sum("n").alias("s")), "s").agg((-F.sum(F.col("p") * F.log("p"))).alias(name))
    one, two = entropy("label_a", "ha"), entropy("label_b", "hb")
    joint = share(c, "n").agg((-F.sum(F.col("p") * F.log("p"))).alias("hab"))
    mean = (F.col("ha") + F.col("hb")) / 2
    return one.crossJoin(two).crossJoin(joint).select(F.when(F.col("ha").isNull(), None).when(mean == 0, 1.0).otherwise(F.greatest(F.lit(0.0), (F.col("ha") + F.col("hb") - F.col("hab")) / mean)).alias("nmi"))


def string_members(table: DataFrame, chosen: DataFrame) -> DataFrame:
    """Adds whether a row's file is among the chosen, ids compared as text."""
    ids = chosen.select(F.col("file_id").cast("string").alias("_s")).where("_s is not null").distinct().withColumn("_in", F.lit(True))
    return table.join(ids, F.col("file_id").cast("string") == F.col("_s"), "left").withColumn("added", F.coalesce("_in", F.lit(False))).drop("_s", "_in")


def labels_by_text(table: DataFrame, assignment: DataFrame) -> DataFrame:
    """Label of each row's file, ids compared as text; a blank label is none. A file with several labels has the least."""
    label = F.when(F.trim(F.col("label").cast("string")) != "", F.col("label"))
    per = assignment.select(F.col("file_id").cast("string").alias("_s"), label.alias("label")).where("_s is not null").groupBy("_s").agg(F.min("label").alias("label"))
    keep = [c for c in table.columns if c != "label"]
    return table.select(*keep).join(per, F.col("file_id").cast("string") == F.col("_s"), "left").drop("_s")
