"""Connected components of a graph given as edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.runtime import dropped, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges (a, b), each once; the neighbours of a vertex are never gathered."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not large:
        both = both.where("b < a")
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    joined = both.join(least, F.col("a") == F.col("u"))
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Component of each vertex: its least vertex.

    ``edges`` has two columns of one orderable type, in any direction; nulls
    and loops are no edges, repeats count once. Vertices without an edge are
    not in it. An empty table gives no rows. Output: vertex, component.

    Each round writes its edges to the shared folder; the number of rounds is
    logarithmic in the graph's size.
    """
    a, b = edges.columns
    now = written(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct())

    def mark(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()

    seen = mark(now)
    for _ in range(most_rounds):
        step = written(_star(_star(now, large=True), large=False))
        got = mark(step)
        dropped(now)
        now = step
        if got == seen:
            break
        seen = got
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("vertex"), F.col("b").alias("component")).unionAll(now.select(F.col("b").alias("vertex"), F.col("b").alias("component")).distinct())
