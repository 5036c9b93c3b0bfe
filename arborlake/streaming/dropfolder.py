"""SWC files that arrive in a folder are appended to a node table as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.sources import store
from arborlake.sources.swc import new_files, node_table


def parse_contents(files: DataFrame) -> DataFrame:
    """Nodes of whole SWC files (path, content); lines of fewer than seven numbers are skipped."""
    name = F.url_decode(F.regexp_extract("path", "([^/]+)$", 1)).alias("file_id")
    lines = files.select(name, F.explode(F.split(F.decode("content", "UTF-8"), r"\r?\n")).alias("line"))
    parts = F.split(F.trim(F.regexp_replace(F.regexp_replace("line", "#.*$", ""), r"\s+", " ")), " ")
    numbers = lines.select("file_id", F.transform(parts, lambda p: p.try_cast("double")).alias("v")).where(F.size("v") >= 7)
    numbers = numbers.where(F.forall(F.slice("v", 1, 7), lambda v: v.isNotNull()))
    whole = lambda i, n: F.col("v")[i].cast("int").alias(n)
    return numbers.select("file_id", whole(0, "node_id"), whole(1, "type"), *[F.col("v")[i].alias(n) for i, n in ((2, "x"), (3, "y"), (4, "z"), (5, "radius"))], whole(6, "parent_id"))


def follow(spark: SparkSession, folder: str, table: str, checkpoint: str, once: bool = True):
    """Start the stream; with ``once`` it ends when all present files are in.

    Each micro-batch is an anti-join against the files that the table has, so
    a batch that is run again after a failure adds nothing twice.
    """

    def add(batch: DataFrame, _: int) -> None:
        nodes = node_table(parse_contents(batch), None, None, 25.0)
        if store.exists(spark, table):
            nodes = new_files(nodes, spark.read.parquet(table))
        nodes.write.mode("append").parquet(table)

    stream = spark.readStream.format("binaryFile").option("pathGlobFilter", "*.swc").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    writer = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
