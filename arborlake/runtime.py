"""Session helpers: table access, lineage cuts in the shared folder, sizing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables of an input folder, columns as stored."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it.

    ``spark.checkpoint.dir`` decides. Only where neither it nor a checkpoint
    folder is set, and the session is local, a temporary folder is used.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="arborlake-")
    sc.setCheckpointDir(own)
    return own


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage: write a compressed table to the shared folder, read it back.

    A columnar table needs a fraction of the space of ``checkpoint()`` and
    survives the loss of executors just as well. It goes when it is dropped, or
    with the session.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/arborlake-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    fs, target = file_system(spark, path)
    fs.deleteOnExit(target)
    out = spark.read.schema(df.schema).parquet(path)
    out._arborlake_path = path
    return out


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path; so that any store that Spark reads can be used."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def dropped(df: DataFrame) -> None:
    """Delete a table made by ``written`` that nothing reads any more."""
    path = getattr(df, "_arborlake_path", None)
    if path:
        fs, target = file_system(df.sparkSession, path)
        fs.delete(target, True)


def is_number(c: Column | str) -> Column:
    """True where a double is neither null, NaN nor infinite; never null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.abs(c) < F.lit(float("inf")), F.lit(False))


def times_as_text(df: DataFrame, *names: str) -> DataFrame:
    """Timestamps as text to the microsecond, which every store and checker holds alike."""
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") for c in names})


def arrow_schema(ddl: str):
    """Arrow schema of a flat DDL string; usable inside Python workers."""
    import pyarrow as pa

    kinds = {
        "string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "float": pa.float32(),
        "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "timestamp": pa.timestamp("us", tz="UTC"),
    }
    return pa.schema([pa.field(*(lambda n, k: (n, kinds[k]))(*part.strip().split(" ", 1))) for part in ddl.split(",")])
