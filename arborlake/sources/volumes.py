"""Decoded volumes kept as tables, by the size and time of their source."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.runtime import file_system
from arborlake.sources import nrrd, store


def signature(spark: SparkSession, path: str) -> dict:
    """Size and time of change of a file."""
    fs, target = file_system(spark, path)
    s = fs.getFileStatus(target)
    return {"path": store.real_path(spark, path), "size": s.getLen(), "changed": s.getModificationTime()}


def cached(spark: SparkSession, path: str, cache: str, background: float | None = 0.0) -> DataFrame:
    """Voxels of a file from the cache, decoded again if the source is another or has changed."""
    seen = signature(spark, path)
    at = f"{cache.rstrip('/')}/{hashlib.sha256(seen['path'].encode()).hexdigest()[:32]}"
    mark = f"{at}/_source.json"
    if not store.exists(spark, mark) or json.loads(store.read_text(spark, mark)) != seen | {"background": background}:
        staged = store.staging(at)
        nrrd.read_nrrd(spark, path, background).drop("path").write.parquet(staged)
        store.write_text(spark, f"{staged}/_source.json", json.dumps(seen | {"background": background}))
        store.publish(spark, staged, at)
    return spark.read.parquet(at)


def shape_of(spark: SparkSession, path: str) -> tuple[int, ...]:
    """Spatial shape of an NRRD file, from its header; the axis of components is left out."""
    head = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, 65536).alias("h")).first()["h"]
    end = bytes(head).find(b"\n\n")
    if end < 0:
        raise ValueError("not an NRRD file with attached data")
    sizes = [int(v) for v in nrrd.decode_header(bytes(head)[:end])["sizes"].split()]
    if len(sizes) == 4:
        fits = [a for a, n in enumerate(sizes) if n == 2]
        axis = 3 if 3 in fits else 0 if 0 in fits else fits[0] if len(fits) == 1 else None
        if axis is None:
            raise ValueError("no axis of length 2, or several")
        sizes.pop(axis)
    return tuple(sizes)


def lookup_table(spark: SparkSession, paths: dict[str, str], cache: str) -> tuple[DataFrame, tuple[int, ...]]:
    """Lookup of both styles and the depth as one table (i, j, k, x_shaped, y_shaped, x_square, y_square, depth), and its shape; volumes of other shapes raise."""
    shapes = {kind: shape_of(spark, p) for kind, p in paths.items()}
    if len(set(shapes.values())) > 1:
        raise ValueError(f"shapes differ: {shapes}")
    out = cached(spark, paths["depth"], cache, None).select("i", "j", "k", F.col("value").alias("depth"))
    for s in ("shaped", "square"):
        v = cached(spark, paths[s], cache, None).select("i", "j", "k", F.col("x_flat").alias(f"x_{s}"), F.col("y_flat").alias(f"y_{s}"))
        out = out.join(v, ["i", "j", "k"], "left")
    return out, shapes["depth"]
