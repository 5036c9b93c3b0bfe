"""Small files, folders and publishing by rename on any store that Spark can reach."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from arborlake.runtime import file_system


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = file_system(spark, path)
    return fs.exists(target)


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, target = file_system(spark, path)
    return fs.exists(target) and fs.getFileStatus(target).isDirectory()


def real_path(spark: SparkSession, path: str) -> str:
    """Full name of a path with its store, so that two spellings of one place are equal."""
    fs, target = file_system(spark, path)
    return fs.makeQualified(target).toString() if not fs.exists(target) else fs.resolvePath(target).toString()


def files_below(spark: SparkSession, folder: str, suffix: str, recursive: bool) -> list[str]:
    """Files of a folder whose name ends with the suffix in any case, sorted."""
    fs, target = file_system(spark, folder)
    if not fs.exists(target):
        raise FileNotFoundError(folder)
    found, out = fs.listFiles(target, recursive), []
    while found.hasNext():
        path = found.next().getPath()
        if path.getName().lower().endswith(suffix):
            out.append(path.toUri().getPath() if path.toUri().getScheme() == "file" else path.toString())
    return sorted(out)


def read_text(spark: SparkSession, path: str) -> str:
    """A small text file; raises if it is not there."""
    fs, target = file_system(spark, path)
    if not fs.exists(target):
        raise FileNotFoundError(path)
    stream = fs.open(target)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, target = file_system(spark, path)
    stream = fs.create(target, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()


def staging(path: str) -> str:
    """Place beside a path where its next content is made."""
    return f"{path.rstrip('/')}.{uuid.uuid4().hex[:8]}.tmp"


def publish(spark: SparkSession, staged: str, path: str) -> None:
    """Put what was staged in the place of the path.

    What is there moves aside first and comes back if the new content cannot
    take its place; a reader sees the old content, the new, or for a moment
    none, never a mixture.
    """
    fs, target = file_system(spark, path)
    _, new = file_system(spark, staged)
    _, aside = file_system(spark, f"{staged}.old")
    there = fs.exists(target)
    if there and not fs.rename(target, aside):
        raise OSError(f"cannot move {path} aside")
    if not fs.rename(new, target):
        if there:
            fs.rename(aside, target)
        raise OSError(f"cannot publish {path}")
    if there:
        fs.delete(aside, True)
