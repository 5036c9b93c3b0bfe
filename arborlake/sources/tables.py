"""Node and point tables: opening, schema checks, sinks with sidecar metadata, project folders."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.operators.assignments import onto_nodes, selected_rows
from arborlake.operators.points import appended, standardised, with_origin
from arborlake.sources import store


def open_nodes(spark: SparkSession, path: str, view: str = "neurons") -> DataFrame:
    """A Parquet node table, registered as a view. Raises if it is not there."""
    if not store.exists(spark, path):
        raise FileNotFoundError(path)
    df = spark.read.parquet(path)
    df.createOrReplaceTempView(view)
    return df


def has_column(df: DataFrame, name: str) -> bool:
    return name in df.columns


def _sidecar(path: str) -> str:
    return f"{path.rstrip('/')}/_meta.json"


def write_table(df: DataFrame, path: str, metadata: dict | None = None, compression: str = "zstd") -> None:
    """Write beside the target, then publish by rename.

    Metadata goes into ``_meta.json`` in the table's folder, which Spark's
    readers skip.
    """
    spark, staged = df.sparkSession, store.staging(path)
    df.write.option("compression", compression).parquet(staged)
    if metadata is not None:
        store.write_text(spark, _sidecar(staged), json.dumps(metadata, sort_keys=True))
    store.publish(spark, staged, path)


def read_metadata(spark: SparkSession, path: str) -> dict:
    """The table's metadata, empty if it has none."""
    return json.loads(store.read_text(spark, _sidecar(path))) if store.exists(spark, _sidecar(path)) else {}


def write_enhanced(nodes: DataFrame, per_file: DataFrame, columns: list[str], path: str, metadata: dict | None = None) -> None:
    """Node table with per-file annotations; columns that an earlier export added are replaced."""
    write_table(onto_nodes(nodes, per_file, columns), path, {"annotation_columns": columns} | (metadata or {}))


def write_selection(nodes: DataFrame, chosen: DataFrame, path: str) -> None:
    """The chosen files' nodes in their order."""
    write_table(selected_rows(nodes, chosen), path)


#: Columns of the projected-node CSV, in order.
PROJECTED = (
    "file_id", "neuron_id", "subject", "node_id", "parent_id", "type", "x_um", "y_um", "z_um", "voxel_i", "voxel_j", "voxel_k",
    "x_flat", "y_flat", "depth_um", "valid", "invalid_reason", "region_id", "region_acronym", "flatmap_style", "coordinate_mode",
    "flatmap_lookup_mode", "flatmap_valid", "depth_valid", "render_valid", "x_flat_bin", "y_flat_bin", "depth_bin", "depth_bin_label",
    "allen_layer_index", "allen_layer_label",
)


def projected_rows(projected: DataFrame, columns: tuple[str, ...] = PROJECTED) -> DataFrame:
    """The fixed set of columns as text; missing columns and values are NaN."""
    return projected.select(*[F.coalesce(F.col(c).cast("string"), F.lit("NaN")).alias(c) if c in projected.columns else F.lit("NaN").alias(c) for c in columns])


def write_projected_csv(projected: DataFrame, path: str, columns: tuple[str, ...] = PROJECTED) -> None:
    projected_rows(projected, columns).write.mode("overwrite").option("header", True).csv(path)


#: Names of the standard columns.
STANDARD = ("label", "x", "y", "z", "region_name", "acronym", "id", "hemisphere")


def parse_mapping(text: str) -> dict[str, str]:
    """Column mapping {standard name: column} from JSON, turned round; unknown, missing and doubled names raise."""
    given = json.loads(text)
    if unknown := set(given) - set(STANDARD):
        raise ValueError(f"unknown columns: {sorted(unknown)}")
    if missing := set(STANDARD[:4]) - set(given):
        raise ValueError(f"missing columns: {sorted(missing)}")
    if len(set(given.values())) < len(given):
        raise ValueError("a column is mapped twice")
    return {old: new for new, old in given.items()}


def load_mapping(spark: SparkSession, path: str) -> dict[str, str]:
    return parse_mapping(store.read_text(spark, path))


def two_row_header(first: list[str], second: list[str]) -> list[str]:
    """Names of a CSV with group and field rows: the group is carried on, words become lower-case slugs."""
    import re

    names, group = [], ""
    slug = lambda v: re.sub(r"[^0-9A-Za-z]+", "_", v).strip("_").lower()
    for g, f in zip(first, second):
        group = g.strip() or group
        names.append("_".join(x for x in (slug(group), slug(f)) if x))
    return names


#: Columns of a CSV with two header rows that stand for the standard ones.
TWO_ROWS = {"marker": "label", "atlas_x": "x", "atlas_y": "y", "atlas_z": "z", "region_name": "region_name", "region_acronym": "acronym", "region_id": "id", "region_hemisphere": "hemisphere"}


def _first_rows(spark: SparkSession, path: str) -> list[list[str]]:
    from arborlake.sources.csv_points import RecordParser

    return [RecordParser(r["value"]).record() for r in spark.read.text(path).limit(2).collect()]


def header_kind(spark: SparkSession, path: str) -> tuple[str, list[str]]:
    """How a CSV names its columns: ``standard``, ``aliases`` or ``two rows``, and the names; raises if in no known way."""
    from arborlake.sources.csv_points import ALIASES

    rows = _first_rows(spark, path)
    first = [c.strip().lstrip("\ufeff") for c in rows[0]] if rows else []
    if set(STANDARD[:4]) <= set(first):
        return "standard", first
    if set(STANDARD[:4]) <= {ALIASES.get(c, c) for c in first}:
        return "aliases", first
    if len(rows) > 1 and len(rows[1]) == len(first):
        names = two_row_header(first, rows[1])
        if {"marker", "atlas_x", "atlas_y", "atlas_z"} <= set(names):
            return "two rows", names
    raise ValueError(f"columns of {path} are not known: {first}")


def read_points(spark: SparkSession, path: str, mapping: dict[str, str] | None = None) -> DataFrame:
    """Points from CSV or Parquet in the standard form.

    The names of a CSV's columns come from the mapping, else from its header:
    standard names, other names of the standard columns, or a group row above
    a field row.
    """
    from arborlake.sources.csv_points import ALIASES

    if path.endswith(".parquet"):
        return standardised(spark.read.parquet(path))
    name = path.rstrip("/").rsplit("/", 1)[-1]
    csv = {"quote": '"', "escape": '"'}
    if mapping is not None:
        return with_origin(standardised(spark.read.csv(path, header=True, **csv), mapping), name)
    kind, names = header_kind(spark, path)
    if kind == "two rows":
        # Both header rows are left out by what they hold: coordinates that are no numbers.
        raw = spark.read.csv(path, schema=", ".join(f"`{n}` string" for n in _distinct(names)), **csv)
        heads = {tuple(r) for r in _first_rows(spark, path)}
        is_head = F.lit(False)
        for h in heads:
            same = F.lit(True)
            for c, v in zip(raw.columns, h):
                same = same & F.coalesce(F.col(f"`{c}`"), F.lit("")).eqNullSafe(F.lit(v))
            is_head = is_head | same
        return with_origin(standardised(raw.where(~is_head), {c: n for c, n in TWO_ROWS.items() if c in raw.columns}), name)
    known = {c: ALIASES[c] for c in names if kind == "aliases" and c in ALIASES}
    return with_origin(standardised(spark.read.csv(path, header=True, **csv), known), name)


def _distinct(names: list[str]) -> list[str]:
    out: list[str] = []
    for n in names:
        k, name = 2, n or "column"
        while name in out:
            name, k = f"{n or 'column'}_{k}", k + 1
        out.append(name)
    return out


def convert_points(spark: SparkSession, paths: list[str], out: str, mapping: dict[str, str] | None = None) -> dict:
    """CSV files to one point table; all must have the columns and types of the first. Returns counts."""
    if not paths:
        raise FileNotFoundError("no point files")
    tables = [read_points(spark, p, mapping) for p in paths]
    for p, t in zip(paths[1:], tables[1:]):
        if t.dtypes != tables[0].dtypes:
            raise ValueError(f"columns of {p} differ from those of {paths[0]}: {t.dtypes} and {tables[0].dtypes}")
    both = tables[0]
    for t in tables[1:]:
        both = both.unionByName(t)
    write_table(both, out, compression="snappy")
    return {"discovered": len(paths), "processed": len(paths), "rows": spark.read.parquet(out).count()}


def convert_point_folder(spark: SparkSession, folder: str, out: str) -> dict:
    """All CSV files of a folder, in order of name."""
    if not store.is_folder(spark, folder):
        raise NotADirectoryError(folder)
    return convert_points(spark, store.files_below(spark, folder, ".csv", recursive=False), out)


def append_points(spark: SparkSession, table: str, more: str, mapping: dict[str, str] | None = None) -> int:
    """Append points of a CSV or Parquet file to a point table of the same schema; returns the rows added."""
    if store.real_path(spark, table) == store.real_path(spark, more):
        raise ValueError("a table cannot be appended to itself")
    if mapping and more.endswith(".parquet"):
        raise ValueError("a mapping goes with CSV only")
    new = read_points(spark, more, mapping)
    both = appended(spark.read.parquet(table), new)
    n = new.count()
    write_table(both, table)
    return n


def save_project(folder: str, nodes: DataFrame, manifest: dict) -> None:
    """A project folder: manifest and node subset, published by one rename."""
    spark, staged = nodes.sparkSession, store.staging(folder)
    nodes.write.parquet(f"{staged}/nodes.parquet")
    store.write_text(spark, f"{staged}/manifest.json", json.dumps(manifest, sort_keys=True))
    store.publish(spark, staged, folder)


def load_project(spark: SparkSession, folder: str) -> tuple[dict, DataFrame]:
    return json.loads(store.read_text(spark, f"{folder}/manifest.json")), spark.read.parquet(f"{folder}/nodes.parquet")


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """A file by its suffix: SWC, Parquet, CSV points or NRRD; others raise."""
    from arborlake.sources import nrrd, swc

    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "swc":
        return swc.read_swc(spark, [path])[0]
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "csv":
        return read_points(spark, path)
    if kind == "nrrd":
        return nrrd.read_nrrd(spark, path)
    raise ValueError(f"no reader for {path}")
