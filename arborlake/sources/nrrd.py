"""NRRD volumes as sparse voxel tables."""

from __future__ import annotations

import gzip
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: NRRD type names.
TYPES = {
    "int8": "i1", "signed char": "i1", "uint8": "u1", "uchar": "u1", "unsigned char": "u1", "int16": "i2", "short": "i2", "uint16": "u2", "ushort": "u2", "unsigned short": "u2",
    "int32": "i4", "int": "i4", "uint32": "u4", "uint": "u4", "unsigned int": "u4", "int64": "i8", "uint64": "u8", "float": "f4", "double": "f8",
}


def decode_header(text: bytes) -> dict[str, str]:
    if not text.startswith(b"NRRD"):
        raise ValueError("not an NRRD file with attached data")
    header = {}
    for line in text.decode("ascii", "replace").splitlines()[1:]:
        if not line.startswith("#") and ":" in line:
            key, _, value = line.partition(":")
            header[key.strip().lower()] = value.lstrip("=").strip()
    return header


def dtype_of(header: dict[str, str]) -> np.dtype:
    return np.dtype(TYPES[header["type"].lower()]).newbyteorder(">" if header.get("endian", "little") == "big" else "<")


def agreed_transform(headers: dict[str, dict[str, str]], resolution: tuple[float, float, float] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Origin and directions that all volumes of a set share; raises where they differ.

    Volumes whose header has no directions need the explicit resolution, which the others must then have too.
    """
    have = {n: transform(h) for n, h in headers.items() if "space directions" in h}
    if len(have) < len(headers) and resolution is None:
        raise ValueError(f"no spatial transform: {sorted(set(headers) - set(have))}")
    given = (np.zeros(3), np.diag(np.asarray(resolution, float))) if len(have) < len(headers) else next(iter(have.values()))
    for n, (origin, directions) in have.items():
        if not np.allclose(directions, given[1], rtol=0, atol=1e-6) or not np.allclose(origin, given[0], rtol=0, atol=1e-6):
            raise ValueError(f"the spatial transform of {n} differs")
    if resolution is not None and not np.allclose(np.linalg.norm(given[1], axis=1), resolution, rtol=0, atol=1e-6):
        raise ValueError("the resolution does not fit the headers")
    return given


#: Names of the lookup files of a set.
LOOKUP_FILES = {"shaped": "flatmap_both_shaped.nrrd", "square": "flatmap_both_square.nrrd", "depth": "depth.nrrd"}


def discover_lookups(spark: SparkSession, folder: str, names: dict[str, str] | None = None) -> dict[str, str]:
    """Paths of the lookup files of a folder; the depth is the file of that name, or the only one with depth in its name."""
    from arborlake.sources import store

    names = names or LOOKUP_FILES
    there = {p.rsplit("/", 1)[-1]: p for p in store.files_below(spark, folder, ".nrrd", recursive=False)}
    out = {kind: there[n] for kind, n in names.items() if n in there}
    deep = [p for n, p in there.items() if "depth" in n]
    if "depth" not in out and len(deep) == 1:
        out["depth"] = deep[0]
    if missing := [names[kind] for kind in names if kind not in out]:
        raise FileNotFoundError(f"{folder} lacks {missing}")
    return out


def decode(content: bytes) -> tuple[dict[str, str], np.ndarray]:
    """Header and array (axis 0 is the fastest) of an NRRD file with attached data."""
    end = content.find(b"\n\n")
    if end < 0:
        raise ValueError("not an NRRD file with attached data")
    header = decode_header(content[:end])
    data = content[end + 2 :]
    kind = header.get("encoding", "raw").lower()
    if kind in ("gzip", "gz"):
        data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else zlib.decompress(data)
    elif kind != "raw":
        raise ValueError(f"encoding {kind!r}")
    dtype = dtype_of(header)
    sizes = tuple(int(v) for v in header["sizes"].split())
    return header, np.frombuffer(data, dtype, int(np.prod(sizes))).reshape(sizes, order="F")


def encode(volume: np.ndarray, header: dict[str, str] | None = None) -> bytes:
    """A raw NRRD file of an array."""
    name = {"f4": "float", "f8": "double"}.get(volume.dtype.str[1:], volume.dtype.name)
    lines = ["NRRD0004", f"type: {name}", f"dimension: {volume.ndim}", f"sizes: {' '.join(map(str, volume.shape))}", "endian: little", "encoding: raw"]
    lines += [f"{k}: {v}" for k, v in (header or {}).items()]
    return ("\n".join(lines) + "\n\n").encode() + volume.astype(volume.dtype.newbyteorder("<")).tobytes(order="F")


def components_last(volume: np.ndarray) -> np.ndarray:
    """A 4-D flat-map volume with its axis of length 2 at the end: the last, else the first, else the only one."""
    if volume.ndim != 4:
        raise ValueError("a flat map has four axes")
    fits = [a for a, n in enumerate(volume.shape) if n == 2]
    axis = 3 if 3 in fits else 0 if 0 in fits else fits[0] if len(fits) == 1 else None
    if axis is None:
        raise ValueError("no axis of length 2, or several")
    return np.moveaxis(volume, axis, -1)


def transform(header: dict[str, str]) -> tuple[np.ndarray, np.ndarray]:
    """Origin and direction matrix of a header; units where it has none."""
    vector = lambda t: [float(v) for v in t.strip("()").split(",")]
    parts = [p for p in header.get("space directions", "").split() if p != "none"]
    directions = np.array([vector(p) for p in parts]) if parts else np.eye(3)
    origin = np.array(vector(header["space origin"])) if "space origin" in header else np.zeros(3)
    return origin, directions


#: Voxels of one task, about.
SLAB_VOXELS = 4_000_000


def _header(f) -> tuple[dict[str, str], int]:
    """Header of an open file and where its data begins."""
    head = b""
    while b"\n\n" not in head:
        more = f.read(65536)
        if not more:
            raise ValueError("not an NRRD file with attached data")
        head += more
    end = head.find(b"\n\n")
    return decode_header(head[:end]), end + 2


def _slabs(batches):
    """Slabs of the slowest spatial axis of each file. Raw data is read by ranges; compressed data has to be read from its start."""
    from pyarrow import fs

    for files in batches:
        for path in files["path"]:
            store, name = fs.FileSystem.from_uri(path)
            with store.open_input_file(name) as f:
                header, begin = _header(f)
            sizes = [int(v) for v in header["sizes"].split()]
            if len(sizes) not in (3, 4):
                raise ValueError(f"{path}: {len(sizes)} axes")
            step = max(1, int(SLAB_VOXELS // max(1, np.prod(sizes[:-1]))))
            # A flat map with its components last is read as a whole: a slab of that axis would tear them apart.
            whole = len(sizes) == 4 and sizes[3] == 2 or header.get("encoding", "raw").lower() != "raw"
            starts = [0] if whole else list(range(0, sizes[-1], step))
            yield pd.DataFrame({"path": path, "begin": begin, "first": starts, "last": [sizes[-1] if whole else min(k + step, sizes[-1]) for k in starts]})


def _slab(path: str, begin: int, first: int, last: int) -> tuple[np.ndarray, int]:
    """The array of a slab, and how far it lies along the last axis."""
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    with store.open_input_file(name) as f:
        header, _ = _header(f)
        sizes = tuple(int(v) for v in header["sizes"].split())
        if header.get("encoding", "raw").lower() != "raw":
            f.seek(0)
            return decode(f.read())[1], 0
        dtype = dtype_of(header)
        plane = int(np.prod(sizes[:-1])) * dtype.itemsize
        data = f.read_at((last - first) * plane, begin + first * plane)
    return np.frombuffer(data, dtype).reshape((*sizes[:-1], last - first), order="F"), first


def read_nrrd(spark: SparkSession, path: str, background: float | None = 0.0) -> DataFrame:
    """Voxels of 3-D volumes (i, j, k, value) or flat maps (i, j, k, x_flat, y_flat).

    Raw volumes are read in slabs, a task each; compressed ones a file a task.
    Voxels of the background value are left out; None keeps all. Flat maps
    keep all but non-finite ones.
    """

    def run(batches):
        for slabs in batches:
            for path, begin, first, last in slabs.itertuples(index=False):
                v, shift = _slab(path, begin, first, last)
                if v.ndim == 3:
                    at = np.nonzero(v != background) if background is not None else tuple(a.ravel() for a in np.indices(v.shape))
                    got = {"x_flat": np.nan, "y_flat": np.nan, "value": v[at].astype(float)}
                else:
                    v = components_last(v)
                    at = np.nonzero(np.isfinite(v).all(-1))
                    got = {"x_flat": v[at][:, 0].astype(float), "y_flat": v[at][:, 1].astype(float), "value": np.nan}
                yield pd.DataFrame({"path": path, "i": at[0], "j": at[1], "k": at[2] + shift, **got})

    files = spark.read.format("binaryFile").load(path).select("path")
    slabs = files.mapInPandas(_slabs, "path string, begin long, first long, last long").repartition("path", "first")
    return slabs.mapInPandas(run, "path string, i long, j long, k long, x_flat double, y_flat double, value double")
