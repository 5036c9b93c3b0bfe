"""Voxel engine: binning, masks, volumes as sparse tables (i, j, k, value)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arborlake.functions.columns import finite, voxel
from arborlake.operators.nodes import member, soma_distance_filter

IJK = ("i", "j", "k")


def binned(nodes: DataFrame, size: float, rule: str = "floor", shape: tuple[int, int, int] | None = None, reverse: bool = False) -> DataFrame:
    """Adds voxel indices i, j, k of finite nodes; with a shape, only those inside. ``reverse``: axes as z, y, x."""
    axes = "zyx" if reverse else "xyz"
    out = nodes.where(finite("x", "y", "z")).withColumns({n: voxel(c, size, rule) for n, c in zip(IJK, axes)})
    if shape:
        for n, limit in zip(IJK, shape):
            out = out.where((F.col(n) >= 0) & (F.col(n) < limit))
    return out


def heatmap(nodes: DataFrame, size: float, shape: tuple[int, int, int] | None = None, regions: list[int] | None = None, files: list[str] | None = None, types: list[int] | None = None, radius: float | None = None, depth_step: int = 1) -> DataFrame:
    """Nodes per voxel. The radius filter comes first, on the files' own somas; depth_step joins planes of the first axis."""
    near = soma_distance_filter(member(nodes, "file_id", files), radius)
    rows = binned(member(member(near, "region_id", regions), "type", types), size, "floor", shape)
    return rows.groupBy(F.floor(F.col("i") / depth_step).alias("i"), "j", "k").agg(F.count(F.lit(1)).alias("n"))


def annotate(nodes: DataFrame, annotation: DataFrame, size: float, rule: str = "truncate") -> DataFrame:
    """Region of each node by its voxel (i, j, k, region_id); 0 outside and for nodes without coordinates.

    Large annotations are shuffled like any join; Spark broadcasts small ones.
    """
    place = {f"_{n}": F.when(finite("x", "y", "z"), voxel(c, size, rule)) for n, c in zip(IJK, "xyz")}
    a = annotation.select(*[F.col(n).alias(f"a{n}") for n in IJK], F.col("region_id").alias("_region"))
    on = (F.col("_i") == F.col("ai")) & (F.col("_j") == F.col("aj")) & (F.col("_k") == F.col("ak"))
    keep = [c for c in nodes.columns if c != "region_id"]
    return nodes.withColumns(place).join(a, on, "left").select(*keep, F.coalesce("_region", F.lit(0)).alias("region_id"))


def mask_bounds(mask: DataFrame, size: float) -> DataFrame:
    """Bounds of a mask in µm: half a voxel of pad, not below 0. One row."""
    low = lambda n, c: F.greatest(F.lit(0.0), (F.min(n) - 0.5) * size).alias(f"{c}_low")
    return mask.agg(*[low(n, c) for n, c in zip(IJK, "xyz")], *[((F.max(n) + 1.5) * size).alias(f"{c}_high") for n, c in zip(IJK, "xyz")])


def in_mask(nodes: DataFrame, mask: DataFrame, size: float) -> DataFrame:
    """Nodes whose voxel is in the mask. The mask's bounds (one row) come first, as a filter that reaches the scan."""
    m = mask.select(*[F.col(n).alias(f"_{n}") for n in IJK]).distinct()
    low_high = m.agg(*[f(f"_{n}").alias(f"{n}_{w}") for n in IJK for w, f in (("low", F.min), ("high", F.max))]).first()
    if low_high["i_low"] is None:
        return binned(nodes, size).where(F.lit(False))
    for n, c in zip(IJK, "xyz"):
        # Half a voxel of room: the exact test follows.
        nodes = nodes.where((F.col(c) >= (low_high[f"{n}_low"] - 0.5) * size) & (F.col(c) <= (low_high[f"{n}_high"] + 1.5) * size))
    rows = binned(nodes, size)
    return rows.join(m, (F.col("i") == F.col("_i")) & (F.col("j") == F.col("_j")) & (F.col("k") == F.col("_k")), "left_semi")


def neurons_in_mask(nodes: DataFrame, mask: DataFrame, size: float) -> DataFrame:
    return in_mask(nodes, mask, size).select("file_id", "neuron_id", "subject").distinct()


def merged(*volumes: DataFrame) -> DataFrame:
    """Sum of volumes with a column n."""
    out = volumes[0].select(*IJK, "n")
    for v in volumes[1:]:
        out = out.unionByName(v.select(*IJK, "n"))
    return out.groupBy(*IJK).agg(F.sum("n").alias("n"))


def isolated(volume: DataFrame, annotation: DataFrame, regions: list[int]) -> DataFrame:
    """Voxels of a volume that the annotation puts into the regions."""
    return volume.join(annotation.where(F.col("region_id").isin(regions)).select(*IJK).distinct(), list(IJK), "left_semi")


def threshold_mask(volume: DataFrame, low: float, high: float = math.inf) -> DataFrame:
    """Voxels with low <= n <= high. A low of 0 or less would take in every empty voxel and is refused."""
    if low <= 0:
        raise ValueError("the lower threshold must be positive for a sparse volume")
    return volume.where((F.col("n") >= low) & (F.col("n") <= F.lit(float(high)))).select(*IJK)


def region_mask(annotation: DataFrame, regions: list[int]) -> DataFrame:
    """Voxels of any of the regions."""
    return annotation.where(F.col("region_id").isin(regions)).select(*IJK).distinct()


def voxel_numbers(mask: DataFrame) -> DataFrame:
    """Contiguous numbers of a mask's voxels in order of i, j, k, from 0.

    Numbers within a plane are counted from where the plane begins, so only
    one row a plane goes through the unpartitioned window.
    """
    rows = mask.select(*IJK).distinct()
    planes = rows.groupBy("i").agg(F.count(F.lit(1)).alias("n"))
    starts = planes.select(F.col("i").alias("_i"), (F.sum("n").over(Window.orderBy("i")) - F.col("n")).alias("before"))
    number = F.col("before") + F.row_number().over(Window.partitionBy("i").orderBy("j", "k")) - 1
    return rows.join(starts, F.col("i") == F.col("_i")).select(*IJK, number.alias("voxel_id"))


def smoothed(volume: DataFrame, sigma: float, shape: tuple[int, int, int]) -> DataFrame:
    """Separable Gaussian, borders repeated; a sigma of 0 or less copies.

    Each axis spreads a voxel to the neighbours that would read it, with the
    weights of all places outside that repeat it.
    """
    out = volume.select(*IJK, F.col("n").cast("double").alias("n"))
    if sigma <= 0:
        return out
    reach = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    w = (w / w.sum()).tolist()
    for axis, size in zip(IJK, shape):
        step = F.explode(F.arrays_zip(F.lit(list(range(-reach, reach + 1))).alias("d"), F.lit(w).alias("w"))).alias("s")
        rest = [c for c in IJK if c != axis]
        inner = out.select(*IJK, "n", step).select(*rest, (F.col(axis) - F.col("s.d")).alias(axis), (F.col("n") * F.col("s.w")).alias("n")).where(F.col(axis).between(0, size - 1))
        spread = [inner]
        # A target t near a border reads the border voxel for all places beyond it.
        for edge, side in ((0, -1), (size - 1, 1)):
            beyond = [(t, sum(w[d + reach] for d in range(-reach, reach + 1) if (t + d < 0 if side < 0 else t + d > size - 1))) for t in range(max(0, edge - reach), min(size - 1, edge + reach) + 1)]
            beyond = [(t, x) for t, x in beyond if x > 0]
            if beyond:
                more = F.explode(F.array(*[F.struct(F.lit(t).cast("long").alias("t"), F.lit(x).alias("w")) for t, x in beyond])).alias("s")
                spread.append(out.where(F.col(axis) == edge).select(*rest, "n", more).select(*rest, F.col("s.t").alias(axis), (F.col("n") * F.col("s.w")).alias("n")))
        both = spread[0]
        for s in spread[1:]:
            both = both.unionByName(s)
        out = both.groupBy(*IJK).agg(F.sum("n").alias("n"))
    return out.select(*IJK, "n")


def histogram(volume: DataFrame, bins: int = 256, value: str = "n") -> DataFrame:
    """Histogram of the finite values other than 0, the last bin right-closed; a degenerate range is padded.

    Output: bin, low, high, n for all bins; no rows without values.
    """
    v = volume.where(finite(F.col(value).cast("double")) & (F.col(value) != 0)).select(F.col(value).cast("double").alias("v"))
    seen = v.agg(F.min("v").alias("low"), F.max("v").alias("high")).first()
    spark = volume.sparkSession
    if seen["low"] is None:
        return spark.createDataFrame([], "bin int, low double, high double, n long")
    low, high = seen["low"], seen["high"]
    if high <= low:
        pad = max(abs(low) * 0.01, 0.5)
        low, high = low - pad, high + pad
    width = (high - low) / bins
    count = v.groupBy(F.least(F.floor((F.col("v") - low) / width), F.lit(bins - 1)).cast("int").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    every = spark.range(bins).select(F.col("id").cast("int").alias("bin"), (F.lit(low) + F.col("id") * width).alias("low"), (F.lit(low) + (F.col("id") + 1) * width).alias("high"))
    return every.join(count, F.col("bin") == F.col("b"), "left").select("bin", "low", "high", F.coalesce("n", F.lit(0)).alias("n"))


def step_curve(hist: DataFrame) -> DataFrame:
    """Two points a bin, left and right edge at its height."""
    points = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("low").alias("x")), F.struct(F.lit(1).alias("side"), F.col("high").alias("x")))).alias("p")
    return hist.select("bin", "n", points).select("bin", "p.side", "p.x", F.col("n").alias("y"))


def otsu(volume: DataFrame) -> float:
    """Otsu threshold of the positive values: the centre of the first bin of largest variance between classes."""
    positive = volume.where("n > 0")
    n, different = positive.agg(F.count(F.lit(1)), F.countDistinct("n")).first()
    if n == 0:
        raise ValueError("no positive voxels")
    if different == 1:
        return float(positive.agg(F.max("n")).first()[0])
    rows = histogram(positive, min(256, n)).orderBy("bin").collect()  # at most 256 rows
    count, mid = np.array([r["n"] for r in rows], float), np.array([(r["low"] + r["high"]) / 2 for r in rows])
    below, above = np.cumsum(count), np.cumsum(count[::-1])[::-1]
    mean_below = np.cumsum(count * mid) / np.maximum(below, 1)
    mean_above = (np.cumsum((count * mid)[::-1]) / np.maximum(above[::-1], 1))[::-1]
    return float(mid[np.argmax(below[:-1] * above[1:] * (mean_below[:-1] - mean_above[1:]) ** 2)])


def heatmap_mask(volume: DataFrame, sigma: float, shape: tuple[int, int, int], threshold: float | None = None) -> DataFrame:
    """Smooth, then keep what reaches the threshold (Otsu's if none is given)."""
    soft = smoothed(volume, sigma, shape)
    return threshold_mask(soft, otsu(soft) if threshold is None else threshold)


def dilated(mask: DataFrame, fraction: float, shape: tuple[int, int, int]) -> DataFrame:
    """Grow a mask by whole distance shells until its volume reaches (1 + fraction) times the first.

    Distances are Euclidean, to the nearest mask voxel; squares are added axis
    by axis within a reach that is doubled until enough voxels are reached, or
    all of the volume is: a mask that is wanted larger than the volume fills it.
    """
    start = mask.select(*IJK).distinct()
    n = start.count()
    if n == 0 or fraction <= 0:
        return start
    want, reach = n * (1 + fraction), 1
    while True:
        shells = start.withColumn("d2", F.lit(0).cast("long"))
        for c, limit in zip(IJK, shape):
            least, last = F.greatest(F.col(c) - reach, F.lit(0)), F.least(F.col(c) + reach, F.lit(limit - 1))
            shells = shells.where(least <= last).withColumn("to", F.explode(F.sequence(least.cast("long"), last.cast("long"))))
            shells = shells.withColumn("d2", F.col("d2") + (F.col("to") - F.col(c)) * (F.col("to") - F.col(c))).where(F.col("d2") <= reach * reach)
            shells = shells.withColumn(c, F.col("to")).groupBy(*IJK).agg(F.min("d2").alias("d2"))
        sizes = shells.groupBy("d2").agg(F.count(F.lit(1)).alias("n")).orderBy("d2").collect()  # at most reach² rows
        total = 0
        for r in sizes:
            total += r["n"]
            if total >= want:
                return shells.where(F.col("d2") <= r["d2"]).select(*IJK)
        if reach * reach >= sum((limit - 1) ** 2 for limit in shape):  # no two voxels are further apart
            return shells.select(*IJK)
        reach *= 2


def majority_labels(rows: DataFrame, label: str = "region_id", bins: tuple[str, ...] = IJK) -> DataFrame:
    """Most frequent label per bin, ties to the least; and how many labels the bin has."""
    count = rows.groupBy(*bins, label).agg(F.count(F.lit(1)).alias("n"))
    best = F.max(F.struct(F.col("n").alias("n"), (-F.col(label)).alias("l")))
    return count.groupBy(*bins).agg(best.alias("b"), F.count(F.lit(1)).alias("n_labels")).select(*bins, (-F.col("b.l")).alias(label), F.col("b.n").alias("n"), "n_labels")


def exposed_faces(voxels: DataFrame) -> DataFrame:
    """Faces of a voxel set that border on nothing: voxel and direction (axis, side)."""
    v = voxels.select(*IJK).distinct()
    sides = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.lit(s).alias("side")) for a in IJK for s in (-1, 1)])).alias("f")
    faces = v.select(*IJK, sides).select(*IJK, "f.axis", "f.side")
    for n in IJK:
        faces = faces.withColumn(f"n{n}", F.when(F.col("axis") == n, F.col(n) + F.col("side")).otherwise(F.col(n)))
    there = v.select(*[F.col(n).alias(f"_{n}") for n in IJK])
    on = (F.col("ni") == F.col("_i")) & (F.col("nj") == F.col("_j")) & (F.col("nk") == F.col("_k"))
    return faces.join(there, on, "left_anti").select(*IJK, "axis", "side")


def face_vertices(faces: DataFrame) -> DataFrame:
    """Distinct corners of the faces: the welded vertices of the closed surface."""
    rows = faces
    out = None
    for u in (0, 1):
        for w in (0, 1):
            shift = {
                "i": F.when(F.col("axis") == "i", (F.col("side") + 1) / 2).otherwise(F.lit(u)),
                "j": F.when(F.col("axis") == "j", (F.col("side") + 1) / 2).when(F.col("axis") == "i", F.lit(u)).otherwise(F.lit(w)),
                "k": F.when(F.col("axis") == "k", (F.col("side") + 1) / 2).otherwise(F.lit(w)),
            }
            corner = rows.select(*[(F.col(n) + shift[n]).cast("long").alias(n) for n in IJK])
            out = corner if out is None else out.unionAll(corner)
    return out.distinct()


def outlines(voxels: DataFrame) -> DataFrame:
    """Border edges within each plane i: voxel and direction along j or k."""
    return exposed_faces(voxels).where("axis <> 'i'")


def voxel_components(voxels: DataFrame) -> DataFrame:
    """6-connected components: i, j, k, component."""
    from arborlake.operators.components import connected_components

    v = voxels.select(*IJK).distinct().withColumn("v", F.struct(*IJK))
    steps = F.explode(F.array(*[F.struct(*[(F.col(n) + (1 if n == a else 0)).alias(n) for n in IJK]) for a in IJK])).alias("w")
    pairs = v.select("v", steps).join(v.select(F.col("v").alias("w")), "w", "left_semi").select("v", "w")
    labels = connected_components(pairs)
    joined = v.join(labels, F.col("v") == F.col("vertex"), "left")
    return joined.select(*IJK, F.coalesce("component", "v").alias("component"))


def common_histograms(volumes: DataFrame, bins: int = 256, name: str = "name", value: str = "n", zeros: bool = False) -> DataFrame:
    """Histograms of many volumes (name, value) with the same edges, those of all their values.

    Non-finite values are left out, and zeros unless asked for. A degenerate
    range is padded as by ``histogram``. Output: name, bin, low, high, n, all
    bins of every volume that has a row; no rows without values.
    """
    c = F.col(value).cast("double")
    ok = finite(c) & (F.lit(zeros) | (c != 0))
    rows = volumes.select(F.col(name).alias("name"), F.when(ok, c).alias("v"))
    edges = rows.agg(F.min("v").alias("low"), F.max("v").alias("high")).where("low is not null")
    pad = F.when(F.col("high") <= F.col("low"), F.greatest(F.abs("low") * 0.01, F.lit(0.5))).otherwise(0.0)
    edges = F.broadcast(edges.select((F.col("low") - pad).alias("low"), ((F.col("high") + pad - F.col("low") + pad) / bins).alias("width")))
    count = rows.where("v is not null").crossJoin(edges).groupBy("name", F.least(F.floor((F.col("v") - F.col("low")) / F.col("width")), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = rows.select("name").distinct().crossJoin(edges).select("name", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "low", "width")
    every = every.select("name", "bin", (F.col("low") + F.col("bin") * F.col("width")).alias("low"), (F.col("low") + (F.col("bin") + 1) * F.col("width")).alias("high"))
    return every.join(count, ["name", "bin"], "left").select("name", "bin", "low", "high", F.coalesce("n", F.lit(0)).alias("n"))


def neurons_in_masks(nodes: DataFrame, masks: DataFrame, size: float, sources: DataFrame | None = None, table: DataFrame | None = None) -> DataFrame:
    """Neurons with a node in any of several masks (i, j, k).

    ``sources`` (file_id) are the neurons that the masks were made of; they are
    excluded, ids compared as text. ``table`` (file_id) narrows the answer to
    a table's neurons; without it all neurons are asked.
    """
    out = neurons_in_mask(nodes, masks, size)
    if sources is not None:
        out = out.join(sources.select(F.col("file_id").cast("string").alias("_s")).distinct(), F.col("file_id").cast("string") == F.col("_s"), "left_anti")
    if table is not None:
        out = out.join(table.select(F.col("file_id").cast("string").alias("_s")).distinct(), F.col("file_id").cast("string") == F.col("_s"), "left_semi")
    return out


def world_bounds(mask: DataFrame, size: float) -> DataFrame:
    """Bounds of a mask in µm with the axes the other way round: those of i belong to z, of k to x."""
    b = mask_bounds(mask, size)
    return b.select(*[F.col(f"{a}_{w}").alias(f"{c}_{w}") for a, c in zip("xyz", "zyx") for w in ("low", "high")])


def region_at(points: DataFrame, annotation: DataFrame, regions: DataFrame, size: float) -> DataFrame:
    """Region record of each point; points outside, unannotated or of an unknown region have none and are left out."""
    found = annotate(points, annotation, size).where("region_id > 0")
    dim = regions.select(F.col("region_id").alias("_r"), "acronym", "region_name", "structure_id_path")
    return found.join(dim, F.col("region_id") == F.col("_r")).drop("_r")


def plot_series(volumes: DataFrame, bins: int = 256, name: str = "name", value: str = "n") -> DataFrame:
    """Step curves of many volumes over common edges: name, bin, side, x, y. A volume without values has no curve to draw, so its heights are 0."""
    hist = common_histograms(volumes, bins, name, value)
    points = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("low").alias("x")), F.struct(F.lit(1).alias("side"), F.col("high").alias("x")))).alias("p")
    return hist.select("name", "bin", "n", points).select("name", "bin", "p.side", "p.x", F.col("n").alias("y"))
