"""Similarity clusters of points: bisecting k-means, and groups linked by distance.

Points are summed up per grid cell (count, sums, sums of squares per axis).
The cells, one row each, are what bisecting k-means splits, in Spark: every
round splits all nodes of the tree that are not compact yet. Groups linked by
distance are found leaf by leaf, on boxes that bound the points of a part of a
cell, so that a task's size depends on the space it covers and not on how many
rows lie there.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arborlake.operators.components import connected_components
from arborlake.runtime import arrow_schema, dropped, is_number, written

#: Compactness limits of a leaf: root mean square distance to the centre (µm), and cells, which bound a task.
LEAF_RADIUS = 300.0
LEAF_CELLS = 20_000
#: Moves of the two centres in one split.
MOVES = 2
#: Parts of a cell along one axis; at most PARTS**3 boxes stand for all points of a cell.
PARTS = 4
IJK, XYZ = ("i", "j", "k"), ("x", "y", "z")
_FAR = 1e12


def _side(eps: float) -> float:
    """Side of a cell: all points of one lie within eps, with room for rounding in the index."""
    return eps / math.sqrt(3) * 0.99


def cell_index(c: str, side: float) -> Column:
    """Cell of a finite coordinate along one axis.

    Far from 0 the quotient of doubles is too coarse, so decimals are used;
    where cells do not fit into a long, each value is a cell of its own.
    """
    v = F.col(c)
    exact = F.floor(v.cast("decimal(38,6)") / F.lit(side).cast("decimal(18,12)")).cast("long")
    own = F.signum(v).cast("long") * (F.lit(1 << 62) + F.pmod(F.xxhash64(v), F.lit(1 << 61)))
    return F.when(F.abs(v) < _FAR, F.floor(v / side)).when(F.abs(v) < 1e18, exact).otherwise(own)


def located(neurons: DataFrame, eps: float) -> DataFrame:
    """Each node with finite coordinates once, with its cell: file_id, node_id, x, y, z, i, j, k.

    Rows with a null key name no node; null, NaN and infinite coordinates are
    none. Repeats of a node agree; should they not, the least value of each
    coordinate stands.
    """
    ok = is_number("x") & is_number("y") & is_number("z") & F.col("file_id").isNotNull() & F.col("node_id").isNotNull()
    nodes = neurons.where(ok).groupBy("file_id", "node_id").agg(*[F.min(c).alias(c) for c in XYZ])
    return nodes.select("*", *[cell_index(c, _side(eps)).alias(n) for c, n in zip(XYZ, IJK)])


def cell_sums(nodes: DataFrame) -> DataFrame:
    """One row a cell: its number, count of nodes, sums and sums of squares per axis, bounds."""
    sums = [f(x).alias(f"{n}{c}") for c in XYZ for n, f, x in (("s", F.sum, F.col(c)), ("q", F.sum, F.col(c) * F.col(c)), ("lo", F.min, F.col(c)), ("hi", F.max, F.col(c)))]
    # The numbers are stored, so they hold however the table is read.
    return written(nodes.groupBy(*IJK).agg(F.count(F.lit(1)).alias("n"), *sums).withColumn("cell", F.monotonically_increasing_id()))


def _along(p: str) -> Column:
    return F.element_at(F.array(*[F.col(f"{p}{c}") for c in XYZ]), F.col("axis"))


def _halved(cells: DataFrame) -> DataFrame:
    """Cells of active leaves, each leaf split in two by k-means: adds '0' or '1' to the leaf's name.

    The first halves lie on both sides of the mean along the widest axis. A
    mean lies among its own cells, so no half ever loses all of them.
    """
    out = cells.withColumn("side", F.coalesce(_along("c") > _along("m"), F.lit(False)))
    for _ in range(MOVES):
        on = lambda c, side: F.sum(F.when(F.col("side") == side, F.col(c)))
        centres = out.groupBy(F.col("leaf").alias("_of")).agg(*[(on(f"s{c}", side) / on("n", side)).alias(f"_{w}{c}") for c in XYZ for w, side in (("a", F.lit(False)), ("b", F.lit(True)))])
        away = lambda w: sum(((F.col(f"c{c}") - F.col(f"_{w}{c}")) * (F.col(f"c{c}") - F.col(f"_{w}{c}")) for c in XYZ), F.lit(0.0))
        out = out.join(centres, F.col("leaf") == F.col("_of")).withColumn("side", F.coalesce(away("b") < away("a"), F.col("side"))).drop("_of", *[f"_{w}{c}" for w in "ab" for c in XYZ])
    return out.withColumn("leaf", F.concat("leaf", F.col("side").cast("int").cast("string"))).drop("side")


def _measured(cells: DataFrame, radius: float, most_cells: int) -> DataFrame:
    """Cells with what their leaf needs for a split (axis, means m, n_cells) and whether it is to be split (active)."""
    var = lambda c: F.sum(F.col(f"s{c}") * F.col(f"s{c}") / F.col("n")) - F.sum(f"s{c}") * F.sum(f"s{c}") / F.sum("n")
    square = sum((F.sum(f"q{c}") - F.sum(f"s{c}") * F.sum(f"s{c}") / F.sum("n") for c in XYZ), F.lit(0.0)) / F.sum("n")
    stats = cells.groupBy(F.col("leaf").alias("_of")).agg(F.count(F.lit(1)).alias("_cells"), square.alias("_square"), *[(F.sum(f"s{c}") / F.sum("n")).alias(f"_m{c}") for c in XYZ], F.array(*[var(c) for c in XYZ]).alias("_vars"))
    joined = cells.join(stats, F.col("leaf") == F.col("_of"))
    # A leaf of as many cells as the one before could not be divided (its sums are beyond what doubles hold): it stays.
    splits = (F.col("_cells") > 1) & (F.col("_cells") < F.col("n_cells")) & ((F.col("_square") > radius * radius) | (F.col("_cells") > most_cells))
    axis = F.array_position("_vars", F.array_max("_vars")).cast("int")
    return joined.withColumns({"active": splits, "axis": axis, "n_cells": F.col("_cells")} | {f"m{c}": F.col(f"_m{c}") for c in XYZ}).drop("_of", "_cells", "_square", "_vars", *[f"_m{c}" for c in XYZ])


def bisect(cells: DataFrame, radius: float = LEAF_RADIUS, most_cells: int = LEAF_CELLS) -> DataFrame:
    """Bisecting k-means over the sums of all points: the cells with their leaf.

    A node of the tree is split by 2-means, from halves along its axis of
    largest variance, as long as its root mean square distance to the centre
    exceeds ``radius`` or it has more than ``most_cells`` cells. The limits
    apply to each node for itself, so splitting all of them in a round gives
    the same leaves as splitting the one of largest dispersion each time. A
    leaf is named by its way down the tree. A node of one cell, whose points
    all lie within the cell's size, is not split.

    The number of rounds is the depth of the tree. Each round is a few
    aggregates over one row a cell; cells of finished leaves leave it. Cells
    and leaves stay in tables in the shared folder.
    """
    centred = cells.withColumns({f"c{c}": F.col(f"s{c}") / F.col("n") for c in XYZ} | {"leaf": F.lit("r"), "n_cells": F.lit((1 << 63) - 1)})
    now, done = written(_measured(centred, radius, most_cells)), None
    while True:
        ended, active = now.where("not active").select(*cells.columns, "leaf"), now.where("active")
        done = ended if done is None else done.unionAll(ended)
        if active.isEmpty():
            return done
        now = written(_measured(_halved(active), radius, most_cells))


def near_boxes(low_a: np.ndarray, high_a: np.ndarray, low_b: np.ndarray, high_b: np.ndarray, limit: float) -> tuple[bool, bool]:
    """Whether some point of the boxes a lies within the limit (squared) of one of b: surely, and possibly.

    Every box is spanned by points on all of its faces, and a box of one point is that point.
    """
    gap = np.maximum(0, np.maximum(low_a[:, None] - high_b[None], low_b[None] - high_a[:, None]))
    least = (gap * gap).sum(2)
    if not (least <= limit).any():
        return False, False
    reach = np.maximum(high_a[:, None] - low_b[None], high_b[None] - low_a[:, None])
    return bool(((reach * reach).sum(2) <= limit).any()), True


OFFSETS = sorted(
    ((i, j, k) for i in range(-2, 3) for j in range(-2, 3) for k in range(-2, 3) if (i, j, k) > (0, 0, 0)),
    key=lambda o: sum(x * x for x in o),
)
LINKED = "cell long, other long, sure boolean"


def _link_leaf(eps: float):
    schema = arrow_schema(LINKED)
    limit = eps * eps * (1 + 1e-12)

    def run(table: pa.Table) -> pa.Table:
        get = {c: table.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "own", *IJK, *(f"{w}{c}" for w in ("lo", "hi") for c in XYZ))}
        order = np.argsort(get["cell"], kind="stable")
        get = {c: v[order] for c, v in get.items()}
        start = np.flatnonzero(np.append(True, get["cell"][1:] != get["cell"][:-1]))
        end = np.append(start[1:], len(order))
        at = {key: v for v, key in enumerate(zip(*(get[c][start].tolist() for c in IJK)))}
        own, ids = get["own"][start], get["cell"][start]
        low, high = (np.column_stack([get[f"{w}{c}"] for c in XYZ]) for w in ("lo", "hi"))
        lows, highs = ([v[s:e] for s, e in zip(start, end)] for v in (low, high))
        up = list(range(len(start)))

        def root(v: int) -> int:
            while up[v] != v:
                up[v] = up[up[v]]
                v = up[v]
            return v

        open_pairs = []
        for di, dj, dk in OFFSETS:
            for (i, j, k), v in at.items():
                u = at.get((i + di, j + dj, k + dk))
                if u is None or not (own[u] or own[v]):
                    continue
                a, b = root(u), root(v)
                if a != b:
                    sure, maybe = near_boxes(lows[u], highs[u], lows[v], highs[v], limit)
                    if sure:
                        up[max(a, b)] = min(a, b)
                    elif maybe:
                        open_pairs.append((u, v))
        out = [(ids[v], ids[root(v)], True) for v in range(len(up)) if root(v) != v]
        out += [(ids[u], ids[v], False) for u, v in open_pairs if root(u) != root(v)]
        cell, other, sure = zip(*out) if out else ((), (), ())
        return pa.table([pa.array(cell, pa.int64()), pa.array(other, pa.int64()), pa.array(sure, pa.bool_())], schema=schema)

    return run


def _parts(nodes: DataFrame, cells: DataFrame, parts: int) -> DataFrame:
    """Boxes around the points of each part of a cell: cell, parts u, v, w along the axes, bounds.

    Parts are counted from the cell's least coordinates, so they are exact wherever the cell lies.
    """
    placed = nodes.join(cells.select(*[F.col(n).alias(f"_{n}") for n in IJK], "cell", "width", *[F.col(f"lo{c}").alias(f"_lo{c}") for c in XYZ]), _same_cell())
    part = {p: F.least(F.floor((F.col(c) - F.col(f"_lo{c}")) / F.col("width") * parts), F.lit(parts - 1)) for p, c in zip("uvw", XYZ)}
    part = {p: F.when(F.col("width") > 0, x).otherwise(F.lit(0)).cast("long") for p, x in part.items()}
    return placed.withColumns(part).groupBy("cell", *part).agg(*[f(c).alias(f"{w}{c}") for c in XYZ for w, f in (("lo", F.min), ("hi", F.max))])


def _same_cell() -> Column:
    return (F.col("i") == F.col("_i")) & (F.col("j") == F.col("_j")) & (F.col("k") == F.col("_k"))


def _settled(nodes: DataFrame, cells: DataFrame, pairs: DataFrame, eps: float) -> DataFrame:
    """Of pairs of cells, those with two points within eps: cell, other.

    Boxes are halved along each axis, round by round. A pair is linked once
    two boxes lie within eps as a whole; two boxes further apart than eps are
    left out. Boxes shrink to single points, or to what doubles can tell apart, so
    the rounds end, and only points of boxes that still matter are summed up.
    """
    limit = F.lit(eps * eps * (1 + 1e-12))
    wide = F.greatest(*[F.col(f"hi{c}") - F.col(f"lo{c}") for c in XYZ])
    asked = pairs.select("cell").unionAll(pairs.select(F.col("other").alias("cell"))).distinct()
    mine = written(cells.join(asked, "cell", "left_semi").select(*IJK, "cell", wide.alias("width"), *[f"lo{c}" for c in XYZ]))
    points = written(nodes.join(mine.select(*[F.col(n).alias(f"_{n}") for n in IJK]), _same_cell(), "left_semi"))
    live = pairs.select("cell", "other", *[F.lit(0).cast("long").alias(f"{s}{p}") for s in "ab" for p in "uvw"])
    linked, parts = None, 1
    while True:
        parts *= 2
        boxes = _parts(points, mine, parts)
        if parts > 2:  # only parts of boxes that still matter
            of = live.select("cell", *[F.col(f"a{p}").alias(f"_{p}") for p in "uvw"]).unionAll(live.select("other", *[F.col(f"b{p}") for p in "uvw"])).distinct().withColumnRenamed("cell", "_cell")
            boxes = boxes.join(of, (F.col("cell") == F.col("_cell")) & (F.floor(F.col("u") / 2) == F.col("_u")) & (F.floor(F.col("v") / 2) == F.col("_v")) & (F.floor(F.col("w") / 2) == F.col("_w")), "left_semi")
        boxes = written(boxes)
        side = lambda s: boxes.select(*[F.col(c).alias(f"{s}_{c}") for c in boxes.columns])
        meets = lambda s, cell: (F.col(cell) == F.col(f"{s}_cell")) & (F.floor(F.col(f"{s}_u") / 2) == F.col(f"{s}u")) & (F.floor(F.col(f"{s}_v") / 2) == F.col(f"{s}v")) & (F.floor(F.col(f"{s}_w") / 2) == F.col(f"{s}w"))
        both = live.join(side("a"), meets("a", "cell")).join(side("b"), meets("b", "other"))
        gaps = [F.greatest(F.lit(0.0), F.col(f"a_lo{c}") - F.col(f"b_hi{c}"), F.col(f"b_lo{c}") - F.col(f"a_hi{c}")) for c in XYZ]
        reaches = [F.greatest(F.col(f"a_hi{c}") - F.col(f"b_lo{c}"), F.col(f"b_hi{c}") - F.col(f"a_lo{c}")) for c in XYZ]
        tested = written(both.where(sum((g * g for g in gaps), F.lit(0.0)) <= limit).select("cell", "other", *[F.col(f"{s}_{p}").alias(f"{s}{p}") for s in "ab" for p in "uvw"], ((sum((r * r for r in reaches), F.lit(0.0)) <= limit) | F.lit(parts >= 1 << 52)).alias("sure")))
        sure = tested.where("sure").select("cell", "other").distinct()
        linked = sure if linked is None else linked.unionAll(sure)
        live = tested.join(sure.select(F.col("cell").alias("_c"), F.col("other").alias("_o")), (F.col("cell") == F.col("_c")) & (F.col("other") == F.col("_o")), "left_anti").drop("sure")
        dropped(boxes)
        if live.isEmpty():
            return linked


def linked_cells(nodes: DataFrame, cells: DataFrame, eps: float) -> DataFrame:
    """Group of each cell: cells joined by pairs of points within ``eps``. Output: cell, group_id.

    Each leaf is linked on its own, together with the cells of later leaves
    next to it; so every pair of cells is looked at once. Links of all leaves
    are joined as connected components. Pairs of cells that the boxes leave
    open and nothing else joins are settled by smaller boxes.
    """
    # Leaves that have a cell in a block of four cells a side: a cell goes to the earlier ones of the blocks within its reach.
    block = lambda n, d=0: F.floor((F.col(n) + d) / 4)
    of_block = cells.select(*[block(n).alias(f"b{n}") for n in IJK], F.col("leaf").alias("to")).distinct()
    reach = F.explode(F.array_distinct(F.array(*[F.struct(*[block(n, d).alias(f"b{n}") for n, d in zip(IJK, o)]) for o in ((a, b, c) for a in (-2, 2) for b in (-2, 2) for c in (-2, 2))])))
    border = cells.select("cell", "leaf", reach.alias("b")).select("cell", "leaf", "b.*").join(of_block, [f"b{n}" for n in IJK]).where("to < leaf").select("cell", F.col("to").alias("leaf")).distinct()
    spread = written(cells.select("cell", "leaf", F.lit(True).alias("own")).unionAll(border.select("cell", "leaf", F.lit(False).alias("own"))))
    side = cells.withColumn("width", F.lit(_side(eps)))
    boxes = _parts(nodes, side, PARTS).join(cells.select(F.col("cell").alias("_c"), *IJK), F.col("cell") == F.col("_c")).drop("_c", "u", "v", "w")
    given = boxes.join(spread.withColumnRenamed("cell", "_c"), F.col("cell") == F.col("_c")).drop("_c")
    columns = ["cell", "own", *IJK, *(f"{w}{c}" for c in XYZ for w in ("lo", "hi"))]
    links = written(given.groupBy("leaf").applyInArrow(lambda table: _link_leaf(eps)(table.select(columns)), LINKED))
    sure = links.where("sure").select("cell", "other")
    groups = connected_components(sure)
    open_pairs = links.where("not sure").select("cell", "other").distinct()
    for end in ("cell", "other"):
        open_pairs = open_pairs.join(groups.select(F.col("vertex").alias(f"v_{end}"), F.col("component").alias(f"g_{end}")), F.col(end) == F.col(f"v_{end}"), "left")
    open_pairs = written(open_pairs.where("coalesce(g_cell, cell) <> coalesce(g_other, other)").select("cell", "other"))
    if not open_pairs.isEmpty():
        groups = connected_components(sure.unionAll(_settled(nodes, cells, open_pairs, eps)))
    return cells.select("cell").join(groups, F.col("cell") == F.col("vertex"), "left").select("cell", F.coalesce("component", "cell").alias("group_id"))


def _leaves(neurons: DataFrame, eps: float, limits: dict) -> tuple[DataFrame, DataFrame]:
    nodes = written(located(neurons, eps))
    return nodes, written(bisect(cell_sums(nodes), **limits))


def distance_groups(neurons: DataFrame, eps: float = 60.0, least: int = 40, **limits) -> tuple[DataFrame, DataFrame]:
    """Groups of nodes linked by chains of steps of at most ``eps``, with ``least`` nodes or more.

    Returns the located nodes and the table i, j, k, group_id, group_size of
    the cells in a group. Nodes without coordinates are in no group; repeats
    count once.
    """
    nodes, cells = _leaves(neurons, eps, limits)
    grouped = written(cells.join(linked_cells(nodes, cells, eps), "cell").select(*IJK, "n", F.col("group_id").alias("g")))
    sizes = grouped.groupBy("g").agg(F.sum("n").alias("group_size"), F.concat_ws(" ", F.min(F.struct(*IJK)).getField("i"), *[F.min(F.struct(*IJK)).getField(n) for n in "jk"]).alias("group_id")).where(F.col("group_size") >= least)
    return nodes, written(grouped.join(sizes, "g").select(*IJK, "group_id", "group_size"))


def _placed(nodes: DataFrame, cells: DataFrame, *columns: str) -> DataFrame:
    """Nodes with columns of their cell; Spark broadcasts the cells if their size allows."""
    return nodes.join(cells.select(*[F.col(n).alias(f"_{n}") for n in IJK], *columns), _same_cell()).drop(*[f"_{n}" for n in IJK])


def probe_pairs(neurons: DataFrame, probes: DataFrame, eps: float = 60.0, least: int = 40, **limits) -> DataFrame:
    """Pairs of probes whose nodes lie in one group. Output: probe_a, probe_b (smaller first)."""
    nodes, groups = distance_groups(neurons, eps, least, **limits)
    asked = probes.where("probe_id is not null").select(F.col("file_id").alias("pf"), F.col("node_id").alias("pn"), "probe_id")
    placed = _placed(nodes.join(asked, (F.col("file_id") == F.col("pf")) & (F.col("node_id") == F.col("pn"))), groups, "group_id").select("probe_id", "group_id").distinct()
    other = placed.select(F.col("probe_id").alias("probe_b"), F.col("group_id").alias("g"))
    return placed.join(other, (F.col("group_id") == F.col("g")) & (F.col("probe_id") < F.col("probe_b"))).select(F.col("probe_id").alias("probe_a"), "probe_b").distinct()


def node_groups(neurons: DataFrame, eps: float = 60.0, least: int = 40, **limits) -> DataFrame:
    """Each node's group. Output: file_id, node_id, group_id, group_size; nodes of no group are left out.

    A group is named by its least cell.
    """
    nodes, groups = distance_groups(neurons, eps, least, **limits)
    return _placed(nodes, groups, "group_id", "group_size").select("file_id", "node_id", "group_id", "group_size")


def clusters(neurons: DataFrame, typical: int = 3, eps: float = 60.0, **limits) -> DataFrame:
    """Leaves of bisecting k-means: size, centre, radius and the nodes nearest to the centre.

    Nodes without coordinates are in no cluster; repeats count once; ties at
    the same distance go by key. The nearest are found by a limited ranking,
    which keeps ``typical`` rows a leaf and task before the shuffle. Output:
    cluster, n_nodes, cx, cy, cz, radius, rank, file_id, node_id, distance.
    """
    nodes, cells = _leaves(neurons, eps, limits)
    square = sum((F.sum(f"q{c}") - F.sum(f"s{c}") * F.sum(f"s{c}") / F.sum("n") for c in XYZ), F.lit(0.0)) / F.sum("n")
    centres = cells.groupBy(F.col("leaf").alias("cluster")).agg(F.sum("n").alias("n_nodes"), *[(F.sum(f"s{c}") / F.sum("n")).alias(f"c{c}") for c in XYZ], F.sqrt(F.greatest(F.lit(0.0), square)).alias("radius"))
    away = F.sqrt(sum(((F.col(c) - F.col(f"c{c}")) * (F.col(c) - F.col(f"c{c}")) for c in XYZ), F.lit(0.0)))
    measured = _placed(nodes, cells, "leaf").join(centres, F.col("leaf") == F.col("cluster")).withColumn("distance", away)
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy("distance", "file_id", "node_id"))
    return measured.withColumn("rank", rank).where(F.col("rank") <= typical).select("cluster", "n_nodes", "cx", "cy", "cz", "radius", "rank", "file_id", "node_id", "distance")


def node_clusters(neurons: DataFrame, eps: float = 60.0, **limits) -> DataFrame:
    """Each node's cluster. Output: file_id, node_id, cluster."""
    nodes, cells = _leaves(neurons, eps, limits)
    return _placed(nodes, cells, "leaf").select("file_id", "node_id", F.col("leaf").alias("cluster"))
