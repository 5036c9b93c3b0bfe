"""Parent-child links to full hierarchies: cycles, roots, depths, paths, intervals.

Nodes are dealt into blocks of at most about ``CAP`` ids of one file; a small
file is one block. Every block goes through the same two steps. Leaves are
peeled, so that loops are left. Then the Euler tours of the forest are linked
and ranked by pointer jumping. Where a link leaves a block it goes to a
*portal*; the portals form a contracted list, which is ranked by the same
means in blocks of its own. So no task ever holds more than ``CAP`` links,
whatever a file's size, and only portals are exchanged between blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.runtime import arrow_schema, dropped, written

#: Most links that one task resolves at once, on average.
CAP = 100_000
NONE = np.iinfo(np.int64).max
LINKS = "g string, id long, nxt long, w long, m long, last long, cycle long"
PATHS = ", path array<long>"
#: Rows of a block's result. kind 0: a node; kind 1: a portal of the contracted chains; kind 2: a vertex of the contracted tours.
CHAINS = "kind int, file_id string, node_id long, up long, m long, cycle long"
TOURS = "kind int, file_id string, node_id long, parent_id int, enter long, enter_to long, leave long, leave_to long, root long, looped boolean, up long, m long, cycle long, path array<int>"
#: Preorder ranks that share a block of the interval join.
RANKS = 1024


def peel(parent: np.ndarray, held: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Peel leaves off a forest with loops: levels from the leaves, and what remains.

    Nodes marked in ``held`` have children elsewhere and are never leaves; what
    remains are the loops, the held nodes and all that is above them.
    """
    left = np.bincount(parent[parent >= 0], minlength=len(parent))
    if held is not None:
        left = left + held
    levels, front = [], np.flatnonzero(left == 0)
    peeled = np.zeros(len(parent), bool)
    while front.size:
        levels.append(front)
        peeled[front] = True
        up = parent[front]
        up, n = np.unique(up[up >= 0], return_counts=True)
        left[up] -= n
        front = up[left[up] == 0]
    return levels, np.flatnonzero(~peeled)


def rank_lists(before: np.ndarray, weight: np.ndarray, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """Parallel list ranking by pointer jumping.

    ``before`` is the item before each one, -1 at the head of a list. Gives the
    weight from the head up to each item, the head, whether there is none (the
    item is on a loop or behind one), and the least of ``least`` on the way, or
    of the loop.
    """
    n = len(before)
    jump = np.append(np.where(before < 0, n, before), n)
    total, head = np.append(weight.astype(np.int64), 0), np.append(np.arange(n), n)
    low = None if least is None else np.append(least, NONE)
    for _ in range(n.bit_length() + 1):
        if not (jump[:n] < n).any():
            break
        total, head = total + total[jump], np.where(jump < n, head[jump], head)
        if low is not None:
            low = np.minimum(low, low[jump])
        jump = jump[jump]
    looped = jump[:n] < n
    if low is not None:
        low = np.where(looped, low[jump[:n]], low[:n])
    return total[:n], head[:n], looped, low


def packed(steps: np.ndarray | int, rise: np.ndarray | int):
    """Steps and the rise of depth on them in one number, so that one sum adds up both."""
    return steps * (1 << 32) + rise


class Block:
    """Nodes of some (file, block) pairs, each once, with what is known of other blocks.

    Rows of kind 0 are nodes, of kind 1 runs of children in another block of a
    node here (first and last child), of kind 2 parents in another block.
    """

    def __init__(self, table: pa.Table):
        names = table.column("file_id").combine_chunks().dictionary_encode()
        self.names = names.dictionary
        blocks = table.column("block").to_numpy()
        code = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        _, code_block = np.unique(np.column_stack([code, blocks]), axis=0, return_inverse=True)
        code_block = code_block.reshape(-1).astype(np.int64)
        kind = table.column("kind").to_numpy()
        ids = table.column("node_id").to_numpy().astype(np.int64)
        parents = pc.fill_null(table.column("parent_id"), -1).to_numpy().astype(np.int64)
        key = code_block << 33 | (ids + (1 << 31))
        mine = np.flatnonzero(kind == 0)
        mine = mine[np.argsort(key[mine], kind="stable")]
        self.file, self.id, self.given, self.key = code[mine], ids[mine], parents[mine], key[mine]
        wanted = code_block[mine] << 33 | (self.given + (1 << 31))
        self.parent = self._find(wanted, self.given != -1)
        away = np.sort(key[kind == 2])
        at = np.minimum(np.searchsorted(away, wanted), max(len(away) - 1, 0))
        self.away = (away[at] == wanted) & (self.given != -1) & (self.parent < 0) if len(away) else np.zeros(len(mine), bool)
        self.wanted = wanted
        runs = np.flatnonzero(kind == 1)
        self.run_of = self._find(key[runs], np.ones(len(runs), bool))
        self.run_file, self.run_key = code[runs], key[runs]
        self.run_first = pc.fill_null(table.column("first"), 0).to_numpy()[runs]
        self.run_last = pc.fill_null(table.column("last"), 0).to_numpy()[runs]

    def _find(self, wanted: np.ndarray, ask: np.ndarray) -> np.ndarray:
        if not len(self.key):
            return np.full(len(wanted), -1)
        at = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
        return np.where(ask & (self.key[at] == wanted), at, -1)

    def held(self) -> np.ndarray:
        """Nodes with children in other blocks."""
        out = np.zeros(len(self.id), np.int64)
        out[self.run_of[self.run_of >= 0]] = 1
        return out

    def ancestry(self) -> tuple[np.ndarray, ...]:
        """By peeling: per node the top of its chain here, the least id on the way and that of the loop it ends in.

        Only what is left of the peeling is ranked; peeled leaves take over
        what their parents have.
        """
        held = self.held()
        levels, core = peel(self.parent, held)
        top, low, cycle = np.arange(len(self.id)), self.id.copy(), np.full(len(self.id), NONE)
        if core.size:
            slot = np.full(len(self.id) + 1, -1)
            slot[core] = np.arange(len(core))
            up = self.parent[core]
            _, head, looped, least = rank_lists(np.where(up >= 0, slot[up], -1), np.ones(len(core), np.int64), self.id[core])
            top[core], low[core], cycle[core] = core[head], least, np.where(looped, least, NONE)
        for front in reversed(levels):
            up = self.parent[front]
            inner, p = front[up >= 0], up[up >= 0]
            top[inner], cycle[inner] = top[p], cycle[p]
        return top, low, cycle, held

    def tour(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict]:
        """Links of the Euler tours, from each item to the one before it.

        Item v enters node v, n + v leaves it, 2n + r stands for what comes
        before run r of children that lie elsewhere. Siblings follow by id.
        Gives the item before (-1: none here), the vertex elsewhere that comes
        before (-1: none), the weights, and the ends of the runs that lie here.

        Vertices are named within a file: 2c what comes before a run whose
        first child is c, 2c + 1 the leaving of a run's last child c.
        """
        n, m = len(self.id), len(self.run_of)
        before, far = np.full(2 * n + m, -1), np.full(2 * n + m, -1)
        has = np.flatnonzero((self.parent >= 0) | self.away)
        known = np.flatnonzero(self.run_of >= 0)
        group = np.concatenate([self.wanted[has], self.run_key[known]])
        order = np.concatenate([self.id[has], self.run_first[known]])
        by = np.lexsort((order, group))
        group = group[by]
        entry = np.concatenate([has, 2 * n + known])[by]  # what follows the one before: entering a child, or a run
        leave = np.concatenate([n + has, np.full(len(known), -1)])[by]
        beyond = np.concatenate([np.full(len(has), -1), 2 * self.run_last[known] + 1])[by]
        first = np.append(True, group[1:] != group[:-1]) if len(group) else np.zeros(0, bool)
        final = np.append(first[1:], True) if len(group) else first
        local = np.concatenate([self.parent[has], self.run_of[known]])[by]
        rest = np.flatnonzero(~first)
        before[entry[rest]], far[entry[rest]] = leave[rest - 1], beyond[rest - 1]
        start = np.flatnonzero(first)
        inner = start[local[start] >= 0]
        before[entry[inner]] = local[inner]
        outer = start[local[start] < 0]  # a run of ours: its parent's block tells what comes before
        far[entry[outer]] = 2 * self.id[entry[outer]]
        before[n : 2 * n] = np.arange(n)  # a leaf is left at once
        end = np.flatnonzero(final)
        closed = end[local[end] >= 0]
        before[n + local[closed]], far[n + local[closed]] = leave[closed], beyond[closed]
        ours = end[local[end] < 0]
        weight = np.concatenate([np.full(n, packed(1, 1)), np.full(n, packed(1, -1)), np.zeros(m, np.int64)])
        return before, far, weight, {"leaves": leave[ours], "runs": 2 * n + known}


def _strings(b: Block, codes: np.ndarray) -> pa.Array:
    return pa.DictionaryArray.from_arrays(pa.array(codes), b.names).cast(pa.string())


def _known(values: np.ndarray, ok: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    return pa.array(np.where(ok, values, 0), kind or pa.int64(), mask=~ok)


def _chains(table: pa.Table) -> pa.Table:
    """Ancestry of a block: nodes whose chain goes on elsewhere or ends in a loop, and the portals' links."""
    b = Block(table)
    top, low, cycle, held = b.ancestry()
    goes = b.away[top] & (cycle == NONE)
    node, portal = np.flatnonzero(goes | (cycle != NONE)), np.flatnonzero(held)
    rows = np.concatenate([node, portal])
    return pa.table(
        [
            pa.array(np.repeat([0, 1], [len(node), len(portal)]), pa.int32()), _strings(b, b.file[rows]), pa.array(b.id[rows]),
            _known(b.given[top[rows]], goes[rows]), pa.array(low[rows]), _known(cycle[rows], cycle[rows] != NONE),
        ],
        schema=arrow_schema(CHAINS),
    )


def _local_paths(b: Block, ok: np.ndarray) -> pa.Array:
    """Path of each of these nodes from the top of its chain in this block, built upwards for all nodes at once."""
    steps = rank_lists(b.parent, np.ones(len(b.id), np.int64))[0][ok]
    end = np.cumsum(steps)
    out, at = np.zeros(int(end[-1]) if len(end) else 0, np.int32), ok.copy()
    place, live = end - 1, np.arange(len(ok))
    while live.size:
        out[place[live]] = b.id[at[live]]
        at[live] = b.parent[at[live]]
        place[live] -= 1
        live = live[at[live] >= 0]
    return pa.ListArray.from_arrays(pa.array(np.append(0, end), pa.int32()), pa.array(out))


def _tours(paths: bool):
    schema = arrow_schema(TOURS)

    def run(table: pa.Table) -> pa.Table:
        """Euler tours of a block: steps up to each node's entering and leaving, its ancestry, and what is contracted."""
        b = Block(table)
        n = len(b.id)
        top, low, cycle, held = b.ancestry()
        goes, fine = b.away[top] & (cycle == NONE), cycle == NONE
        before, far, weight, ends = b.tour()
        total, head, looped, _ = rank_lists(before, weight)
        to = np.where(looped, -1, far[head])
        inside = ~looped & (to == -1) & (head < n)
        root = np.zeros(len(head), np.int64)
        root[inside] = b.id[head[inside]]
        vertex = np.concatenate([ends["runs"], ends["leaves"]])
        name = np.concatenate([2 * b.run_first[ends["runs"] - 2 * n], 2 * b.id[ends["leaves"] - n] + 1])
        portal, node = np.flatnonzero(held), np.arange(n)
        a, z = np.concatenate([node, portal, vertex]), np.concatenate([n + node, n + portal, vertex])
        more, rows = len(vertex), np.concatenate([node, portal])
        pad = lambda v, none=0: np.concatenate([v[rows], np.full(more, none, v.dtype)])
        lists = pa.nulls(len(a), pa.list_(pa.int32()))
        if paths:
            ok = rows[fine[rows]]
            made, at = _local_paths(b, ok), np.full(len(a), -1)
            at[np.flatnonzero(fine[rows])] = np.arange(len(ok))
            lists = made.take(_known(at, at >= 0))
        return pa.table(
            [
                pa.array(np.repeat([0, 1, 2], [n, len(portal), more]), pa.int32()), _strings(b, np.concatenate([b.file[rows], b.run_file[ends["runs"] - 2 * n], b.file[ends["leaves"] - n]])),
                pa.array(np.concatenate([b.id[rows], name])), pa.array(pad(b.given), pa.int32()), pa.array(total[a]), _known(to[a], to[a] != -1), pa.array(total[z]), _known(to[z], to[z] != -1),
                _known(root[a], inside[a]), pa.array(looped[a]), _known(pad(b.given[top]), pad(goes)), pa.array(pad(low)), _known(pad(cycle), pad(cycle, NONE) != NONE), lists,
            ],
            schema=schema,
        )

    return run


def _contract_block(paths: bool):
    schema = arrow_schema(LINKS + PATHS * paths)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        get = lambda c, none: pc.fill_null(table.column(c), none).to_numpy()
        ids, nxt, w, m, tail, known = get("id", 0), get("nxt", 0), get("w", 0), get("m", 0), get("last", 0), get("cycle", NONE)
        has = pc.is_valid(table.column("nxt")).to_numpy() & (known == NONE)
        at = np.minimum(np.searchsorted(ids, nxt), len(ids) - 1)
        local = np.where(has & (ids[at] == nxt), at, -1)
        total, last, looped, least = rank_lists(local, w, m)
        cycle = np.where(looped, least, known[np.where(looped, 0, last)])
        out_of = has[last] & (cycle == NONE)
        columns = [
            table.column("g"), pa.array(ids), pa.array(nxt[last], mask=~out_of), pa.array(total), pa.array(least),
            pa.array(tail[last], mask=cycle != NONE), pa.array(cycle, mask=cycle == NONE),
        ]
        if paths:
            inner = np.where(cycle == NONE, local, -1)
            own, made, steps = table.column("path").to_pylist(), [None] * len(ids), rank_lists(inner, np.ones(len(ids), np.int64))[0]
            for v in np.argsort(steps, kind="stable").tolist():
                if cycle[v] == NONE:
                    made[v] = own[v] if inner[v] < 0 else own[v] + made[inner[v]]
            columns.append(pa.array(made, pa.list_(pa.int64())))
        return pa.table(columns, schema=schema)

    return run


def _inner(run, columns: list[str]):
    return lambda table: run(table.select(columns))


def _spans(rows: DataFrame, g: str, id: str, cap: int) -> DataFrame:
    """Low end and width of the blocks of each group; a group of at most cap rows is one block."""
    spans = rows.groupBy(g).agg(F.count(F.lit(1)).alias("n"), F.min(id).cast("long").alias("low"), F.max(id).cast("long").alias("high"))
    # A span of ids holds cap items on average, and at most its width.
    width = F.greatest(F.lit(cap), F.least(F.lit(4 * cap), F.floor(F.lit(cap) * (F.col("high") - F.col("low") + 1) / F.col("n"))))
    return spans.select(F.col(g).alias("sg"), "n", "low", F.when(F.col("n") > cap, width).alias("width"))


def resolve_links(links: DataFrame, cap: int = CAP, paths: bool = False, before: int | None = None) -> DataFrame:
    """Follow ``nxt`` from every item of every group ``g`` to the end.

    Gives per item the last item of its chain (``last``), the weight from it
    to the end (both included), its path of items if asked for, or the least
    ``m`` of the loop that its chain ends in (``cycle``). A ``nxt`` that is
    null or no item ends a chain.

    Blocks of at most ``cap`` ids are contracted on their own. What other
    blocks refer to are the only links left; they are resolved by the same
    function, in wider blocks, or by jumps of all links at once when blocks
    hardly shorten them (ids without any order).
    """
    extra = ["path"] if paths else []
    columns = ["g", "id", "nxt", "w", "m", "last", "cycle", *extra]
    placed = links.join(_spans(links, "g", "id", cap).drop("n"), F.col("g") == F.col("sg")).withColumn("block", F.coalesce(F.floor((F.col("id") - F.col("low")) / F.col("width")), F.lit(0)))
    done = written(placed.groupBy("g", "block").applyInArrow(_inner(_contract_block(paths), columns), LINKS + PATHS * paths).select(*columns))
    asked = done.where("nxt is not null").select(F.col("g").alias("rg"), F.col("nxt").alias("rid")).distinct()
    left = written(done.join(asked, (F.col("g") == F.col("rg")) & (F.col("id") == F.col("rid")), "left_semi"))
    n = left.count()
    if n == 0:
        return done.withColumn("nxt", F.lit(None).cast("long"))
    if before is not None and n > 0.7 * before:
        rest = _jump(left, paths)
    else:
        rest = resolve_links(left, cap, paths, n)
    rest = rest.select(F.col("g").alias("rg"), F.col("id").alias("rid"), F.col("w").alias("rw"), F.col("last").alias("rlast"), F.col("cycle").alias("rcycle"), *[F.col(c).alias("rpath") for c in extra])
    joined = done.join(rest, (F.col("g") == F.col("rg")) & (F.col("nxt") == F.col("rid")), "left")
    ends = F.coalesce("cycle", "rcycle")
    return joined.select(
        "g", "id", F.lit(None).cast("long").alias("nxt"), (F.col("w") + F.coalesce("rw", F.lit(0))).alias("w"), "m",
        F.when(ends.isNull(), F.coalesce("rlast", "last")).alias("last"), ends.alias("cycle"),
        *[F.when(ends.isNull(), F.concat("path", F.coalesce("rpath", F.array().cast("array<long>")))).alias("path") for _ in extra],
    )


def _jump(links: DataFrame, paths: bool) -> DataFrame:
    """Pointer jumping over all links at once, a join a round; the lineage is cut each round."""
    n = links.count()
    for _ in range(n.bit_length() + 1):
        if links.where("nxt is not null").isEmpty():
            return links
        far = links.select(F.col("g").alias("rg"), F.col("id").alias("rid"), F.col("nxt").alias("rnxt"), F.col("w").alias("rw"), F.col("m").alias("rm"), F.col("last").alias("rlast"), F.col("cycle").alias("rcycle"), *([F.col("path").alias("rpath")] if paths else []))
        joined = links.join(far, (F.col("g") == F.col("rg")) & (F.col("nxt") == F.col("rid")), "left")
        step = written(joined.select(
            "g", "id", F.col("rnxt").alias("nxt"), (F.col("w") + F.coalesce("rw", F.lit(0))).alias("w"), F.least("m", "rm").alias("m"),
            F.coalesce("rlast", "last").alias("last"), F.coalesce("cycle", "rcycle").alias("cycle"),
            *([F.concat("path", F.coalesce("rpath", F.array().cast("array<long>"))).alias("path")] if paths else []),
        ))
        dropped(links)
        links = step
    # What still goes on is on a loop or below it; nxt is on the loop, and m covers all of it.
    far = links.select(F.col("g").alias("rg"), F.col("id").alias("rid"), F.col("m").alias("rm"))
    joined = links.join(far, (F.col("g") == F.col("rg")) & (F.col("nxt") == F.col("rid")), "left")
    return joined.select("g", "id", F.lit(None).cast("long").alias("nxt"), "w", "m", F.when(F.col("nxt").isNull(), F.col("last")).alias("last"), F.coalesce("cycle", "rm").alias("cycle"), *(["path"] if paths else []))


class Forest:
    """Distinct nodes in their blocks, with the links between blocks.

    ``rows`` are the input of the block tasks: nodes, and what a block must
    know of others. ``buckets`` of small files share a task; each block of a
    large file has its own.
    """

    COLUMNS = ("kind", "file_id", "block", "node_id", "parent_id", "first", "last")

    def __init__(self, neurons: DataFrame, cap: int):
        named = neurons.where(F.col("file_id").isNotNull() & F.col("node_id").isNotNull())
        spans = written(_spans(named, "file_id", "node_id", cap))  # one row a file
        seen = spans.agg(F.sum("n"), F.count("width")).first()
        self.cap, self.buckets, self.split = cap, max(1, -(-(seen[0] or 0) // cap)), bool(seen[1])
        nodes = named.groupBy("file_id", "node_id").agg(F.min("parent_id").alias("parent_id"))
        blank = lambda c, t: F.lit(None).cast(t).alias(c)
        if not self.split:
            self.rows = nodes.select(F.lit(0).alias("kind"), "file_id", F.lit(0).cast("long").alias("block"), "node_id", "parent_id", blank("first", "long"), blank("last", "long"))
            return
        block = lambda c: F.coalesce(F.floor((F.col(c) - F.col("low")) / F.col("width")), F.lit(0))
        wide = spans.where("width is not null").select("sg", "low", "width")
        placed = nodes.join(wide, F.col("file_id") == F.col("sg"), "left").select("file_id", block("node_id").alias("block"), "node_id", "parent_id", F.when(F.col("parent_id") != -1, block("parent_id")).alias("over"))
        placed = written(placed)
        # Runs of children by parent and block, where those are not in one block; parents that are no node have none.
        runs = placed.where("over <> block").groupBy("file_id", F.col("parent_id").alias("p"), "over", "block").agg(F.min("node_id").alias("first"), F.max("node_id").alias("last"))
        own = placed.select(F.col("file_id").alias("nf"), F.col("node_id").alias("nn"))
        runs = written(runs.join(own, (F.col("file_id") == F.col("nf")) & (F.col("p") == F.col("nn")), "left_semi"))
        long = lambda c: F.col(c).cast("long").alias(c)
        inner = placed.select(F.lit(0).alias("kind"), "file_id", "block", "node_id", "parent_id", blank("first", "long"), blank("last", "long"))
        below = runs.select(F.lit(1).alias("kind"), "file_id", F.col("over").alias("block"), F.col("p").alias("node_id"), blank("parent_id", "int"), long("first"), long("last"))
        above = runs.select(F.lit(2).alias("kind"), "file_id", "block", F.col("p").alias("node_id"), blank("parent_id", "int"), blank("first", "long"), blank("last", "long"))
        self.rows = inner.unionAll(below).unionAll(above)

    def run(self, task, schema: str) -> DataFrame:
        # Twice as many buckets as needed, so that one holds about half of cap.
        bucket = F.pmod(F.xxhash64("file_id", "block"), F.lit(2 * self.buckets))
        return self.rows.groupBy(bucket.alias("bucket")).applyInArrow(_inner(task, list(self.COLUMNS)), schema)


def _portals(chains: DataFrame, cap: int, paths: bool = False) -> DataFrame:
    """Contracted chains of the portals, resolved: g, id, cycle, and the path from a portal up to its root."""
    links = chains.where("kind = 1").select(
        F.col("file_id").alias("g"), F.col("node_id").alias("id"), F.col("up").alias("nxt"), F.lit(1).cast("long").alias("w"), "m", F.col("node_id").alias("last"), "cycle",
        *([F.reverse("path").cast("array<long>").alias("path")] if paths else []),
    )
    return resolve_links(links, cap, paths)


def cyclic_nodes(neurons: DataFrame, cap: int = CAP) -> DataFrame:
    """Nodes on a loop of parents or below one, with the loop's least node.

    A parent that is -1, null or not in the file ends a chain. Rows with a
    null ``file_id`` or ``node_id`` name no node; repeats of a node count once
    (its least parent stands). Other columns are ignored; an empty table gives
    no rows. Output: file_id, node_id, cycle_node_id.
    """
    forest = Forest(neurons, cap)
    chains = forest.run(_chains, CHAINS)
    if forest.split:
        chains = written(chains)
    key = ("file_id", F.col("node_id").cast("int").alias("node_id"))
    found = chains.where("kind = 0 and cycle is not null").select(*key, F.col("cycle").cast("int").alias("cycle_node_id"))
    if not forest.split:
        return found
    far = _portals(chains, cap).where("cycle is not null").select("g", "id", F.col("cycle").alias("there"))
    below = chains.where("kind = 0 and up is not null").join(far, (F.col("file_id") == F.col("g")) & (F.col("up") == F.col("id")))
    return found.unionAll(below.select(*key, F.col("there").cast("int").alias("cycle_node_id")))


def _through(rows: DataFrame, to: str, far: DataFrame, values: dict) -> DataFrame:
    """Rows whose link leads to a vertex elsewhere take over what is known there; the others stay as they are."""
    joined = rows.where(f"{to} is not null").join(far, (F.col("file_id") == F.col("g")) & (F.col(to) == F.col("id")), "left")
    return rows.where(f"{to} is null").unionAll(joined.withColumns(values).select(*rows.columns))


def hierarchies(neurons: DataFrame, cap: int = CAP, paths: bool = True) -> DataFrame:
    """Root, depth, full path, entry and exit of every node, by Euler tours.

    ``entry`` and ``exit`` number the steps of the tour of a node's tree (root
    0 to 2n - 1): v descends from u in the same tree just when u.entry <
    v.entry < u.exit. Depth and number of descendants follow from them, as
    does ``preorder``, the node's number among its tree's entries. ``path``
    runs from the root to the node. Nodes on or below a loop have
    ``cycle_node_id`` and nulls for the rest. Input rules as for
    ``cyclic_nodes``. Output: file_id, node_id, parent_id (-1: none), root_id,
    depth, entry, exit, preorder, n_descendants, cycle_node_id, path.
    """
    forest = Forest(neurons, cap)
    tours = forest.run(_tours(paths), TOURS)
    steps = lambda c: F.shiftright(c + F.lit(1 << 31), 32)
    rise = lambda c: c - F.shiftleft(steps(c), 32)
    nodes = tours.where("kind = 0")
    if forest.split:
        tours = written(tours)
        lists = tours.where("kind = 2").select(
            F.col("file_id").alias("g"), F.col("node_id").alias("id"), F.col("enter_to").alias("nxt"), F.col("enter").alias("w"), F.col("node_id").alias("m"),
            F.col("root").alias("last"), F.when(F.col("looped"), F.lit(1)).cast("long").alias("cycle"),
        )
        ranked = written(resolve_links(lists, cap).select("g", "id", F.col("w").alias("fw"), F.col("last").alias("froot"), F.col("cycle").isNotNull().alias("floop")))
        up = written(_portals(tours, cap, paths).select("g", "id", F.col("cycle").alias("there"), *([F.reverse("path").cast("array<int>").alias("above")] if paths else [])))
        nodes = tours.where("kind = 0")
        entered = {"enter": F.col("enter") + F.coalesce("fw", F.lit(0)), "root": F.coalesce("root", "froot"), "looped": F.col("looped") | F.coalesce("floop", F.lit(False))}
        nodes = _through(nodes, "enter_to", ranked, entered)
        nodes = _through(nodes, "leave_to", ranked, {"leave": F.col("leave") + F.coalesce("fw", F.lit(0))})
        nodes = _through(nodes, "up", up, {"cycle": F.coalesce("cycle", "there")} | ({"path": F.when(F.col("there").isNull(), F.concat("above", "path"))} if paths else {}))
    when = lambda v, kind, name: F.when(~F.col("looped"), v).cast(kind).alias(name)
    enter, leave = steps(F.col("enter")), steps(F.col("leave"))
    depth = rise(F.col("enter")) - 1
    return nodes.select(
        "file_id", F.col("node_id").cast("int").alias("node_id"), "parent_id", when(F.col("root"), "int", "root_id"), when(depth, "int", "depth"),
        when(enter - 1, "long", "entry"), when(leave - 1, "long", "exit"), when(F.shiftright(enter + depth - 1, 1), "long", "preorder"),
        when(F.shiftright(leave - enter - 1, 1), "long", "n_descendants"), F.col("cycle").cast("int").alias("cycle_node_id"), F.when(~F.col("looped"), F.col("path")).alias("path"),
    )


def descendants(trees: DataFrame, picked: DataFrame | None = None) -> DataFrame:
    """All descendants of the picked (file_id, node_id), or of every node, by their intervals.

    The descendants of a node are the ``n_descendants`` nodes that follow it in
    preorder. Intervals and nodes meet in blocks of ``RANKS`` ranks of a tree,
    so a node is compared with the intervals that reach into its block, not
    with all of its tree. Output: file_id, node_id, descendant_id. Null keys
    and nodes on loops match nothing.
    """
    t = trees.where("root_id is not null").select("file_id", "root_id", "node_id", "preorder", "n_descendants")
    a = t.where("n_descendants > 0")
    if picked is not None:
        a = a.join(picked.select(F.col("file_id").alias("_f"), F.col("node_id").alias("_n")).distinct(), (F.col("file_id") == F.col("_f")) & (F.col("node_id") == F.col("_n")), "left_semi")
    block = lambda c: F.floor(c / RANKS)
    low, high = F.col("preorder") + 1, F.col("preorder") + F.col("n_descendants")
    a = a.select(F.col("file_id").alias("f"), F.col("root_id").alias("r"), F.col("node_id").alias("a"), low.alias("low"), high.alias("high"), F.explode(F.sequence(block(low), block(high))).alias("b"))
    inside = (F.col("file_id") == F.col("f")) & (F.col("root_id") == F.col("r")) & (F.col("block") == F.col("b")) & F.col("preorder").between(F.col("low"), F.col("high"))
    return t.withColumn("block", block(F.col("preorder"))).join(a, inside).select("file_id", F.col("a").alias("node_id"), F.col("node_id").alias("descendant_id"))
