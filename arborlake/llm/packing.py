"""Filling containers of fixed capacity with texts measured in tokens.

Lengths are small integers, so the number of items of each length (at most
capacity rows, whatever the data) tells all that packing needs. The driver
solves it on these counts; then every item finds its container by its length
and its number among the items of that length.
"""

from __future__ import annotations

import bisect
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arborlake.llm.tokens import VOCABULARY, with_tokens
from arborlake.runtime import written

#: Items of one length that are numbered in one window, about; a common length is divided into as many parts as that takes.
PART_ITEMS = 200_000


class Complements:
    """Single, pair and triple sums of the available lengths.

    Sums of pairs are counted by convolving availability; they are built again
    once a length runs out, and combinations that the counts do not allow are
    taken off, so a triple is found whenever there is one.
    """

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        self.there = np.flatnonzero(counts).tolist()  # sorted lengths with items
        self.fresh = False
        self.size = 1 << int(2 * len(counts)).bit_length()

    def _pairs(self) -> np.ndarray:
        if not self.fresh:
            spectrum = np.fft.rfft((self.counts > 0).astype(float), self.size)
            self.sums = np.rint(np.fft.irfft(spectrum * spectrum, self.size)[: len(self.counts)]).astype(np.int64)
            self.fresh = True
        return self.sums

    def pair(self, gap: int) -> tuple[int, ...] | None:
        c = self.counts[: gap + 1]
        half = gap // 2
        room = np.minimum(c[: half + 1], c[::-1][: half + 1])
        room[0] = 0
        if gap % 2 == 0:
            room[half] = c[half] // 2
        a = int(room.argmax()) if len(room) else 0
        return (gap - a, a) if a and room[a] > 0 else None

    def triple(self, gap: int) -> tuple[int, ...] | None:
        c, first = self.counts, np.flatnonzero(self.counts[1:gap] > 0) + 1
        second = gap - first
        half, other = second // 2, second - first
        # Ordered pairs of each rest, less those that need more items of a length than there are beside the first.
        twice = (second % 2 == 0) & (c[half] > 0) & (c[half] - (half == first) < 2)
        again = (c[first] == 1) & (other > 0) & (other != first) & (c[np.maximum(other, 0)] > 0)
        fits = first[self._pairs()[second] - twice - 2 * again > 0]
        if not len(fits):
            return None
        a = int(fits[-1])
        c[a] -= 1
        found = self.pair(gap - a)
        c[a] += 1
        return (a, *found)

    def exact(self, gap: int) -> tuple[int, ...] | None:
        """A single, pair or triple of available lengths with this very sum."""
        if self.counts[gap] > 0:
            return (gap,)
        if gap < 2 or gap > 3 * self.largest(gap):
            return None
        return self.pair(gap) or self.triple(gap)

    def largest(self, most: int) -> int:
        at = bisect.bisect_right(self.there, most)
        return self.there[at - 1] if at else 0

    def take(self, n: int, times: int = 1) -> None:
        self.counts[n] -= times
        if not self.counts[n]:
            del self.there[bisect.bisect_left(self.there, n)]
            self.fresh = False

    def give(self, n: int) -> None:
        if not self.counts[n]:
            bisect.insort(self.there, n)
            self.fresh = False
        self.counts[n] += 1


def solve(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how often each is used; all items are used once.

    ``counts[n]`` items have length n, 1 to capacity. A container starts with
    the largest item left; as long as no single, pair or triple fills its gap
    exactly, it takes the largest item that fits. A pattern is repeated while
    its lengths last. Containers that nothing fills exactly are filled best
    fit, decreasing.
    """
    counts = counts.copy()
    index, done, rest = Complements(counts), [], np.zeros_like(counts)
    top = capacity
    while (top := index.largest(top)) > 0:
        pattern, gap = [top], capacity - top
        index.take(top)
        while gap:
            if found := index.exact(gap):
                pattern += found
                for n in found:
                    index.take(n)
                gap = 0
            elif n := index.largest(gap):
                pattern.append(n)
                index.take(n)
                gap -= n
            else:
                break
        for n in pattern:
            index.give(n)
        if gap:  # no exact fill with what is left: its first item goes to best fit, once
            rest[top] += 1
            index.take(top)
            continue
        used, often = np.unique(pattern, return_counts=True)
        times = int((counts[used] // often).min())
        done.append((tuple(sorted(pattern, reverse=True)), times))
        for n, k in zip(used.tolist(), often.tolist()):
            index.take(n, k * times)
    return done + best_fit(rest, capacity)


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, decreasing, on counts: patterns and how often each is used."""
    open_bins: dict[int, list[list]] = defaultdict(list)  # by gap: [pattern, times]
    closed: list[tuple[tuple[int, ...], int]] = []
    for n in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[n])
        while left:
            gaps = [g for g in open_bins if g >= n]
            if gaps:
                g = min(gaps)
                pattern, times = open_bins[g].pop()
                if not open_bins[g]:
                    del open_bins[g]
                fit = min(g // n, max(1, left // times))
                take = min(times, left // fit) or 1
                if take < times:
                    open_bins[g].append([pattern, times - take])
            else:
                pattern, g = (), capacity
                fit = min(capacity // n, left)
                take = left // fit
            left -= fit * take
            open_bins[g - fit * n].append([(*pattern, *([n] * fit)), take])
    for bins in open_bins.values():
        closed += [(p, t) for p, t in bins]
    return closed


def _slots(patterns: list[tuple[tuple[int, ...], int]], first: int) -> np.ndarray:
    """Rows length, first number, numbers a container, first container: where items of a length go."""
    next_number: dict[int, int] = defaultdict(int)
    rows, container = [], first
    for pattern, times in patterns:
        used, often = np.unique(pattern, return_counts=True)
        for n, k in zip(used.tolist(), often.tolist()):
            rows.append((n, next_number[n], k, container))
            next_number[n] += k * times
        container += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def _place(slots: dict[str, np.ndarray], capacity: dict[str, int]):
    keys = {p: s[:, 0] << 40 | s[:, 1] for p, s in slots.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = np.array(batch.column("pack_name").to_pylist(), object)
            n, number = (batch.column(c).to_numpy().astype(np.int64) for c in ("n_tokens", "number"))
            to = np.zeros(len(n), np.int64)
            for p in slots:
                mine = np.flatnonzero((names == p) & (n > 0))
                if mine.size:
                    at = np.searchsorted(keys[p], n[mine] << 40 | number[mine], side="right") - 1
                    s = slots[p][at]
                    to[mine] = s[:, 3] + (number[mine] - s[:, 1]) // s[:, 2]
            yield pa.RecordBatch.from_arrays([batch.column("pack_name"), pa.array(to), batch.column("doc_id"), batch.column("piece"), batch.column("first_token"), batch.column("n_tokens")], names=["pack_name", "container_id", "doc_id", "piece", "first_token", "n_tokens"])

    return run


PACKED = "pack_name string, container_id long, doc_id long, piece int, first_token int, n_tokens int"


def _items(tokens: DataFrame, packs: DataFrame, parts: int) -> DataFrame:
    """Items of each pack: whole documents, or the pieces of one that exceeds the capacity; each in one of the parts of its length."""
    full = F.greatest(F.lit(1), F.ceil(F.col("n") / F.col("capacity_tokens"))).cast("int")
    each = tokens.withColumnRenamed("n_tokens", "n").crossJoin(F.broadcast(packs)).withColumn("piece", F.explode(F.sequence(F.lit(0), full - 1)))
    first = F.col("piece") * F.col("capacity_tokens")
    return each.select("pack_name", "doc_id", "piece", first.cast("int").alias("first_token"), F.least("capacity_tokens", F.col("n") - first).cast("int").alias("n_tokens"), F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)).alias("salt"))


def pack_documents(documents: DataFrame, packs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Which document, or piece of an oversized one, goes into which container of each pack.

    A document that exceeds the capacity is cut into pieces of the capacity
    and a last one that shares a container like any other item; no other
    document is cut. Texts without tokens (empty or null) lie in container 0.
    Repeated rows are items of their own. Packs without a positive capacity
    are left out (their number is fixed and small). Containers are numbered
    from 0 within a pack. Output: pack_name, container_id, doc_id, piece,
    first_token, n_tokens.
    """
    tokens = written(with_tokens(documents, ["doc_id"], vocabulary))
    packs = packs.where("capacity_tokens > 0 and pack_name is not null").groupBy("pack_name").agg(F.max("capacity_tokens").alias("capacity_tokens"))
    capacity = {r["pack_name"]: r["capacity_tokens"] for r in packs.collect()}
    # All items might have one length, so the parts go by the number of items of all packs (a count of the stored table).
    n_items = tokens.agg(*[F.sum(F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / c))) for c in capacity.values()]).first() if capacity else []
    items = _items(tokens, packs, max(1, -(-sum(n or 0 for n in n_items) // PART_ITEMS)))
    loads = written(items.groupBy("pack_name", "n_tokens", "salt").agg(F.count(F.lit(1)).alias("n")))
    # At most capacity rows a pack, whatever the number of documents.
    lengths = loads.groupBy("pack_name", "n_tokens").agg(F.sum("n").alias("n")).collect()
    slots = {}
    for p, c in capacity.items():
        counts = np.zeros(c + 1, np.int64)
        for r in lengths:
            if r["pack_name"] == p and r["n_tokens"] > 0:
                counts[r["n_tokens"]] = r["n"]
        slots[p] = _slots(solve(counts, c), 0)
    # Number items of a length in two steps, so that a common length is spread.
    part = Window.partitionBy("pack_name", "n_tokens", "salt")
    before = loads.select("pack_name", "n_tokens", "salt", (F.sum("n").over(Window.partitionBy("pack_name", "n_tokens").orderBy("salt")) - F.col("n")).alias("before"))
    numbered = items.withColumn("k", F.row_number().over(part.orderBy("doc_id", "piece"))).join(before, ["pack_name", "n_tokens", "salt"])
    numbered = numbered.select("pack_name", "doc_id", "piece", "first_token", "n_tokens", (F.col("before") + F.col("k") - 1).alias("number"))
    return numbered.mapInArrow(_place(slots, capacity), PACKED)


def containers(documents: DataFrame, packs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Each container with its items, used and unused tokens."""
    placed = pack_documents(documents, packs, vocabulary).groupBy("pack_name", "container_id").agg(F.count(F.lit(1)).alias("n_items"), F.sum("n_tokens").alias("used_tokens"))
    sizes = packs.groupBy(F.col("pack_name").alias("p")).agg(F.max("capacity_tokens").alias("c"))
    return placed.join(F.broadcast(sizes), F.col("pack_name") == F.col("p")).select("pack_name", "container_id", "n_items", "used_tokens", (F.col("c") - F.col("used_tokens")).alias("unused_tokens"))


def pack_report(documents: DataFrame, packs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Containers, tokens and unused space of each pack."""
    return containers(documents, packs, vocabulary).groupBy("pack_name").agg(
        F.count(F.lit(1)).alias("n_containers"), F.sum("n_items").alias("n_items"), F.sum("used_tokens").alias("used_tokens"), F.sum("unused_tokens").alias("unused_tokens"), F.count_if(F.col("unused_tokens") == 0).alias("n_full")
    )
