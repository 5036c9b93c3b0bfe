"""Differences between two copies of a node table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlake.runtime import written

#: Ids of one file that share a bucket, as a power of two. Neighbouring rows mostly share
#: their bucket, so the matrix is combined before the shuffle.
BUCKET_BITS = 3


def _bucket(bits: int) -> Column:
    return F.xxhash64("file_id", F.shiftright("node_id", bits))


def _x_hash(side: str, tolerance: float) -> Column:
    """Equal hashes imply values that differ by no more than the tolerance.

    Values are rounded to ten times the tolerance. A value further from its
    rounded form than half the tolerance gets a hash of its own side, so its
    bucket is read and compared exactly.
    """
    step = tolerance * 10
    scaled = F.col("x") / F.lit(step)
    near = F.rint(scaled)
    plain = (F.abs(F.col("x")) < 1e12) & (F.abs(F.col("x") - near * F.lit(step)) <= tolerance / 2)
    none = F.col("x").isNull() | F.isnan("x")
    return F.when(none, F.lit(0)).when(plain, F.xxhash64(F.lit("x"), "file_id", "node_id", near)).otherwise(F.xxhash64(F.lit(side), "file_id", "node_id", "x"))


def _hashed(df: DataFrame, side: str, bits: int, tolerance: float, bucket: tuple[Column, ...] | None = None) -> DataFrame:
    sign = 1 if side == "neurons" else -1
    hashes = {
        "key": F.xxhash64(F.lit("key"), "file_id", "node_id"),
        "region": F.xxhash64(F.lit("region"), "file_id", "node_id", F.coalesce("region_id", F.lit(0))),
        "x": _x_hash(side, tolerance),
    }
    df = df.where(F.col("file_id").isNotNull() & F.col("node_id").isNotNull()).select(*(bucket or (_bucket(bits).alias("bucket"),)), F.lit(sign).alias("n"), *[h.alias(c) for c, h in hashes.items()])
    # Each hash as two halves of 32 bits: long sums of them cannot overflow.
    halves = [(F.shiftright(c, 32) * sign).alias(f"{c}_high") for c in hashes] + [(F.col(c).bitwiseAND(0xFFFFFFFF) * sign).alias(f"{c}_low") for c in hashes]
    return df.select(*[c for c in df.columns if c not in hashes and c != "n"], "n", *halves)


SUMS = ("n", "key_high", "key_low", "region_high", "region_low", "x_high", "x_low")


def checksum_matrix(neurons: DataFrame, copy: DataFrame, bits: int = BUCKET_BITS, tolerance: float = 0.001) -> DataFrame:
    """Additive 64-bit hashes per key bucket and column, first table minus second.

    A bucket whose sums are all zero holds the same keys with equal values.
    Repeats of a row make a bucket unequal, never equal. Output: bucket, n and
    the sums of both halves of each column's hash.
    """
    both = _hashed(neurons, "neurons", bits, tolerance).unionAll(_hashed(copy, "copy", bits, tolerance))
    return both.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in SUMS])


def differences(neurons: DataFrame, copy: DataFrame, tolerance: float = 0.001, bits: int = BUCKET_BITS) -> DataFrame:
    """Nodes on one side only, and ``region_id`` and ``x`` values that differ.

    Null and 0 are the same region; null and NaN are no x. Repeats of a node
    count once (their largest value stands). Rows with a null key name no node
    and are left out. Output: file_id, node_id, diff, in_neurons, in_copy
    (values as text), one row per differing field.
    """
    matrix = checksum_matrix(neurons, copy, bits, tolerance)
    off = lambda c: (F.col(f"{c}_high") != 0) | (F.col(f"{c}_low") != 0)
    # Small beside the tables as long as differences are few; a stored table, so Spark broadcasts it or filters by it before the shuffle, as its size allows.
    unequal = written(matrix.select(F.col("bucket").alias("b"), off("region").alias("read_region"), off("x").alias("read_x"), ((F.col("n") != 0) | off("key")).alias("read_key")).where("read_region or read_x or read_key"))

    def side(df: DataFrame, name: str) -> DataFrame:
        rows = df.where(F.col("file_id").isNotNull() & F.col("node_id").isNotNull()).select(
            "file_id", "node_id", F.when(~F.isnan("x"), F.col("x")).alias("x"), F.coalesce("region_id", F.lit(0)).alias("region_id"), _bucket(bits).alias("bucket")
        )
        # Only rows of unequal buckets go on, and of them only the columns that are unequal there.
        rows = rows.join(unequal, F.col("bucket") == F.col("b"))
        return rows.select("file_id", "node_id", F.when(F.col("read_x"), F.col("x")).alias("x"), F.when(F.col("read_region"), F.col("region_id")).otherwise(0).alias("region_id"), F.lit(name).alias("side"))

    rows = side(neurons, "n").unionAll(side(copy, "c"))
    pick = lambda c, s: F.max(F.when(F.col("side") == s, F.col(c)))
    nodes = rows.groupBy("file_id", "node_id").agg(
        pick("region_id", "n").alias("rn"), pick("region_id", "c").alias("rc"), pick("x", "n").alias("xn"), pick("x", "c").alias("xc")
    )  # region_id is never null here, so it also tells on which sides the node is
    both = F.col("rn").isNotNull() & F.col("rc").isNotNull()
    x_differs = F.coalesce((F.col("xn") != F.col("xc")) & (F.abs(F.col("xn") - F.col("xc")) > tolerance), ~(F.col("xn").isNull() & F.col("xc").isNull()))
    text = lambda c: F.col(c).cast("string")
    part = lambda when, diff, a, b: F.when(when, F.struct(F.lit(diff).alias("diff"), a.alias("in_neurons"), b.alias("in_copy")))
    none = F.lit(None).cast("string")
    found = F.array(
        part(F.col("rc").isNull(), "missing_in_copy", none, none),
        part(F.col("rn").isNull(), "missing_in_neurons", none, none),
        part(both & (F.col("rn") != F.col("rc")), "region_id", text("rn"), text("rc")),
        part(both & x_differs, "x", text("xn"), text("xc")),
    )
    return nodes.select("file_id", "node_id", F.explode(F.filter(found, lambda d: d.isNotNull())).alias("d")).select("file_id", "node_id", "d.diff", "d.in_neurons", "d.in_copy")


def difference_report(neurons: DataFrame, copy: DataFrame) -> DataFrame:
    """Number of nodes and files per kind of difference."""
    return differences(neurons, copy).groupBy("diff").agg(F.count(F.lit(1)).alias("n_nodes"), F.countDistinct("file_id").alias("n_files"))


def column_checksums(neurons: DataFrame, copy: DataFrame, bits: int = BUCKET_BITS, tolerance: float = 0.001) -> DataFrame:
    """The matrix file by file: how many buckets a file has, and how many are unequal in each column.

    Repeated rows make their bucket unequal. Output: file_id, n_buckets,
    unequal_keys, unequal_region_id, unequal_x.
    """
    bucket = (F.col("file_id"), F.shiftright("node_id", bits).alias("block"))
    both = _hashed(neurons, "neurons", bits, tolerance, bucket).unionAll(_hashed(copy, "copy", bits, tolerance, bucket))
    m = both.groupBy("file_id", "block").agg(*[F.sum(c).alias(c) for c in SUMS])
    off = lambda c: F.count_if((F.col(f"{c}_high") != 0) | (F.col(f"{c}_low") != 0))
    return m.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_buckets"), off("key").alias("unequal_keys"), off("region").alias("unequal_region_id"), off("x").alias("unequal_x"))
