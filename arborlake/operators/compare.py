"""Row-by-row comparison of a file and its mirrored twin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def side_by_side(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Rows of both tables by a key that is unique on each side (a row index, or file and node); missing sides are null."""
    a = left.select(*on, F.struct(*left.columns).alias("l"))
    b = right.select(*on, F.struct(*right.columns).alias("r"))
    return a.join(b, on, "full")


def difference_counts(pairs: DataFrame, columns: list[str], axis: str, expected_sum: float, tolerance: float = 1e-6) -> DataFrame:
    """Rows, differing values per column, and how far the mirrored axis sums are off."""
    total = F.col(f"l.{axis}") + F.col(f"r.{axis}")
    counts = [F.count_if(~F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))).alias(f"differs_{c}") for c in columns]
    return pairs.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("l").isNull()).alias("only_right"), F.count_if(F.col("r").isNull()).alias("only_left"), *counts,
        F.min(total).alias("least_sum"), F.max(total).alias("greatest_sum"), F.count_if(F.abs(total - expected_sum) > tolerance).alias("bad_sums"), F.max(F.abs(total - expected_sum)).alias("largest_error"),
    )


def remaps(pairs: DataFrame, column: str, k: int) -> DataFrame:
    """The k most frequent changes of a column, ties by value."""
    a, b = F.col(f"l.{column}"), F.col(f"r.{column}")
    return pairs.where(~a.eqNullSafe(b)).groupBy(a.alias("from_value"), b.alias("to_value")).agg(F.count(F.lit(1)).alias("n_rows")).orderBy(F.desc("n_rows"), F.asc_nulls_last("from_value"), F.asc_nulls_last("to_value")).limit(k)


def mismatches(pairs: DataFrame, column: str, order: list[Column | str], k: int) -> DataFrame:
    """The first k rows whose column differs."""
    return pairs.where(~F.col(f"l.{column}").eqNullSafe(F.col(f"r.{column}"))).orderBy(*order).limit(k)
