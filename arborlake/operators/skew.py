"""Per-key results where a few keys hold most of the rows.

Everything comes from value histograms per key: counts that merge, so they
are combined before the shuffle and no key's rows are ever gathered, however
many it has. There is no threshold above which a key counts as hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arborlake.runtime import dropped, is_number, written

#: Bins into which one refinement round divides an interval.
BINS = 512
#: Cells of the first histogram for each factor of e in the values' size.
CELLS = 256


def value_cell(v: Column) -> Column:
    """Cell of a finite value: its signed order of magnitude in steps; it never falls as the value grows."""
    order = F.signum(v) * (F.log(F.abs(v)) + 746.0)  # 746: above -ln of the least positive double
    return F.floor(F.coalesce(order, F.lit(0.0)) * CELLS)


def value_histograms(df: DataFrame, key: str, value: str) -> DataFrame:
    """Histogram of each key's values: k, cell, c (rows), least, most.

    Rows without a value (null, NaN, infinite) are counted in the null cell.
    A null key is a key of its own.
    """
    v = F.col(value).cast("double")
    rows = df.select(F.col(key).alias("k"), F.when(is_number(v), v + F.lit(0.0)).alias("v"))
    return rows.groupBy("k", F.when(F.col("v").isNotNull(), value_cell(F.col("v"))).alias("cell")).agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("least"), F.max("v").alias("most"))


def key_loads(df: DataFrame, key: str, value: str, share: float = 0.02) -> DataFrame:
    """Rows per key, the share of all rows and whether the key is heavy, from the value histograms.

    A null key is a key of its own; rows without a value count as rows. An
    empty table gives no rows. Output: key, n_rows, n_values, row_share, heavy.
    """
    c, valued = F.col("c"), F.col("cell").isNotNull()
    counts = value_histograms(df, key, value).groupBy("k").agg(F.sum(c).alias("n_rows"), F.coalesce(F.sum(F.when(valued, c)), F.lit(0)).alias("n_values"))
    total = counts.agg(F.sum("n_rows").alias("total"))  # always one row
    return counts.crossJoin(F.broadcast(total)).select(
        F.col("k").alias(key), "n_rows", "n_values", (F.col("n_rows") / F.col("total")).alias("row_share"), (F.col("n_rows") >= F.lit(share) * F.col("total")).alias("heavy")
    )


def _held(hist: DataFrame, by: tuple[str, ...], wanted: DataFrame) -> DataFrame:
    """The bin that holds each wanted rank, with the rank inside it."""
    upto = Window.partitionBy(*by).orderBy("b")  # at most the bins of one histogram
    placed = hist.select("*", (F.sum("c").over(upto) - F.col("c")).alias("before"))
    asked = wanted.select(*[F.col(x).alias(f"w_{x}") for x in by], "p", "n", "want")
    same = F.lit(True)
    for x in by:
        same = same & F.col(x).eqNullSafe(F.col(f"w_{x}"))
    joined = placed.join(asked, same & (F.col("want") > F.col("before")) & (F.col("want") <= F.col("before") + F.col("c")))
    return joined.withColumn("want", F.col("want") - F.col("before"))


def key_quantiles(df: DataFrame, key: str, value: str, probs: list[float], bins: int = BINS) -> DataFrame:
    """Exact quantiles per key: the value at rank ceil(p * n), first rank 1.

    Distributed selection by histograms, for all keys alike: the first one has
    fixed cells; the cell that holds a rank is divided into ``bins`` again and
    again, until it has one value or the rank is its first or last. Only counts,
    minima and maxima per bin are shuffled. The ranks still sought are a table
    in the shared folder, and of the rows only those in their cells are read
    again. A bin's own least and greatest value bound the next round, so every
    round shrinks it, and the bits of a double bound the number of rounds.

    Nulls, NaN and infinities are no values; a key without values gives no
    row. Null keys count as one key. Output: key, prob, n_values, value.
    """
    for p in probs:
        if not 0.0 <= p <= 1.0:
            raise ValueError(f"probability out of range: {p}")
    hist = written(value_histograms(df, key, value).where("cell is not null").withColumn("b", F.col("cell")))
    n = hist.groupBy("k").agg(F.sum("c").alias("n")).select("k", "n", F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("p"))
    wanted = n.withColumn("want", F.greatest(F.lit(1), F.ceil(F.col("p") * F.col("n"))))
    found = written(_held(hist, ("k",), wanted).select("k", "cell", "p", "n", "want", "c", "least", "most"))
    at_end = (F.col("least") == F.col("most")) | (F.col("want") == 1) | (F.col("want") == F.col("c"))
    result = lambda rows: rows.where(at_end).select(F.col("k").alias(key), F.col("p").alias("prob"), F.col("n").alias("n_values"), F.when(F.col("want") == 1, F.col("least")).otherwise(F.col("most")).alias("value"))
    out, live = result(found), found.where(~at_end)
    if live.isEmpty():
        return out
    v = F.col(value).cast("double")
    rows = df.select(F.col(key).alias("k"), F.when(is_number(v), v + F.lit(0.0)).alias("v")).where("v is not null").withColumn("cell", value_cell(F.col("v")))
    cells = live.select(F.col("k").alias("ck"), F.col("cell").alias("cc")).distinct()
    rows = written(rows.join(cells, F.col("k").eqNullSafe(F.col("ck")) & (F.col("cell") == F.col("cc")), "left_semi"))
    while True:
        spans = live.select(F.col("k").alias("sk"), F.col("cell").alias("sc"), F.col("least").alias("lo"), F.col("most").alias("hi")).distinct()
        inside = F.col("k").eqNullSafe(F.col("sk")) & (F.col("cell") == F.col("sc")) & F.col("v").between(F.col("lo"), F.col("hi"))
        # A cell's values are of one size, so that even bins divide it well. The bin is a monotone function of v, so ranks carry over.
        b = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
        hist = rows.join(spans, inside).groupBy("k", "cell", "lo", b.alias("b")).agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("least"), F.max("v").alias("most"))
        found = written(_held(hist, ("k", "cell", "lo"), live.withColumn("lo", F.col("least"))).select("k", "cell", "p", "n", "want", "c", "least", "most"))
        out, live = out.unionByName(result(found)), found.where(~at_end)
        if live.isEmpty():
            dropped(rows)
            return out
