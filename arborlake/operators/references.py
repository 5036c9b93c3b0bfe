"""References to records that are missing, retired or not there yet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arborlake.runtime import written

#: Ids that share a block of the as-of match; bounds what one window holds.
BLOCK_IDS = 1 << 15


def key_runs(keys: DataFrame, scope: str, key: str, since: str, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Contiguous runs of integer keys that are there since the same moment (or for the same spans).

    Input rows are distinct per (scope, key). Runs end at block borders, so
    the longest window has ``block_ids`` rows. Output: scope, block, run_start,
    run_end, since.
    """
    rows = keys.where(F.col(scope).isNotNull() & F.col(key).isNotNull()).select(
        F.col(scope).alias("scope"), F.col(key).cast("long").alias("k"), F.col(since).alias("since"), F.floor(F.col(key) / block_ids).alias("block")
    )
    by = Window.partitionBy("scope", "block").orderBy("k")
    starts = (F.lag("k").over(by) == F.col("k") - 1) & F.lag("since").over(by).eqNullSafe(F.col("since"))
    marked = rows.withColumn("new", F.when(starts, 0).otherwise(1)).withColumn("run", F.sum("new").over(by))
    return marked.groupBy("scope", "block", "run").agg(F.min("k").alias("run_start"), F.max("k").alias("run_end"), F.first("since").alias("since")).drop("run")


def match_runs(asked: DataFrame, runs: DataFrame, block_ids: int = BLOCK_IDS) -> DataFrame:
    """As-of match: each reference (scope, k; distinct) meets the run that starts at or before it.

    Adds ``found`` (the reference is not beyond the run's end) and ``since``
    of the run. Other columns of ``asked`` are kept.
    """
    extra = [c for c in asked.columns if c not in ("scope", "k")]
    placed = asked.withColumn("block", F.floor(F.col("k") / block_ids))
    blank = [F.lit(None).cast(dict(asked.dtypes)[c]).alias(c) for c in extra]
    both = runs.select("scope", "block", F.col("run_start").alias("k"), *blank, F.struct("run_end", "since").alias("run"), F.lit(0).alias("asks")).unionByName(
        placed.select("scope", "block", "k", *extra, F.lit(None).cast(_run_type(runs)).alias("run"), F.lit(1).alias("asks"))
    )
    by = Window.partitionBy("scope", "block").orderBy("k", "asks").rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("run", F.last("run", ignorenulls=True).over(by)).where("asks = 1")
    ok = F.coalesce(F.col("k") <= F.col("run.run_end"), F.lit(False))
    return met.select("scope", "k", *extra, ok.alias("found"), F.when(ok, F.col("run.since")).alias("since"))


def _run_type(runs: DataFrame) -> str:
    kinds = dict(runs.dtypes)
    return f"struct<run_end:{kinds['run_end']},since:{kinds['since']}>"


def first_loads(neurons: DataFrame) -> DataFrame:
    """Distinct nodes with their first load. Repeats are combined before the shuffle; null keys name no node."""
    named = neurons.where(F.col("file_id").isNotNull() & F.col("node_id").isNotNull())
    return named.groupBy("file_id", "node_id").agg(F.min("loaded_at").alias("first_load"), F.min("parent_id").alias("parent_id"), F.min("region_id").alias("region_id"))


def _reported(refs: DataFrame, bad: DataFrame, scoped: bool, ref: str, wrong: Column, cause: Column) -> DataFrame:
    """The references whose key is among the bad ones, and for which it is wrong indeed."""
    same = F.col(ref).cast("long") == F.col("k")
    joined = refs.join(bad, (F.col("file_id") == F.col("scope")) & same if scoped else same)
    return joined.where(wrong).select("file_id", "node_id", F.lit(ref).alias("ref_field"), F.col("k").alias("missing_key"), "first_load", cause.alias("cause"))


def parent_orphans(nodes: DataFrame, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Of ``first_loads``: nodes whose ``parent_id`` (not null, not -1) has no node in the file, or one loaded later.

    References are reduced to distinct (file, parent) with their earliest
    load, so a parent that a third of all rows refer to is looked up once; only
    keys that are wrong for some reference come back to the nodes. A null load
    time counts as never later and never earlier.
    """
    runs = key_runs(nodes, "file_id", "node_id", "first_load", block_ids)
    refs = nodes.where("parent_id is not null and parent_id <> -1")
    asked = refs.groupBy(F.col("file_id").alias("scope"), F.col("parent_id").cast("long").alias("k")).agg(F.min("first_load").alias("earliest"))
    bad = match_runs(asked, runs, block_ids).where(~F.col("found") | (F.col("since") > F.col("earliest")))
    return _reported(refs, bad, True, "parent_id", ~F.col("found") | (F.col("since") > F.col("first_load")), F.when(F.col("found"), "later").otherwise("missing"))


def region_orphans(nodes: DataFrame, regions: DataFrame, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Of ``first_loads``: nodes whose ``region_id`` (not null, not 0) named no valid region at the first load.

    A region is valid from ``added_at`` until just before ``retired_at``
    (null: still). Contiguous region ids with the same spans of validity are
    one run; references, reduced to distinct ids with their earliest and latest
    load, are matched as-of to the run before them. A null first load matches
    no validity, so it is a case.
    """
    spans = regions.where("region_id is not null").groupBy("region_id").agg(F.array_sort(F.collect_set(F.struct("added_at", "retired_at"))).alias("spans"))
    runs = key_runs(spans.withColumn("scope", F.lit("regions")), "scope", "region_id", "spans", block_ids)
    refs = nodes.where("region_id is not null and region_id <> 0")
    asked = refs.groupBy(F.lit("regions").alias("scope"), F.col("region_id").cast("long").alias("k")).agg(F.min("first_load").alias("earliest"), F.max("first_load").alias("latest"), F.count_if(F.col("first_load").isNull()).alias("undated"))
    at = lambda s, when: F.coalesce(s["added_at"] <= F.col(when), F.lit(False)) & F.coalesce(F.col(when) < s["retired_at"], s["retired_at"].isNull())
    always = F.exists("since", lambda s: at(s, "earliest") & at(s, "latest"))  # one span holds all references
    bad = match_runs(asked, runs, block_ids).where(~F.col("found") | (F.col("undated") > 0) | ~F.coalesce(always, F.lit(False)))
    valid = F.col("first_load").isNotNull() & F.exists("since", lambda s: at(s, "first_load"))
    return _reported(refs, bad.drop("scope"), False, "region_id", ~F.coalesce(valid, F.lit(False)), F.when(F.col("found"), "not_valid").otherwise("missing"))


def orphans(neurons: DataFrame, regions: DataFrame, block_ids: int = BLOCK_IDS) -> DataFrame:
    """All orphan references of both kinds, from one scan of the nodes.

    Nulls in ``file_id`` or ``node_id`` name no node: such rows neither refer
    nor are referred to. Repeats of a node count once, with its earliest load;
    other columns are ignored. Output: file_id, node_id, ref_field,
    missing_key, first_load, cause.
    """
    nodes = written(first_loads(neurons))
    return parent_orphans(nodes, block_ids).unionByName(region_orphans(nodes, regions, block_ids))


def orphan_report(neurons: DataFrame, regions: DataFrame) -> DataFrame:
    """Orphans per referred table, cause and month of loading."""
    table = F.when(F.col("ref_field") == "parent_id", "neurons").otherwise("atlas_regions")
    return (
        orphans(neurons, regions)
        .groupBy(table.alias("referred_table"), "cause", F.date_format("first_load", "yyyy-MM").alias("load_month"))
        .agg(F.count(F.lit(1)).alias("n_orphans"), F.countDistinct("file_id").alias("n_files"))
    )
