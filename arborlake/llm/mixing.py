"""Mixing sources to target weights of tokens, by weighted sampling without replacement."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arborlake.llm.tokens import VOCABULARY, with_token_ids
from arborlake.runtime import dropped, written

#: Bins into which one round divides the keys around a budget's end.
BINS = 512
#: Documents around a budget's end that are sorted in one window.
EDGE_ROWS = 5_000
LEAST_WEIGHT = 0.05


def measured(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Tokens and quality weight of each document: doc_id, source, n_tokens, weight.

    Quality is measured by a unigram model of tokens, trained on all documents
    (counts per token, at most as many as the vocabulary has): the mean
    surprise of a document's tokens, in standard deviations from the mean of
    its source. Garbled texts surprise more, monotonous ones less than is usual
    in their source; both weigh less, down to ``LEAST_WEIGHT``. Texts without
    tokens have the least weight.
    """
    ids = written(with_token_ids(documents.where("doc_id is not null and source is not null"), ["doc_id", "source"], vocabulary))
    counts = ids.select(F.explode("token_ids").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()  # at most one row a token of the vocabulary
    surprise = np.zeros(max((r["token"] for r in counts), default=0) + 1)
    total = sum(r["n"] for r in counts)
    for r in counts:
        surprise[r["token"]] = math.log2(total / r["n"])
    scored = written(ids.mapInArrow(_scorer(surprise), "doc_id long, source string, n_tokens int, bits double"))
    dropped(ids)
    usual = scored.groupBy(F.col("source").alias("_s")).agg(F.avg("bits").alias("_mean"), F.stddev_pop("bits").alias("_sd"))
    z = (F.col("bits") - F.col("_mean")) / F.nullif(F.col("_sd"), F.lit(0.0))
    weight = F.when(F.col("bits").isNull(), LEAST_WEIGHT).otherwise(F.greatest(F.lit(LEAST_WEIGHT), F.exp(-F.coalesce(z * z, F.lit(0.0)) / 8)))
    return scored.join(usual, F.col("source") == F.col("_s")).select("doc_id", "source", "n_tokens", weight.alias("weight"))


def _scorer(surprise: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("token_ids")
            n, values = np.diff(lists.offsets.to_numpy()), surprise[lists.flatten().to_numpy()] if len(lists.flatten()) else np.zeros(0)
            ends = np.cumsum(np.append(0, values))
            stop = np.cumsum(n)
            mean = (ends[stop] - ends[stop - n]) / np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(n, pa.int32()), pa.array(mean, mask=n == 0)], names=["doc_id", "source", "n_tokens", "bits"])

    return run


def sampling_key(seed: int, *parts: str) -> Column:
    """Efraimidis-Spirakis key: -ln(u) / weight; the smallest keys are the sample."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *parts), 11) + 0.5) / float(1 << 53)
    return -F.log(u) / F.col("weight")


def plan(totals: dict[str, int], targets: list[tuple[str, str, float, int]]) -> list[tuple]:
    """Token budget, complete epochs and rest per mix and source.

    The total of a mix is the largest one at which no source exceeds its
    allowed repeats; sources without tokens cannot limit it and get nothing.
    """
    rows = []
    for mix in sorted({t[0] for t in targets}):
        mine = [(s, share, max(0, repeats or 0)) for m, s, share, repeats in targets if m == mix]
        limits = [totals[s] * r / share for s, share, r in mine if share and share > 0 and totals.get(s)]
        total = min(limits, default=0.0)
        for s, share, r in mine:
            have = totals.get(s) or 0
            budget = min(math.floor((share or 0) * total + 1e-6), have * r) if have else 0
            epochs = budget // have if have else 0
            rows.append((mix, s, float(share or 0), r, int(have), int(budget), int(epochs), int(budget - epochs * have)))
    return rows


PLAN = "mix_name string, plan_source string, target_share double, max_repeats int, source_tokens long, budget long, epochs int, rest long"


def _edges(rows: DataFrame, plans: list[tuple]) -> list[tuple]:
    """Interval of sampling keys in which each mix and source reaches the end of its budget.

    Rows are mix_name, source, key, n_tokens. Keys below the interval are all
    taken. Histograms of tokens over the keys are refined until an interval
    has at most ``EDGE_ROWS`` documents or a single key, so a source's rows are
    never sorted as a whole. Their state is one row a mix and source.
    """
    live = {(r[0], r[1]): (0.0, None, 0, r[7]) for r in plans if r[7] > 0 and r[6] < r[3]}  # low, high, tokens before, rest
    done = []
    spark = rows.sparkSession
    while live:
        spans = F.broadcast(spark.createDataFrame([(*k, lo, hi if hi is not None else math.inf) for k, (lo, hi, _, _) in live.items()], "sm string, ss string, lo double, hi double"))
        inside = rows.join(spans, (F.col("mix_name") == F.col("sm")) & (F.col("source") == F.col("ss")) & F.col("key").between(F.col("lo"), F.col("hi")))
        # The first division is by the share of an exponential variable, then by even parts.
        share = F.when(F.col("hi") == math.inf, 1 - F.exp(-F.col("key"))).otherwise((F.col("key") - F.col("lo")) / (F.col("hi") - F.col("lo")))
        bins = inside.groupBy("mix_name", "source", F.least(F.floor(share * BINS), F.lit(BINS - 1)).alias("b")).agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("c"), F.min("key").alias("least"), F.max("key").alias("most"))
        seen = {}
        for r in sorted(bins.collect(), key=lambda r: r["b"]):  # at most BINS rows a mix and source
            seen.setdefault((r["mix_name"], r["source"]), []).append(r)
        following = {}
        for k, (_, _, before, rest) in live.items():
            for r in seen.get(k, []):
                if before + r["n"] > rest:
                    if r["c"] <= EDGE_ROWS or r["least"] == r["most"]:
                        done.append((*k, r["least"], r["most"], before))
                    else:
                        following[k] = (r["least"], r["most"], before, rest)
                    break
                before += r["n"]
            else:  # the budget holds all there is
                done.append((*k, math.inf, math.inf, before))
        live = following
    return done


def _sampled(documents: DataFrame, targets: DataFrame, seed: int, vocabulary: str) -> tuple[DataFrame, DataFrame]:
    named = targets.where("mix_name is not null and source is not null").groupBy("mix_name", "source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("repeats"))
    wanted = [tuple(r) for r in named.collect()]  # the table is fixed and small
    docs = written(measured(documents, vocabulary))
    totals = docs.where(F.col("source").isin(sorted({t[1] for t in wanted}))).groupBy("source").agg(F.sum("n_tokens").alias("n"))
    plan_rows = plan({r["source"]: r["n"] for r in totals.collect()}, wanted)
    plans = documents.sparkSession.createDataFrame(plan_rows, PLAN)
    rows = docs.join(F.broadcast(plans), F.col("source") == F.col("plan_source")).withColumn("key", sampling_key(seed, "mix_name", "doc_id"))
    edges = documents.sparkSession.createDataFrame(_edges(rows, plan_rows), "em string, es string, least double, most double, before long")
    joined = rows.join(F.broadcast(edges), (F.col("mix_name") == F.col("em")) & (F.col("source") == F.col("es")), "left")
    at_edge = F.coalesce(F.col("key").between(F.col("least"), F.col("most")), F.lit(False))
    rest = joined.where(~at_edge).withColumn("taken", F.coalesce((F.col("key") < F.col("least")).cast("int"), F.lit(0)))
    run = F.sum("n_tokens").over(Window.partitionBy("mix_name", "source").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    over = F.col("before") + run - F.col("rest")  # the document that crosses the budget is taken if that comes nearer to it
    edge = joined.where(at_edge).withColumn("taken", ((over <= 0) | ((over < F.col("n_tokens")) & (2 * over < F.col("n_tokens")))).cast("int"))
    used = rest.unionByName(edge).withColumn("n_uses", F.col("epochs") + F.col("taken")).where("n_uses > 0")
    return used.select("mix_name", "doc_id", "source", "n_uses", "n_tokens"), plans


def mix_documents(documents: DataFrame, targets: DataFrame, seed: int = 0, vocabulary: str = VOCABULARY) -> DataFrame:
    """How often each document is used in each mix.

    Complete epochs of a source come first; the rest of its budget is filled
    with documents in order of their sampling keys, one after the other; the
    one that crosses the budget is taken if that comes nearer to it. Documents with a null id or source are in no mix, null
    and empty texts have no tokens. Sampling depends on seed, mix and document
    only. Output: mix_name, doc_id, source, n_uses, n_tokens (of one use);
    unused documents are left out.
    """
    return _sampled(documents, targets, seed, vocabulary)[0]


def mix_report(documents: DataFrame, targets: DataFrame, seed: int = 0, vocabulary: str = VOCABULARY) -> DataFrame:
    """Target, attainable and reached shares, and why they differ.

    The attainable share is that of the budgets: a source without documents
    has none, and the others share what it leaves. Reasons: ``no documents``;
    ``others lack documents`` (the share grows as theirs is missing); ``whole
    documents`` (budget and use differ by the document at the budget's end);
    else empty. ``limits`` marks the source whose repeats bound the mix.
    """
    used, plans = _sampled(documents, targets, seed, vocabulary)
    sums = used.groupBy(F.col("mix_name").alias("m"), F.col("source").alias("s")).agg(F.sum(F.col("n_uses") * F.col("n_tokens")).alias("tokens"), F.count(F.lit(1)).alias("n_documents"), F.max("n_uses").alias("most_uses"))
    both = F.broadcast(plans).join(sums, (F.col("mix_name") == F.col("m")) & (F.col("plan_source") == F.col("s")), "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    share = lambda c: F.coalesce(F.col(c) / F.nullif(F.sum(c).over(Window.partitionBy("mix_name")), F.lit(0)), F.lit(0.0))
    both = both.withColumns({"actual_share": share("tokens"), "attainable_share": share("budget")})
    none, off = (F.col("target_share") > 0) & (F.col("budget") == 0), F.abs(F.col("attainable_share") - F.col("target_share")) > 0.001
    reason = F.when(none & (F.col("source_tokens") == 0), "no documents").when(none, "no repeats allowed").when(F.col("tokens") != F.col("budget"), F.when(off, "others lack documents; whole documents").otherwise("whole documents")).when(off, "others lack documents").otherwise("")
    limits = (F.col("budget") > 0) & (F.col("budget") >= F.col("source_tokens") * F.col("max_repeats") - 1)
    return both.select(
        "mix_name", F.col("plan_source").alias("source"), "target_share", "attainable_share", "actual_share", "tokens", "budget", "max_repeats", F.coalesce("most_uses", F.lit(0)).alias("most_uses"),
        F.coalesce("n_documents", F.lit(0)).alias("n_documents"), reason.alias("reason"), limits.alias("limits"),
    )
