"""Results of a clustering as tables: neurons and distances in leaf order, run metadata, the labelled node table."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.operators.assignments import onto_nodes
from arborlake.operators.correlation import Cohort, per_neuron
from arborlake.operators.nodes import neuron_summary
from arborlake.runtime import arrow_schema, written

#: Fixed value: distances that a task of ``cohort_distances`` makes in one go.
PAIRS_A_BLOCK = 4_000_000


def ordered_clusters(nodes: DataFrame, result: DataFrame) -> DataFrame:
    """One row a clustered neuron in leaf order, from 1, with its summary. ``result`` is file_id, label, leaf."""
    about = neuron_summary(nodes).select(F.col("file_id").alias("_f"), "neuron_id", "subject", "soma_x", "soma_y", "soma_z", "soma_region")
    rows = result.where("leaf is not null").join(about, F.col("file_id") == F.col("_f"), "left")
    return rows.select((F.col("leaf") + 1).alias("leaf_order"), "file_id", "neuron_id", "subject", F.col("label").alias("cluster_assignment"), "soma_x", "soma_y", "soma_z", "soma_region")


def ordered_distances(long_form: DataFrame, result: DataFrame) -> DataFrame:
    """Distances max(0, 1 - r) by leaf position: row_order, col_order, distance. Null r are -1, so their distance is 2."""
    place = lambda end, order: result.where("leaf is not null").select(F.col("file_id").alias(end), (F.col("leaf") + 1).alias(order))
    r = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.coalesce("r", F.lit(-1.0))))
    d = F.when(F.col("row_order") == F.col("col_order"), 0.0).otherwise(F.greatest(F.lit(0.0), 1.0 - r))
    return long_form.join(place("swc_id_1", "row_order"), "swc_id_1").join(place("swc_id_2", "col_order"), "swc_id_2").select("row_order", "col_order", d.alias("distance"))


def cohort_distances(counts: DataFrame, result: DataFrame) -> DataFrame:
    """``ordered_distances`` of ``dense_pearson`` of the counts, made by blocks of rows.

    The counts are small beside the pairs, so each block gets all of them and
    no pair is shuffled or joined.
    """
    placed = written(per_neuron(counts).join(result.where("leaf is not null").select("file_id", "leaf"), "file_id", "left"))
    blocks = max(1, placed.count() ** 2 // PAIRS_A_BLOCK)
    ddl = "row_order int, col_order int, distance double"
    schema = arrow_schema(ddl)

    def run(table):
        import numpy as np
        import pyarrow as pa

        at, block = dict(zip(*(table.column(c).to_pylist() for c in ("file_id", "leaf")))), table.column("block")[0].as_py()
        cohort = Cohort(table.to_batches())
        order = np.array([-1 if at[f] is None else at[f] for f in cohort.ids])
        cols = np.flatnonzero(order >= 0)
        out = []
        for a in cols[order[cols] % blocks == block]:
            d = np.maximum(0.0, 1.0 - cohort.row(a, True)[cols])
            d[order[cols] == order[a]] = 0.0
            out.append(pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip((np.full(len(cols), order[a] + 1), order[cols] + 1, d), schema)], schema=schema))
        return pa.Table.from_batches(out, schema)

    return placed.crossJoin(F.broadcast(placed.sparkSession.range(blocks).withColumnRenamed("id", "block"))).groupBy("block").applyInArrow(run, ddl)


def run_metadata(result: DataFrame, about: dict) -> DataFrame:
    """What a run is about as rows field, value: the given entries and the numbers of neurons and clusters."""
    n = result.agg(F.count("label").alias("n_clustered"), F.count_if(F.col("label").isNull()).alias("n_unassigned"), F.countDistinct("label").alias("n_clusters")).first().asDict()
    rows = [(k, v if isinstance(v, str) else json.dumps(v, sort_keys=True)) for k, v in ({**about} | n).items()]
    return result.sparkSession.createDataFrame(rows, "field string, value string")


def extended(nodes: DataFrame, result: DataFrame) -> DataFrame:
    """The node table with ``cluster_assignment`` (int, null where a file has none), replacing a column of that name."""
    return onto_nodes(nodes, result.select("file_id", F.col("label").cast("int").alias("cluster_assignment")), ["cluster_assignment"])


def write_extended(nodes: DataFrame, result: DataFrame, long_form: DataFrame, path: str, about: dict) -> None:
    """The labelled node table, with its distances and metadata as tables beside it."""
    from arborlake.sources.tables import write_table

    meta = {r["field"]: r["value"] for r in run_metadata(result, about).collect()}
    write_table(extended(nodes, result), path, {"analysis": meta}, "snappy")
    write_table(ordered_clusters(nodes, result), f"{path}.clusters", {"analysis": meta})
    write_table(ordered_distances(long_form, result), f"{path}.distances", {"analysis": meta})
