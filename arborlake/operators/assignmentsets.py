"""Named sets of cluster assignments: their catalogue (small, on the driver) and their labels (a table)."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.operators.assignments import assignment_column

LABELS = "set_id string, file_id string, label int"
VERSION = 2


@dataclass
class AssignmentSet:
    set_id: str
    name: str
    column: str
    order: int
    scope: str = "whole"
    space: str = ""
    parent_id: str | None = None
    parent_labels: list[int] = field(default_factory=list)
    metadata: dict = field(default_factory=dict)


class AssignmentSets:
    """Sets with unique names and stable, unique columns. Labels of all sets lie in one table: set_id, file_id, label."""

    def __init__(self, spark: SparkSession):
        self.spark, self.sets, self.active_id = spark, {}, None
        self.labels = spark.createDataFrame([], LABELS)

    def _free_name(self, wanted: str, but: str | None = None) -> str:
        taken = {s.name.casefold() for s in self.sets.values() if s.set_id != but}
        name, n = wanted, 2
        while name.casefold() in taken:
            name, n = f"{wanted} {n}", n + 1
        return name

    def add(self, name: str, assignment: DataFrame, activate: bool = True, set_id: str | None = None, **about) -> AssignmentSet:
        """Add labels (file_id, label). Null labels are dropped; a second label of a file is not taken (the least stands)."""
        set_id = set_id or uuid.uuid4().hex
        if set_id in self.sets:
            raise ValueError(f"there is a set {set_id!r} already")
        name = self._free_name(name.strip() or "Cluster Assignment")
        column = assignment_column(name, {s.column for s in self.sets.values()})
        made = AssignmentSet(set_id, name, column, 1 + max((s.order for s in self.sets.values()), default=0), **about)
        self.sets[set_id] = made
        labels = assignment.where("file_id is not null and label is not null").groupBy("file_id").agg(F.min("label").cast("int").alias("label"))
        self.labels = self.labels.unionByName(labels.select(F.lit(set_id).alias("set_id"), "file_id", "label"))
        if activate:
            self.active_id = set_id
        return made

    def add_result(self, method: str, assignment: DataFrame, **about) -> AssignmentSet:
        """Add a clustering result as ``<method> N``, N counting the runs of the method."""
        method = method.strip() or "Cluster Assignment"
        run = 1 + max((s.metadata.get("run", 0) for s in self.sets.values() if s.metadata.get("method") == method), default=0)
        about["metadata"] = dict(about.get("metadata") or {}) | {"method": method, "run": run}
        return self.add(f"{method} {run}", assignment, **about)

    def activate(self, set_id: str | None) -> None:
        if set_id is not None and set_id not in self.sets:
            raise KeyError(set_id)
        self.active_id = set_id

    def rename(self, set_id: str, name: str) -> str:
        """A new name, made unique; the column stays."""
        if not name.strip():
            raise ValueError("a name must not be empty")
        self.sets[set_id].name = self._free_name(name.strip(), set_id)
        return self.sets[set_id].name

    def delete(self, set_id: str) -> None:
        """Delete a set; if it was active, the latest of the others becomes so."""
        del self.sets[set_id]
        self.labels = self.labels.where(F.col("set_id") != set_id)
        if self.active_id == set_id:
            self.active_id = self._latest()

    def _latest(self) -> str | None:
        return max(self.sets.values(), key=lambda s: s.order).set_id if self.sets else None

    def of(self, set_id: str) -> DataFrame:
        return self.labels.where(F.col("set_id") == set_id).select("file_id", "label")

    def active_map(self, files: DataFrame) -> DataFrame:
        """Every file with its active label, null where it has none or no set is active."""
        names = files.select("file_id").distinct()
        if self.active_id is None:
            return names.withColumn("label", F.lit(None).cast("int"))
        return names.join(self.of(self.active_id), "file_id", "left")

    def onto_files(self, files: DataFrame) -> DataFrame:
        """One column a set: file_id and the labels under each set's column, by one pivot of the label table."""
        names = files.select("file_id").distinct()
        if not self.sets:
            return names
        wide = self.labels.groupBy(F.col("file_id").alias("_f")).agg(*[F.max(F.when(F.col("set_id") == s.set_id, F.col("label"))).alias(s.column) for s in self.sets.values()])
        return names.join(wide, F.col("file_id") == F.col("_f"), "left").drop("_f")

    def state(self) -> dict:
        """What JSON can hold; the labels are a table beside it."""
        return {"version": VERSION, "active_assignment_id": self.active_id, "sets": [vars(s) | {} for s in self.sets.values()]}

    @classmethod
    def load(cls, spark: SparkSession, state: dict, labels: DataFrame) -> AssignmentSets:
        """From a state: doubled sets are skipped; an unknown active set gives way to the latest. A state of the first
        version, {file: label}, becomes one set."""
        out = cls(spark)
        if state.get("version", 1) < VERSION and "sets" not in state:
            rows = [(f, int(v)) for f, v in (state.get("assignments") or {}).items() if str(v).lstrip("-").isdigit()]
            out.add(state.get("name", "Imported"), spark.createDataFrame(rows, "file_id string, label int"))
            return out
        for raw in state.get("sets") or []:
            if isinstance(raw, dict) and raw.get("set_id") and raw["set_id"] not in out.sets:
                out.sets[raw["set_id"]] = AssignmentSet(**{k: raw[k] for k in AssignmentSet.__dataclass_fields__ if k in raw})
        out.labels = labels.where(F.col("set_id").isin(list(out.sets))).select("set_id", "file_id", F.col("label").cast("int").alias("label"))
        wanted = state.get("active_assignment_id")
        out.active_id = wanted if wanted in out.sets else out._latest()
        return out
