"""Raw point CSV records: an error-recovering parser and the typed point table.

Stored lines are records whose starts are known. In files they are not: there
a quoted field may run over several lines, and after a broken quote parsing
resumes at the next anchor, a line start from where records are valid again.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.runtime import arrow_schema, written

#: Other names of the standard point columns.
ALIASES = {
    "marker": "label", "atlas_x": "x", "atlas_y": "y", "atlas_z": "z",
    "region_acronym": "acronym", "region_id": "id", "region_hemisphere": "hemisphere",
}
NUMBER = re.compile(r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\Z")
WHOLE = re.compile(r"[+-]?[0-9]+\Z")
COLUMNS = ("label", "x", "y", "z", "region_name", "acronym", "id", "hemisphere")
#: Characters that need no second look: printable ASCII but quotes, and letters.
PLAIN = r"^[ !#-~\p{L}]*$"
#: Records that must follow each other well for a line start to be an anchor. One that fits the header and has good values is enough; more would pass over good records between damaged ones.
ANCHOR_RECORDS = 1
SCHEMA = "csv_file string, line_no int, label string, x double, y double, z double, region_name string, acronym string, id long, hemisphere string, extras string, reason string, error_at int, error_field string, raw string"


class RecordParser:
    """Recursive descent over one record.

        record := field ("," field)*
        field  := quoted | bare
        quoted := '"' ( any but '"' | '""' )* '"'
        bare   := ( any but '"' and "," )*

    A broken quote is noted with its place, then the parser resumes at the
    next comma, so that the fields after it are still returned. With ``lines``
    the text holds many records: line breaks end a bare field and a record,
    and belong to a quoted field.
    """

    def __init__(self, text: str, at: int = 0, lines: bool = False):
        self.text, self.at, self.lines, self.broken = text, at, lines, -1

    def record(self) -> list[str]:
        fields = [self.field()]
        while self.text.startswith(",", self.at):
            self.at += 1
            fields.append(self.field())
        return fields

    def field(self) -> str:
        if self.text.startswith('"', self.at):
            return self.quoted()
        return self.bare()

    def closes(self) -> bool:
        return self.at == len(self.text) or self.text[self.at] == "," or self.lines and self.text.startswith(("\n", "\r\n"), self.at)

    def quoted(self) -> str:
        start, parts = self.at, []
        self.at += 1
        while True:
            end = self.text.find('"', self.at)
            if end < 0:
                return self.resume(start, start)
            parts.append(self.text[self.at : end])
            self.at = end + 1
            if self.text.startswith('"', self.at):
                parts.append('"')
                self.at += 1
            elif self.closes():
                return "".join(parts)
            else:
                return self.resume(start, start if self.lines else end)  # among many records the quote may be that of another

    def stop(self, at: int) -> int:
        """Where the next comma, or with ``lines`` the line, ends a field."""
        end = self.text.find(",", at)
        end = len(self.text) if end < 0 else end
        if self.lines:
            line = self.text.find("\n", at, end)
            if line >= 0:
                end = line - 1 if line > at and self.text[line - 1] == "\r" else line
        return end

    def bare(self) -> str:
        start = self.at
        end = self.stop(start)
        quote = self.text.find('"', start, end)
        if quote >= 0:
            return self.resume(start, quote)
        self.at = end
        return self.text[start:end]

    def resume(self, start: int, wrong: int) -> str:
        """Note the first error; take the text up to the next comma as it stands."""
        if self.broken < 0:
            self.broken = wrong
        self.at = self.stop(max(start, wrong))
        return self.text[start : self.at]

    def pass_line_end(self) -> None:
        if self.text.startswith("\r\n", self.at):
            self.at += 2
        elif self.text.startswith("\n", self.at):
            self.at += 1


def header_columns(raw: str | None) -> list[str]:
    """Column names of a header line, other names replaced by the standard ones."""
    names = [x.strip() for x in RecordParser((raw or "").lstrip("﻿")).record()]
    return [ALIASES.get(x, x) for x in names]


def parse_record(raw: str | None, columns: list[str]) -> tuple[dict[str, str], str | None, int, str | None]:
    """Fields by column, the first reason that holds (or None), its place and field."""
    parser = RecordParser(raw or "")
    return judged(parser.record(), columns, parser.broken, len(raw or ""))


def judged(fields: list[str], columns: list[str], broken: int, end: int) -> tuple[dict[str, str], str | None, int, str | None]:
    row = dict(zip(columns, fields))
    if broken >= 0:
        return row, "bad_quoting", broken, None
    if len(fields) != len(columns):
        return row, "column_count", end, None
    wrong = invalid_field(row)
    return (row, "invalid_value", -1, wrong) if wrong else (row, None, -1, None)


class NeedMore(Exception):
    """The text ends before it can be told."""


def is_anchor(text: str, at: int, columns: list[str], whole: bool = True) -> bool:
    """Whether records are well formed from here: the next ``ANCHOR_RECORDS`` (or all up to the end) fit the header, the first with good values."""
    parser = RecordParser(text, at, lines=True)
    for n in range(ANCHOR_RECORDS):
        if parser.at >= len(text) and not whole:
            raise NeedMore
        if parser.at >= len(text):
            return n > 0
        fields = parser.record()
        if parser.at >= len(text) and not whole:
            raise NeedMore
        if parser.broken >= 0 or len(fields) != len(columns) or n == 0 and invalid_field(dict(zip(columns, fields))):
            return False
        parser.pass_line_end()
    return True


def next_anchor(text: str, at: int, columns: list[str], whole: bool = True) -> int:
    """The first anchor behind a line break at ``at`` or later; the end of the text if there is none."""
    while (line := text.find("\n", at)) >= 0:
        at = line + 1
        if is_anchor(text, at, columns, whole):
            return at
    if not whole:
        raise NeedMore
    return len(text)


def parse_text(text: str, columns: list[str], at: int = 0, end: int | None = None) -> Iterator[tuple[int, int, list[str], int]]:
    """Records that start from ``at`` up to ``end``: start, end, fields and place of a broken quote (-1: none).

    A record with a broken quote reaches up to the next anchor, so what follows is read from a validated start.
    """
    end = len(text) if end is None else end
    while at < end:
        parser = RecordParser(text, at, lines=True)
        fields = parser.record()
        if parser.broken >= 0:
            parser.at = next_anchor(text, at, columns)
        else:
            parser.pass_line_end()
        yield at, parser.at, fields, parser.broken
        at = parser.at


def invalid_field(row: dict[str, str]) -> str | None:
    """The first column whose value is unusable. A required column that the header lacks counts as blank."""
    if not row.get("label", "").strip():
        return "label"
    for c in ("x", "y", "z"):
        text = row.get(c, "").strip(" \t")
        if not NUMBER.match(text) or float(text) in (float("inf"), float("-inf")):
            return c
    text = row.get("id", "").strip()
    if text and not WHOLE.match(text):
        return "id"
    if any(ch == "�" or unicodedata.category(ch) == "Cc" for ch in row.get("region_name", "")):
        return "region_name"
    return None


def _typed(row: dict[str, str], reason: str | None) -> dict:
    """Typed values of a good record, nulls for a bad one. An id that no long can hold is kept as text among the extras."""
    if reason is not None:
        return dict.fromkeys((*COLUMNS, "extras"))
    optional = lambda c: (row.get(c) or "").strip() or None
    out = {"label": row["label"].strip()} | {c: float(row[c].strip(" \t")) for c in "xyz"} | {c: optional(c) for c in ("region_name", "acronym", "hemisphere")}
    digits = (optional("id") or "").lstrip("+-").lstrip("0")
    fits = optional("id") and len(digits) <= 19 and -(2**63) <= int(optional("id")) < 2**63
    out["id"] = int(optional("id")) if fits else None
    extras = {k: v for k, v in row.items() if k not in COLUMNS} | ({"id": optional("id")} if optional("id") and not fits else {})
    out["extras"] = json.dumps(extras, ensure_ascii=False, sort_keys=True, separators=(",", ":")) if extras else None
    return out


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = arrow_schema(SCHEMA)
    for batch in batches:
        out: dict[str, list] = {f.name: [] for f in schema}
        for file, line, raw, columns in zip(*(batch.column(c).to_pylist() for c in ("csv_file", "line_no", "raw", "columns"))):
            row, reason, at, wrong = parse_record(raw, columns if columns is not None else header_columns(None))
            given = _typed(row, reason) | {"csv_file": file, "line_no": line, "reason": reason, "error_at": at if at >= 0 else None, "error_field": wrong, "raw": None if reason is None else raw}
            for c, values in out.items():
                values.append(given[c])
        yield pa.RecordBatch.from_pydict(out, schema=schema)


def _parse_headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = pa.array([header_columns(h) for h in batch.column("header").to_pylist()], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([batch.column("header_file"), names], names=["header_file", "columns"])


def _plain_records(rows: DataFrame) -> DataFrame:
    """Records without quotes and unusual characters, by the same rules on the JVM."""
    fields = F.split("raw", ",", -1)
    field = lambda c: F.get("fields", F.array_position("columns", F.lit(c)).cast("int") - 1)
    value = lambda c: F.trim(field(c))
    number = lambda c: F.coalesce(value(c).rlike("^(?:" + NUMBER.pattern[:-2] + ")$") & (F.abs(value(c).try_cast("double")) < float("inf")), F.lit(False))
    whole = F.coalesce(value("id"), F.lit(""))
    wrong = F.when(F.coalesce(value("label"), F.lit("")) == "", "label")
    for c in "xyz":
        wrong = wrong.when(~number(c), c)
    wrong = wrong.when((whole != "") & ~whole.rlike("^(?:" + WHOLE.pattern[:-2] + ")$"), "id")
    counted = F.size("fields") == F.size("columns")
    rows = rows.withColumn("fields", fields).withColumn("error_field", F.when(counted, wrong))
    reason = F.when(~counted, "column_count").when(F.col("error_field").isNotNull(), "invalid_value")
    good = lambda v: F.when(F.col("reason").isNull(), v)
    text = lambda c: good(F.nullif(value(c), F.lit(""))).alias(c)
    own = F.lit(list(COLUMNS))
    id_ = value("id").try_cast("long")
    kept = F.filter(F.arrays_zip(F.col("columns").alias("key"), F.col("fields").alias("value")), lambda e: ~F.array_contains(own, e["key"]) | ((e["key"] == "id") & (F.trim(e["value"]) != "") & F.trim(e["value"]).try_cast("long").isNull()))
    kept = F.transform(kept, lambda e: F.struct(e["key"].alias("key"), F.when(e["key"] == "id", F.trim(e["value"])).otherwise(e["value"]).alias("value")))
    return rows.withColumn("reason", reason).select(
        "csv_file", "line_no", text("label"), *[good(value(c).try_cast("double")).alias(c) for c in "xyz"], text("region_name"), text("acronym"), good(id_).alias("id"), text("hemisphere"),
        good(F.when(F.size(kept) > 0, F.to_json(F.map_from_entries(F.array_sort(kept))))).alias("extras"), "reason", F.when(F.col("reason") == "column_count", F.length("raw")).alias("error_at"), "error_field",
        F.when(F.col("reason").isNotNull(), F.col("raw")).alias("raw"),
    )


def parse_point_lines(lines: DataFrame) -> DataFrame:
    """Typed points and located errors, one row per record but the headers.

    Each stored line is a record of its own and so a known start: however a
    quote is broken, parsing goes on there. ``reason`` is null for a good
    record, else ``bad_quoting``, ``column_count`` or ``invalid_value`` (the
    first that holds); ``error_at`` is the place of the broken quote or the
    end, ``error_field`` the column of an invalid value. A null line is an
    empty record. A whole id that no long can hold is good and kept as text
    among the extras. Of several header lines the one received last counts, a
    null time being the earliest, ties going by text. Without a header line a
    file has one nameless column, so its records are bad. Repeats of a line are
    all returned. An empty table gives no rows; extra columns of the input are
    ignored.

    Lines of plain characters without quotes are split and typed on the JVM;
    the others go through the descent parser. Headers (one a file) are joined
    by file; Spark broadcasts them if their size allows, else adaptive
    execution splits a hot file.
    """
    headers = lines.where("line_no = 1 and raw is not null").groupBy(F.col("csv_file").alias("header_file")).agg(F.max_by("raw", F.struct("received_at", "raw")).alias("header"))
    named = written(headers.mapInArrow(_parse_headers, "header_file string, columns array<string>"))
    rows = lines.where("line_no <> 1 or line_no is null").select("csv_file", F.col("line_no").cast("int").alias("line_no"), "raw")
    joined = rows.join(named, rows["csv_file"].eqNullSafe(named["header_file"]), "left").select("csv_file", "line_no", "raw", "columns")
    plain = F.coalesce(F.col("raw").rlike(PLAIN) & (F.size(F.array_distinct("columns")) == F.size("columns")), F.lit(False))
    return _plain_records(joined.where(plain)).unionByName(joined.where(~plain).mapInArrow(_parse_batches, SCHEMA))


def read_point_files(spark: SparkSession, paths: list[str], split_bytes: int = 64 << 20) -> DataFrame:
    """Typed points and located errors of CSV files, whose records may hold quoted line breaks.

    A file is cut into ranges of bytes, a task each. A range begins at the
    first anchor behind its start and ends at that of the next range, so ranges
    are read side by side and their records are those of the whole file. Output
    as of ``parse_point_lines``, with ``record_at`` (byte of the record's
    start) for the line number; ``error_at`` counts from the record's start.
    """
    files = spark.read.format("binaryFile").load(paths).select("path", "length")
    ranges = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.col("length") - 1), F.lit(split_bytes).cast("long"))).alias("start"))
    return ranges.repartition(F.col("path"), F.col("start")).mapInArrow(_range_reader(split_bytes), RECORDS)


RECORDS = SCHEMA.replace("line_no int", "record_at long")


def _range_reader(split_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        schema = arrow_schema(RECORDS)
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                store, name = fs.FileSystem.from_uri(path)
                with store.open_input_file(name) as f:
                    out: dict[str, list] = {c.name: [] for c in schema}
                    for at, raw, fields, columns, broken in _range_records(f, start, split_bytes):
                        row, reason, place, wrong = judged(fields, columns, broken, len(raw))
                        given = _typed(row, reason) | {"csv_file": name.rsplit("/", 1)[-1], "record_at": at, "reason": reason, "error_at": place if place >= 0 else None, "error_field": wrong, "raw": None if reason is None else raw}
                        for c, values in out.items():
                            values.append(given[c])
                yield pa.RecordBatch.from_pydict(out, schema=schema)

    return run


def _range_records(f, start: int, size: int) -> Iterator[tuple[int, str, list[str], list[str], int]]:
    """Records of one range of an open file. Bytes are handled as Latin-1, so that places are bytes; fields are decoded at the end."""
    whole = f.size()
    head, more = b"", 4096
    while b"\n" not in head and len(head) < whole:
        head, more = f.read_at(min(more, whole), 0), more * 2
    line = head.split(b"\n", 1)[0]
    columns = header_columns(line.decode("utf-8", "replace").rstrip("\r"))
    ahead = size
    while True:  # read on until the next range's anchor is sure
        text = f.read_at(min(size + ahead, whole - start), start).decode("latin-1")
        all_read = start + len(text) >= whole
        try:
            begin = len(line) + 1 if start == 0 else next_anchor(text, 0, columns, all_read)
            end = next_anchor(text, size, columns, all_read) if len(text) > size else len(text)
            break
        except NeedMore:
            ahead *= 2
    utf8 = lambda t: t.encode("latin-1").decode("utf-8", "replace")
    for at, stop, fields, broken in parse_text(text, columns, begin, end):
        if text[at:stop].strip("\r\n"):
            yield start + at, utf8(text[at:stop].rstrip("\r\n")), [utf8(x) for x in fields], columns, broken - at if broken >= 0 else -1


def good_points(lines: DataFrame) -> DataFrame:
    """The typed point table: required and optional columns, extras as JSON, and the origin."""
    return parse_point_lines(lines).where("reason is null").select(*COLUMNS, "extras", F.col("csv_file").alias("origin_csv"), "line_no")


def bad_records(lines: DataFrame) -> DataFrame:
    """Records that could not be loaded, with reason and place."""
    return parse_point_lines(lines).where("reason is not null").select("csv_file", "line_no", "reason", "error_at", "error_field", "raw")
