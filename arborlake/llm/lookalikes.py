"""Text that looks alike, in one consistent form."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from arborlake.runtime import written

#: Cyrillic and Greek letters and signs, and the ones drawn alike that stand for them.
DRAWN_ALIKE = {
    # Cyrillic capitals
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X",
    "Ѕ": "S", "І": "I", "Ј": "J", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "I", "Ү": "Y", "Ғ": "F",
    "Ѵ": "V", "Ӕ": "Æ", "Ә": "Ə",
    # Cyrillic small letters
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӕ": "æ", "ә": "ə",
    # Greek capitals
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "Ϲ": "C", "Ϳ": "J",
    # Greek small letters
    "ο": "o", "ν": "v", "α": "a", "ρ": "p", "ϲ": "c", "ϳ": "j",
    # Greek and Cyrillic letters drawn alike without a common Latin one
    "Γ": "Г", "Π": "П", "Φ": "Ф", "Ѱ": "Ψ", "ѱ": "ψ", "Ѳ": "Θ", "ϴ": "Θ", "Ө": "Θ", "Ɵ": "Θ", "ө": "ɵ", "κ": "к", "ĸ": "к", "ᴋ": "к", "ϵ": "є",
    # Small capitals of the Latin and Greek alphabets, drawn like small Cyrillic letters
    "ʙ": "в", "ᴍ": "м", "ʜ": "н", "ᴛ": "т", "ᴨ": "п", "ᴫ": "л", "ᴦ": "г", "ᴙ": "я",
    # Latin letters drawn like Greek or Cyrillic ones
    "Ʃ": "Σ", "Ʌ": "Λ", "Ɛ": "Ԑ", "ɛ": "ε", "ɣ": "γ", "ɩ": "ι", "ɸ": "φ", "ʋ": "υ", "ӏ": "l",
    # Latin letters drawn like another, and signs
    "ɑ": "a", "ɡ": "g", "µ": "μ", "Ω": "Ω", "K": "K", "‐": "-", "‑": "-",
}
_WITHOUT_WIDTH = re.compile(r"[͏ᅟᅠ឴឵᠋-᠏ㅤ︀-️ﾠ]")
#: A segment that may not be stable: from the character before the first other than plain ASCII to the last such in a row.
_SEGMENT = re.compile(r"[\x00-\x7f]?[^\x00-\x7f]+")
_FOLD = str.maketrans(DRAWN_ALIKE)


def _plain(ch: str) -> str:
    """A character's plain form: width variants and spaces replaced, characters without width dropped."""
    kind = unicodedata.category(ch)
    if kind == "Cf" or _WITHOUT_WIDTH.match(ch):
        return ""
    if kind == "Zs":
        return " "
    if unicodedata.decomposition(ch).startswith(("<wide>", "<narrow>")):
        return unicodedata.normalize("NFKC", ch)
    return ch


def _settle(segment: str) -> str:
    """Canonical form of a segment together with its context.

    Decomposed, made plain and folded, then composed again, so accents
    combine with the letter that stands for the stored one.
    """
    split = "".join(map(_plain, unicodedata.normalize("NFD", segment)))
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", split).translate(_FOLD))


def _is_stable(segment: str) -> bool:
    """Quick check: composed already, and no character with another plain or folded form."""
    return unicodedata.is_normalized("NFC", segment) and not _UNSETTLED.search(segment) and not any(map(_accented_alike, segment))


def _accented_alike(ch: str) -> bool:
    d = unicodedata.normalize("NFD", ch) if ord(ch) > 0x2FF else ""
    return len(d) > 1 and d[0] in DRAWN_ALIKE


def _unsettled_class() -> str:
    """Characters below U+10000 that ``_plain`` or the table changes, as ranges of a regex class."""
    points = [c for c in range(128, 0x10000) if not 0xD800 <= c < 0xE000 and (chr(c) in DRAWN_ALIKE or _plain(chr(c)) != chr(c))]
    parts, start = [], None
    for a, b in zip(points, [*points[1:], None]):
        start = a if start is None else start
        if b != a + 1:
            parts.append(f"\\u{start:04x}-\\u{a:04x}")
            start = None
    return "[" + "".join(parts) + "\U000e0001-\U000e0fff]"


_UNSETTLED = re.compile(_unsettled_class())


def canonical(text: str | None) -> str | None:
    """A text's consistent form; equal for texts that look the same.

    Only segments outside ASCII are looked at. Those that pass the quick check
    stay; the others are normalised with the character before them and
    spliced into the unchanged rest. A segment ends where ASCII begins, and no
    ASCII character combines with what stands before it, so results are the
    same as for the whole text. A character without width may stand between a
    letter and its accent; then the neighbouring segments are settled as one.
    Null gives null, an empty text itself.
    """
    if not text or text.isascii():
        return text

    def settle(m: re.Match) -> str:
        segment = m.group()
        return segment if _is_stable(segment) else _settle(segment)

    return _SEGMENT.sub(settle, text)


def canonical_texts(documents: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` and ``canonical_text``; whole texts, in Arrow batches."""
    schema = documents.select(*keep).schema.add("canonical_text", StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = pa.array([canonical(t) for t in batch.column(text).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), out], names=[*keep, "canonical_text"])

    return documents.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def _prints(documents: DataFrame) -> DataFrame:
    """Wide hashes of each text as stored and in its canonical form; stored, so that texts are settled once. Binary: half the size of text."""
    rows = documents.where("doc_id is not null and text is not null")
    both = canonical_texts(rows, ["doc_id", "text"])
    return written(both.select("doc_id", F.unhex(F.sha2("canonical_text", 256)).alias("form"), F.unhex(F.sha2("text", 256)).alias("stored")))


def lookalike_pairs(documents: DataFrame) -> DataFrame:
    """Pairs of documents whose stored texts differ and look the same.

    Texts are compared by 256-bit hashes, and only within forms that have
    several stored texts; copies of one stored text pair with the others, not
    with each other. Null texts are left out, repeated doc_ids count once.
    Output: doc_a, doc_b (smaller first).
    """
    prints = _prints(documents)
    several = prints.groupBy("form").agg(F.min("stored").alias("a"), F.max("stored").alias("b")).where("a <> b").select("form")
    rows = prints.join(several, "form", "left_semi").distinct()
    other = rows.select(F.col("doc_id").alias("doc_b"), F.col("form").alias("f"), F.col("stored").alias("s"))
    return rows.join(other, (F.col("form") == F.col("f")) & (F.col("stored") != F.col("s")) & (F.col("doc_id") < F.col("doc_b"))).select(F.col("doc_id").alias("doc_a"), "doc_b").distinct()


def lookalike_classes(documents: DataFrame) -> DataFrame:
    """Class of each document, and how many documents and stored texts look like it.

    Output: doc_id, class_id (least doc_id of the class), n_documents, n_stored_texts.
    """
    prints = _prints(documents).distinct()
    classes = prints.groupBy("form", "stored").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    classes = classes.groupBy("form").agg(F.min("least").alias("class_id"), F.sum("n").alias("n_documents"), F.count(F.lit(1)).alias("n_stored_texts"))
    return prints.join(classes, "form").select("doc_id", "class_id", "n_documents", "n_stored_texts")
