"""Token counts of whole texts by a public byte-level BPE tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType

#: Where the vocabulary lies on every node; a parameter of all operators that count tokens.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before byte-level BPE of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoding(vocabulary: str):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str | None, vocabulary: str = VOCABULARY) -> int:
    """Tokens of a whole text; 0 for null and empty ones."""
    return len(encoding(vocabulary).encode_ordinary(text)) if text else 0


def with_tokens(documents: DataFrame, keep: list[str], vocabulary: str = VOCABULARY, text: str = "text") -> DataFrame:
    """The columns ``keep`` and ``n_tokens`` (int). Null and empty texts have 0 tokens."""
    schema = documents.select(*keep).schema.add("n_tokens", IntegerType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(vocabulary).encode_ordinary
        for batch in batches:
            n = pa.array([len(encode(t)) if t else 0 for t in batch.column(text).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), n], names=[*keep, "n_tokens"])

    return documents.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def with_token_ids(documents: DataFrame, keep: list[str], vocabulary: str = VOCABULARY, text: str = "text") -> DataFrame:
    """The columns ``keep`` and ``token_ids``, all tokens of the whole text. Null and empty texts have none."""
    schema = documents.select(*keep).schema.add("token_ids", ArrayType(IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(vocabulary).encode_ordinary
        for batch in batches:
            ids = pa.array([encode(t) if t else [] for t in batch.column(text).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), ids], names=[*keep, "token_ids"])

    return documents.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)
