"""Token counts by a public tokenizer whose vocabulary lies outside the repository."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the vocabulary files; every operator takes it as a parameter.
TOKENIZER_DIR = "/opt/tokenizers"
RANKS = "byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoding(folder: str = TOKENIZER_DIR, ranks: str = RANKS):
    """The tokenizer, loaded once per process."""
    import tiktoken

    with open(os.path.join(folder, ranks), "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(ranks, pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def _counter(folder: str, columns: int, names: list[str]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(folder).encode_ordinary
        for batch in batches:
            n = [None if t is None else len(encode(t)) for t in batch.column(columns).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:columns], pa.array(n, pa.int64())], names=names)

    return count


def token_counts(docs: DataFrame, keep: list[str], text: str, folder: str = TOKENIZER_DIR) -> DataFrame:
    """``keep..., n_tokens``; null texts have a null count, empty ones 0."""
    chosen = docs.select(*keep, F.col(text).alias("__text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema[:-1]] + ["n_tokens bigint"])
    return chosen.mapInArrow(_counter(folder, len(keep), [*keep, "n_tokens"]), schema)
