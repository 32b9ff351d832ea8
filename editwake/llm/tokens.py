"""Token counts of whole texts by a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from editwake import session

VOCABULARY = os.environ.get("EDITWAKE_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: The word pattern that belongs to the vocabulary file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_tokens(df: DataFrame, text: str = "text", out: str = "tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """Adds out, the number of tokens of the whole text; NULL text has NULL, empty text 0. The text itself isn't carried on.

    The vocabulary file must lie at the same path on every executor.
    """
    others = [c for c in df.columns if c not in {text, out}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(vocabulary)
        for batch in batches:
            counts = [None if t is None else len(coder.encode_ordinary(t)) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64())], names=[*others, out])

    session.ship(df.sparkSession)
    chosen = df.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{text}`").alias("_ew_text"))
    schema = chosen.drop("_ew_text").schema.add(out, T.LongType())
    return session.widened(chosen).mapInArrow(run, schema)
