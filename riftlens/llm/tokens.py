"""Token counts with a public byte-pair vocabulary, read in place and never trained or copied."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql.functions import pandas_udf

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The published split pattern of this vocabulary.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoding(path: str = VOCABULARY):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("riftlens", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def count(text: str | None, path: str = VOCABULARY) -> int:
    """Tokens of a text; null and empty texts have none, special-token strings are ordinary text."""
    return len(encoding(path).encode_ordinary(text)) if text else 0


def token_count(column: str | Column, path: str = VOCABULARY) -> Column:
    @pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoding(path).encode_ordinary
        for texts in batches:
            yield pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int64")

    return run(column)


def with_tokens(df: DataFrame, text: str = "text", out: str = "tokens", path: str = VOCABULARY) -> DataFrame:
    return df.withColumn(out, token_count(df[text], path))
