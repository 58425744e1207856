"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rank file of the tokenizer; the path must be readable on every executor.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the split pattern that belongs to the rank file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoder(path: str = TOKENIZER):
    """The tokenizer of one rank file, loaded once a Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(path: str = TOKENIZER):
    """A pandas UDF: tokens of each text, whole; null for null, 0 for the empty text."""

    @F.pandas_udf("bigint")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder(path).encode_ordinary
        for s in texts:
            yield pd.Series([None if t is None else len(encode(t)) for t in s], dtype="Int64")

    return count


def with_tokens(documents: DataFrame, path: str = TOKENIZER, text: str = "text") -> DataFrame:
    """``documents`` without its text, with ``tokens``."""
    return documents.withColumn("tokens", token_counts(path)(F.col(text))).drop(text)
