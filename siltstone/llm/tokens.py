"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The vocabulary file is a parameter of every operator that measures texts; this is only its default.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of byte-level rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def counter(vocabulary: str, pattern: str = PATTERN) -> Callable[[str | None], int]:
    """A function from text to its number of tokens (null and empty: 0); read once per worker process."""
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    encode = tiktoken.Encoding("sizes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return lambda text: len(encode(text)) if text else 0


def n_tokens(text: Column, vocabulary: str = VOCABULARY) -> Column:
    @F.pandas_udf("int")
    def size(texts: pd.Series) -> pd.Series:
        count = counter(vocabulary)
        return texts.map(count).astype("int32")

    return size(text)
