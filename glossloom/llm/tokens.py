"""Tokens of a public byte-level tokenizer whose vocabulary file lies outside the repository."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Vocabulary file used by default; any byte-level BPE rank file will do.
DEFAULT_VOCABULARY = os.environ.get("TOKENIZER_FILE", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the splitting pattern of that vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoding(path: str = DEFAULT_VOCABULARY):
    """The encoding of a rank file, one per Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def safe(text: str) -> str:
    return text.encode("utf-8", "replace").decode()


def token_count(text: Column | str, path: str = DEFAULT_VOCABULARY) -> Column:
    """Tokens of a text; null for null."""

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoding(path)
        for s in batches:
            yield s.map(lambda t: None if t is None else len(enc.encode_ordinary(safe(t)))).astype("Int64")

    return count(text)
