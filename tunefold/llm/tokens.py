"""Sizes of texts in tokens of a public tokenizer, whose vocabulary file is a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the splitting pattern that belongs to this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_loaded: dict[str, object] = {}


def encoding(vocabulary: str = VOCABULARY):
    """The tokenizer of a vocabulary file, loaded once per process."""
    if vocabulary not in _loaded:
        import base64

        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[vocabulary] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[vocabulary]


def token_count(text: Column | str, vocabulary: str = VOCABULARY) -> Column:
    """Number of tokens of a text; null and empty texts have none. Very long texts are counted whole."""

    def run(texts):
        import pandas as pd

        e = encoding(vocabulary)
        return pd.Series([len(e.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    return F.pandas_udf(run, T.LongType())(text)
