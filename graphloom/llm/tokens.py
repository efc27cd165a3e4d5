"""Token counts by a public tokenizer, in Arrow batches."""

from __future__ import annotations

import base64
import hashlib
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: A vocabulary of byte-level BPE ranks; another file of that kind may be named instead.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How such vocabularies cut a text into pieces before merging (fixed value of the vocabulary).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: Tokenisers of this worker, by the digest of their vocabulary.
_MADE: dict[str, object] = {}


def _encoding(name: str, vocabulary: bytes):
    if name not in _MADE:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        _MADE[name] = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _MADE[name]


def count_tokens(text: Column, path: str = VOCABULARY) -> Column:
    """Tokens of the whole text; 0 for a null or empty one.

    The vocabulary, some 700 KB, is read by the driver and broadcast, so executors need no copy of it.
    """
    data = Path(path).read_bytes()
    name, sent = hashlib.sha256(data).hexdigest(), SparkSession.active().sparkContext.broadcast(data)

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        encode = _encoding(name, sent.value).encode_ordinary
        return pd.Series([len(encode(t)) if isinstance(t, str) else 0 for t in texts], dtype="int64")

    return count(text)
