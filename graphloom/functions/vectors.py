"""Vector arithmetic as column expressions, and the deterministic stand-in for an embedder."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    """Sum of products; null if a vector is null."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 where a vector is missing or has no length."""
    lengths = norm(a) * norm(b)
    return F.when(lengths > 0, dot(a, b) / lengths).otherwise(F.lit(0.0))


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance."""
    gap = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, x: s + x * x))


def mean_pool(df, key: str, vector: str):
    """One mean vector per key, element by element; parts of other lengths than the first are padded by absence."""
    parts = df.select(key, F.posexplode(vector).alias("_at", "_x"))
    means = parts.groupBy(key, "_at").agg(F.avg("_x").alias("_x"))
    return means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_x"))), lambda s: s["_x"]).alias(vector))


def hash_vector(text: str, size: int = 64) -> list[float]:
    """Deterministic vector of a text: signed hashed letter trigrams, of length one."""
    v = np.zeros(size)
    low = f" {text.lower()} "
    for i in range(max(1, len(low) - 2)):
        h = int.from_bytes(hashlib.md5(low[i : i + 3].encode()).digest()[:8], "little")
        v[h % size] += 1.0 if h >> 63 else -1.0
    n = np.linalg.norm(v)
    return (v / n if n else v).astype("float32").tolist()


@F.pandas_udf(T.ArrayType(T.FloatType()))
def embed(texts: pd.Series) -> pd.Series:
    """hash_vector of each text; null for a null or blank one."""
    return pd.Series([hash_vector(t) if isinstance(t, str) and t.strip() else None for t in texts])
