"""Vectors of texts with a model of one's own: long texts in parts, blank and faulty ones set apart."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.vectors import hash_vector, mean_pool
from graphloom.operators.chunks import split_oversized

#: Takes texts and gives a vector for each, in order; it may raise for a batch that holds a bad text.
Embedder = Callable[[list[str]], list[list[float]]]
BLANK = ("reject", "quarantine", "zero_vector")


def hash_embedder(texts: list[str]) -> list[list[float]]:
    """The deterministic stand-in for a model."""
    return [hash_vector(t) for t in texts]


def embed_batch(texts: list[str], embedder: Embedder, size: int) -> list[tuple[list[float] | None, str | None]]:
    """(vector, error) of each text. A batch that fails, or comes back with another number of vectors, is
    halved until the bad text stands alone; a vector of another length is an error of its text."""
    if not texts:
        return []
    try:
        made = embedder(texts)
        if len(made) != len(texts):
            raise ValueError(f"{len(made)} vectors for {len(texts)} texts")
        return [(list(map(float, v)), None) if len(v) == size else (None, f"{len(v)} dimensions in place of {size}") for v in made]
    except Exception as failure:  # whatever a model raises
        if len(texts) == 1:
            return [(None, f"{type(failure).__name__}: {failure}")]
        half = len(texts) // 2
        return embed_batch(texts[:half], embedder, size) + embed_batch(texts[half:], embedder, size)


def embed_texts(rows: DataFrame, key: str, text: str, embedder: Embedder = hash_embedder, size: int = 64, most_tokens: int = 8000, per_batch: int = 10, blank: str = "quarantine") -> tuple[DataFrame, DataFrame]:
    """((key, vector), (key, error)): a vector per text, and the texts that have none, with the reason.

    Texts of more than most_tokens are cut into parts, whose vectors are averaged; one bad part sets the
    text apart. Parts go to the embedder in batches of per_batch. Null and blank texts: `reject` raises
    in the task, `quarantine` sets them apart, `zero_vector` gives zeros. key is unique.
    """
    if blank not in BLANK:
        raise ValueError(f"blank must be one of {BLANK}")
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, waiting = [], []
            for k, t in zip(batch[key], batch[text]):
                if not isinstance(t, str) or not t.strip():
                    if blank == "reject":
                        raise ValueError(f"the text of {k} is blank")
                    out.append((k, [0.0] * size, None) if blank == "zero_vector" else (k, None, "blank text"))
                else:
                    waiting += [(k, p) for p in split_oversized(t, most_tokens)]
            for at in range(0, len(waiting), per_batch):
                some = waiting[at : at + per_batch]
                out += [(k, v, e) for (k, _), (v, e) in zip(some, embed_batch([p for _, p in some], embedder, size))]
            yield pd.DataFrame(out, columns=[key, "vector", "error"])

    parts = rows.select(key, text).mapInPandas(run, f"{key} {kind}, vector array<double>, error string")
    faults = parts.filter("error is not null").groupBy(key).agg(F.min("error").alias("error"))
    good = parts.join(faults.select(key), key, "left_anti")
    return mean_pool(good, key, "vector"), faults
