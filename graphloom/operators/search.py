"""Vector search: top-k by distance, for one query or for a stated set of queries in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.vectors import distance

#: Queries that are sent to all rows at once: 2,000 of 1,000 floats are 8 MB.
QUERIES_PER_BLOCK = 2_000
#: Rows of a batch that are compared at once.
ROWS = 4_096


def search(items: DataFrame, key: str, vector: str, query: list[float], k: int) -> DataFrame:
    """The k nearest items by Euclidean distance, ties by key; items without a vector are left out."""
    if k <= 0:
        raise ValueError("k must be positive")
    near = distance(F.col(vector), F.array(*[F.lit(float(x)) for x in query]))
    return items.filter(F.col(vector).isNotNull()).withColumn("distance", near).orderBy("distance", key).limit(k)


def _blocks(queries: DataFrame, key: str, vector: str, per_block: int) -> Iterator[tuple[list, np.ndarray]]:
    """The queries in blocks of bounded size, streamed through the driver one partition at a time."""
    ids: list = []
    rows: list = []
    for row in queries.select(key, vector).filter(F.col(vector).isNotNull()).toLocalIterator():
        ids.append(row[0])
        rows.append(row[1])
        if len(ids) == per_block:
            yield ids, np.asarray(rows, dtype="float64")
            ids, rows = [], []
    if ids:
        yield ids, np.asarray(rows, dtype="float64")


def search_many(queries: DataFrame, items: DataFrame, key: str, vector: str, k: int, per_block: int = QUERIES_PER_BLOCK) -> DataFrame:
    """(query, rank, <key>, distance): for each query its k nearest items by Euclidean distance.

    Ties go by key; an item of the query's own key is not its neighbour. Exact: each block of queries
    is compared with all items, batch by batch; a task keeps k items per query of its own, and the
    tasks' lists are merged by key. Nulls and vectors of another length than the queries' are left out.
    """
    spark = items.sparkSession
    kind = items.schema[key].dataType.simpleString()
    parts = None
    for ids, matrix in _blocks(queries, key, vector, per_block):
        block = spark.sparkContext.broadcast((ids, matrix))

        def nearest(batches: Iterator[pd.DataFrame], block=block) -> Iterator[pd.DataFrame]:
            own, q = block.value
            own_ids = np.asarray(own)
            q2 = (q * q).sum(axis=1)[:, None]
            best = pd.DataFrame({"query": own_ids[:0], key: own_ids[:0], "distance": np.zeros(0)})
            for batch in batches:
                batch = batch[batch[vector].map(lambda v: v is not None and len(v) == q.shape[1])]
                for at in range(0, len(batch), ROWS):
                    some = batch.iloc[at : at + ROWS]
                    v = np.asarray(some[vector].tolist(), dtype="float64")
                    d2 = q2 - 2 * q @ v.T + (v * v).sum(axis=1)[None, :]
                    names = some[key].to_numpy()
                    d2[own_ids[:, None] == names[None, :]] = np.inf
                    # all rows as near as the k-th, with a margin for the rounding of d2, so that no tie is lost
                    kth = np.partition(d2, k - 1, axis=1)[:, k - 1 : k] if k < d2.shape[1] else np.full((len(own_ids), 1), np.inf)
                    near = (d2 <= kth + 1e-9 * (q2 + (v * v).sum(axis=1)[None, :])) & np.isfinite(d2)
                    found = []
                    for i in range(len(own_ids)):
                        cols = np.flatnonzero(near[i])
                        exact = np.sqrt(((q[i] - v[cols]) ** 2).sum(axis=1))
                        cut = np.lexsort((names[cols], exact))[:k]
                        found.append((np.full(len(cut), i), cols[cut], exact[cut]))
                    rows, flat, exact = (np.concatenate(x) for x in zip(*found))
                    found = pd.DataFrame({"query": own_ids[rows], key: names[flat], "distance": exact})
                    best = pd.concat([best, found]).sort_values(["query", "distance", key]).groupby("query", sort=False).head(k)
            yield best

        part = items.select(key, vector).mapInPandas(nearest, f"query {kind}, {key} {kind}, distance double")
        parts = part if parts is None else parts.unionByName(part)
    if parts is None:
        return spark.createDataFrame([], f"query {kind}, rank int, {key} {kind}, distance double")
    # k rows per task and query: bounded lists
    best = parts.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", key))), 1, k).alias("_best"))
    return best.select("query", F.posexplode("_best").alias("rank", "_b")).select("query", (F.col("rank") + 1).alias("rank"), f"_b.{key}", "_b.distance")


def similar_many(queries: DataFrame, items: DataFrame, key: str, vector: str, least: float, per_block: int = QUERIES_PER_BLOCK) -> DataFrame:
    """(query, <key>, similarity): all items with a cosine of at least `least` to each query.

    A vector of no length is similar to nothing; an item of the query's own key is left out.
    """
    spark = items.sparkSession
    kind = items.schema[key].dataType.simpleString()
    parts = None
    for ids, matrix in _blocks(queries, key, vector, per_block):
        block = spark.sparkContext.broadcast((ids, matrix))

        def similar(batches: Iterator[pd.DataFrame], block=block) -> Iterator[pd.DataFrame]:
            own, q = block.value
            own_ids = np.asarray(own)
            unit = lambda m: m / np.where((n := np.linalg.norm(m, axis=1, keepdims=True)) > 0, n, np.inf)
            q = unit(q)
            for batch in batches:
                batch = batch[batch[vector].map(lambda v: v is not None and len(v) == q.shape[1])]
                for at in range(0, len(batch), ROWS):
                    some = batch.iloc[at : at + ROWS]
                    names = some[key].to_numpy()
                    s = q @ unit(np.asarray(some[vector].tolist(), dtype="float64")).T
                    i, j = np.nonzero(s >= least)
                    keep = own_ids[i] != names[j]
                    yield pd.DataFrame({"query": own_ids[i][keep], key: names[j][keep], "similarity": s[i, j][keep]})

        part = items.select(key, vector).mapInPandas(similar, f"query {kind}, {key} {kind}, similarity double")
        parts = part if parts is None else parts.unionByName(part)
    return parts if parts is not None else spark.createDataFrame([], f"query {kind}, {key} {kind}, similarity double")


def context_text(found: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """One row: the found items (a bounded top-k) as JSON lines in order, joined as an answer's context."""
    rows = found.agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.to_json(F.struct(*columns)).alias("_j")))).alias("_rows"))
    return rows.select(F.array_join(F.transform("_rows", lambda r: r["_j"]), "\n---\n").alias("context"))
