"""Keyed merge: many rows per key to one, by a named strategy or a merger of one's own."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STRATEGIES = ("keep_existing", "keep_incoming", "merge_field", "rule")


def _field(column: str, kind: T.DataType, seq: list[str], role: str) -> Column:
    """The merged value of a column: see keyed_merge."""
    value, order = F.col(column), F.struct(*seq)
    if isinstance(kind, T.ArrayType):
        rows = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(order.alias("o"), value.alias("v")))))
        joined = F.flatten(F.transform(rows, lambda r: r["v"]))
        return F.array_sort(F.array_distinct(joined)) if role == "rule" else joined
    if role == "rule":
        if isinstance(kind, T.NumericType) and not isinstance(kind, T.BooleanType):
            return F.round(F.avg(value), 0).cast(kind)
        if column in ("description", "summary", "evidence"):
            rows = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(order.alias("o"), value.alias("v")))))
            return F.array_join(F.array_distinct(F.transform(rows, lambda r: r["v"])), "\n")
        return F.mode(value, True)
    return F.max_by(value, F.when(value.isNotNull(), order))


def keyed_merge(rows: DataFrame, key: list[str], seq: list[str], strategy: str = "keep_existing") -> DataFrame:
    """One row per key.

    seq orders the rows of a key totally; rows equal in seq count as one position. keep_existing: the
    first row. keep_incoming: the last. merge_field: column by column the last non-null value, arrays
    joined in order. rule: numbers averaged and rounded, descriptions joined as distinct lines, other
    strings by the most frequent value (the smallest of equals), arrays as sorted distinct union.
    Rows whose key is null are one group. Columns of key and seq keep their names; seq becomes the
    position of the surviving row (the first one's for merge_field and rule).

    keep_* combine before the shuffle, so a hot key is a few rows. merge_field does so too but for
    arrays, which are as long as their group's arrays together: that is their result.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    rest = [f for f in rows.schema.fields if f.name not in key + seq]
    order = F.struct(*seq)
    if strategy.startswith("keep"):
        pick = F.min_by if strategy == "keep_existing" else F.max_by
        whole = F.struct(*seq, *[f.name for f in rest])
        out = rows.groupBy(*key).agg(pick(whole, order).alias("_row"))
        return out.select(*key, "_row.*").select(*rows.columns)
    role = "rule" if strategy == "rule" else "field"
    first = F.min(order).alias("_seq")
    out = rows.groupBy(*key).agg(first, *[_field(f.name, f.dataType, seq, role).alias(f.name) for f in rest])
    return out.select(*key, "_seq.*", *[f.name for f in rest]).select(*rows.columns)


def merge_by(rows: DataFrame, key: list[str], seq: list[str], merger: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """One row per key by a merger of one's own, which gets a key's rows in order and returns one row.

    A merger sees a whole key at once, so keys have to be of a size a task can hold.
    """
    return rows.groupBy(*key).applyInPandas(lambda g: merger(g.sort_values(seq)), rows.schema)


def longest_merge(rows: DataFrame, key: list[str], seq: list[str], longest: list[str], unions: list[str], most: list[str]) -> DataFrame:
    """Strictly longer texts win over earlier ones, arrays are united sorted and distinct, numbers take
    their maximum, everything else comes from the first row."""
    rest = [f.name for f in rows.schema.fields if f.name not in key + longest + unions + most]
    order = F.struct(*seq)
    aggregates = [F.min_by(F.struct(*rest), order).alias("_first")]
    # the longest, and of equals the one that came first: keys of seq are numbers
    aggregates += [F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(F.length(c), *[-F.col(s) for s in seq]))).alias(c) for c in longest]
    aggregates += [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in unions]
    aggregates += [F.max(c).alias(c) for c in most]
    return rows.groupBy(*key).agg(*aggregates).select(*key, "_first.*", *longest, *unions, *most).select(*rows.columns)


def best_edges(edges: DataFrame, seq: str, undirected: tuple[str, ...] = ("related", "confusable")) -> DataFrame:
    """One edge per (source, target, edge_type): the most confident, of equals the first.

    Edges of undirected types have their ends in order first. A null confidence is lowest.
    """
    swap = F.col("edge_type").isin(*undirected) & (F.col("source") > F.col("target"))
    turned = edges.withColumns(
        {"source": F.when(swap, F.col("target")).otherwise(F.col("source")), "target": F.when(swap, F.col("source")).otherwise(F.col("target"))}
    )
    key = ["source", "target", "edge_type"]
    rest = [c for c in edges.columns if c not in key]
    best = F.max_by(F.struct(*rest), F.struct(F.coalesce("confidence", F.lit(-1.0)), -F.col(seq)))
    return turned.groupBy(*key).agg(best.alias("_e")).select(*key, "_e.*").select(*edges.columns)
