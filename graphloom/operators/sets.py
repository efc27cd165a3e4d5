"""Algebra of keyed sets: DataFrames with one row per key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.lists import renumber
from graphloom.operators.merge import keyed_merge


def union(left: DataFrame, right: DataFrame, key: list[str], strategy: str = "keep_existing", seq: str = "_side") -> DataFrame:
    """Rows of both, those of one key merged, left before right."""
    both = left.withColumn(seq, F.lit(0)).unionByName(right.withColumn(seq, F.lit(1)))
    return keyed_merge(both, key, [seq], strategy).drop(seq)


def intersection(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Rows of left whose key is in right."""
    return left.join(right.select(*key), key, "left_semi")


def difference(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Rows of left whose key is not in right."""
    return left.join(right.select(*key), key, "left_anti")


def symmetric_difference(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key is on one side only."""
    return difference(left, right, key).unionByName(difference(right, left, key))


def relation(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """One row: equal, subset, proper_subset, superset, proper_superset and disjoint, by keys.

    Both sides are compared in one full join; an empty set is a subset of any and disjoint from any.
    """
    a, b = left.select(*key).distinct().withColumn("_a", F.lit(1)), right.select(*key).distinct().withColumn("_b", F.lit(1))
    n = a.join(b, key, "full").agg(
        F.count(F.when(F.col("_b").isNull(), 1)).alias("l"),
        F.count(F.when(F.col("_a").isNull(), 1)).alias("r"),
        F.count(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), 1)).alias("m"),
    )
    left_only, right_only, shared = F.col("l") > 0, F.col("r") > 0, F.col("m") > 0
    return n.select(
        (~left_only & ~right_only).alias("equal"),
        (~left_only).alias("subset"),
        (~left_only & right_only).alias("proper_subset"),
        (~right_only).alias("superset"),
        (~right_only & left_only).alias("proper_superset"),
        (~shared).alias("disjoint"),
    )


def equal_in_order(left: DataFrame, right: DataFrame, key: list[str], seq: str, other_seq: str | None = None) -> DataFrame:
    """One row: equal, whether both sets have the same keys in the same order (left by seq, right by
    other_seq or seq). Two empty sets are equal. Places are compared in one join, sorted by range."""
    a = renumber(left.select(*key, F.col(seq).alias("_o")), [F.col("_o"), *map(F.col, key)]).select("pos", F.struct(*key).alias("_a"))
    b = renumber(right.select(*key, F.col(other_seq or seq).alias("_o")), [F.col("_o"), *map(F.col, key)]).select("pos", F.struct(*key).alias("_b"))
    return a.join(b, "pos", "full").agg((F.count(F.when(~F.col("_a").eqNullSafe(F.col("_b")), 1)) == 0).alias("equal"))


def layers(rows: list[DataFrame], key: str, value: str) -> DataFrame:
    """(key, value) of several layers in one: a key's value of the first layer that has it, the smallest there."""
    every = [r.select(key, value, F.lit(i).alias("_layer")) for i, r in enumerate(rows)]
    return reduce(DataFrame.unionByName, every).filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(value, F.struct("_layer", value)).alias(value))


def add(items: DataFrame, more: DataFrame, key: list[str], strategy: str = "keep_existing") -> DataFrame:
    """items with more merged in."""
    return union(items, more, key, strategy)


def remove(items: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    """items without the given keys; keys that aren't there don't matter."""
    return difference(items, keys, key)


def pop(items: DataFrame, seq: str) -> tuple[DataFrame, DataFrame]:
    """(first item by seq, the others)."""
    first = items.orderBy(seq).limit(1)
    return first, items.join(first.select(seq), seq, "left_anti")
