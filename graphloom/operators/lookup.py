"""Joins of many rows to a table that has one row per key, safe where a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import cut_lineage

#: At most so many hot keys are broadcast, and none with fewer rows than HOT_ROWS counts as hot.
HOT_KEYS = 1000
HOT_ROWS = 100_000
#: Partitions over which a hot key is spread.
SALTS = 32


def hot_keys(
    rows: DataFrame, keys: list[str], most: int = HOT_KEYS, least_rows: int = HOT_ROWS
) -> DataFrame:
    """The up to `most` keys that have at least `least_rows` rows, with their count as n_rows.

    The count is pre-aggregated before its shuffle. Every key left out has fewer than least_rows
    rows, or at most a share of 1/most of all rows.
    """
    return (
        rows.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .filter(F.col("n_rows") >= least_rows)
        .orderBy(F.desc("n_rows"), *keys)
        .limit(most)
    )


def known_hot(rows: DataFrame, keys: list[str], most: int = HOT_KEYS, least_rows: int = HOT_ROWS) -> DataFrame | None:
    """hot_keys as a small table of its own, computed now; None where no key is hot."""
    hot = cut_lineage(hot_keys(rows, keys, most, least_rows))
    return hot if hot.take(1) else None


def lookup_inner(
    rows: DataFrame, by_key: DataFrame, keys: list[str], hot: DataFrame | None = None, salts: int = SALTS
) -> DataFrame:
    """rows ⋈ by_key on keys; by_key has one row per key, null keys match nothing.

    With `hot` (columns keys, at most HOT_KEYS rows, see known_hot) the rows of hot keys are spread over
    `salts` partitions each, and only their few rows of by_key are repeated; every other key stays
    whole. Without it the join is plain, and adaptive execution splits a partition that turns out
    skewed. No row is lost or doubled either way.
    """
    if hot is None:
        return rows.join(by_key, keys, "inner")
    few = F.broadcast(hot.select(*keys).withColumn("_hot", F.lit(True)))
    # a salt by the row's own content stays the same when a lost task is run again
    content = [c for c, kind in rows.dtypes if "map<" not in kind and "variant" not in kind]
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*content), F.lit(salts)).cast("int")).otherwise(0)
    all_salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    left = rows.join(few, keys, "left").withColumn("_salt", salt).drop("_hot")
    right = by_key.join(few, keys, "left").withColumn("_salt", F.explode(all_salts)).drop("_hot")
    return left.join(right, [*keys, "_salt"], "inner").drop("_salt")
