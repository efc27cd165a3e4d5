"""Ordered lists: DataFrames with a position column `pos`, counted from 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def renumber(items: DataFrame, order: list[Column]) -> DataFrame:
    """items with pos 0, 1, … in the given order.

    Range-sorted, then numbered by each partition's offset: no partition is ever in one task.
    """
    rows = items.drop("pos").orderBy(*order)
    numbered = rows.withColumn("_id", F.monotonically_increasing_id())
    part = F.shiftright("_id", 33)
    sizes = numbered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    pos = (F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1)).alias("pos")
    return numbered.withColumn("_part", part).join(F.broadcast(offsets), "_part").select(*rows.columns, pos)


def length(items: DataFrame) -> int:
    top = items.agg(F.max("pos")).first()[0]
    return 0 if top is None else top + 1


def concat(left: DataFrame, right: DataFrame) -> DataFrame:
    """left, then right."""
    return left.unionByName(right.withColumn("pos", F.col("pos") + F.lit(length(left))))


def slice_(items: DataFrame, start: int | None = None, stop: int | None = None, step: int = 1) -> DataFrame:
    """Items by Python's rules for start, stop and step, renumbered; negative values count from the end."""
    begin, end, by = slice(start, stop, step).indices(length(items))
    pos = F.col("pos")
    if by > 0:
        kept = items.filter((pos >= begin) & (pos < end) & ((pos - begin) % by == 0))
        return kept.withColumn("pos", F.floor((pos - begin) / by).cast("bigint"))
    kept = items.filter((pos <= begin) & (pos > end) & ((begin - pos) % -by == 0))
    return kept.withColumn("pos", F.floor((F.lit(begin) - pos) / -by).cast("bigint"))


def insert(items: DataFrame, at: int, rows: DataFrame) -> DataFrame:
    """rows (with pos from 0) before position at; positions beyond an end count as that end."""
    n = length(items)
    at = max(0, n + at) if at < 0 else min(at, n)
    shifted = items.withColumn("pos", F.when(F.col("pos") >= at, F.col("pos") + length(rows)).otherwise(F.col("pos")))
    return shifted.unionByName(rows.withColumn("pos", F.col("pos") + at))


def delete(items: DataFrame, at: int) -> DataFrame:
    """items without position at; negative positions count from the end, others that aren't there raise."""
    n = length(items)
    place = n + at if at < 0 else at
    if not 0 <= place < n:
        raise IndexError("position out of range")
    return items.filter(F.col("pos") != place).withColumn("pos", F.when(F.col("pos") > place, F.col("pos") - 1).otherwise(F.col("pos")))


def replace(items: DataFrame, at: int, values: dict[str, object]) -> DataFrame:
    """items with the named columns set at one position."""
    n = length(items)
    place = n + at if at < 0 else at
    if not 0 <= place < n:
        raise IndexError("position out of range")
    return items.withColumns({c: F.when(F.col("pos") == place, F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})


def reverse(items: DataFrame) -> DataFrame:
    return items.withColumn("pos", F.lit(length(items) - 1) - F.col("pos"))


def _same(columns: list[str], item: dict[str, object]) -> Column:
    match = F.lit(True)
    for c in columns:
        match = match & F.col(c).eqNullSafe(F.lit(item.get(c)))
    return match


def find(items: DataFrame, item: dict[str, object]) -> int | None:
    """Position of the first equal item (same value in every column but pos), or None."""
    columns = [c for c in items.columns if c != "pos"]
    return items.filter(_same(columns, item)).agg(F.min("pos")).first()[0]


def count(items: DataFrame, item: dict[str, object]) -> int:
    return items.filter(_same([c for c in items.columns if c != "pos"], item)).count()


def remove(items: DataFrame, item: dict[str, object]) -> DataFrame:
    """items without the first equal item; raises if there is none."""
    at = find(items, item)
    if at is None:
        raise ValueError("no such item")
    return delete(items, at)


def schema_difference(left: DataFrame, right: DataFrame) -> dict[str, list[str]]:
    """Columns that right lacks, has beyond left's, or has in another type."""
    a, b = dict(left.dtypes), dict(right.dtypes)
    return {"missing": sorted(a.keys() - b.keys()), "extra": sorted(b.keys() - a.keys()), "changed": sorted(k for k in a.keys() & b.keys() if a[k] != b[k])}


def numbered(items: DataFrame, scope: list[str], order: str, text: str) -> DataFrame:
    """(scope…, list): the texts of each scope as lines `1. text`, in order; nulls are left out. A list is as
    long as its scope's texts together."""
    rows = items.filter(F.col(text).isNotNull()).groupBy(*scope).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))).alias("_l"))
    return rows.select(*scope, F.array_join(F.transform("_l", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["t"])), "\n").alias("list"))
