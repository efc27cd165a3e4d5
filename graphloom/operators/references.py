"""References to records that do not exist: orphans by null mask and declared match semantics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.keys import null_mask
from graphloom.operators.lookup import HOT_KEYS, HOT_ROWS

MATCH = ("simple", "partial", "full")


def key_states(targets: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: live (any row lives) and first_at (earliest creation).

    targets has the keys, live (boolean) and created_at. Rows with a null key are not reachable by
    that key and are left out.
    """
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return (
        targets.filter(known)
        .groupBy(*keys)
        .agg(F.max(F.col("live").cast("int")).alias("_live"), F.min("created_at").alias("_first"))
    )


def orphan_references(
    references: DataFrame, targets: DataFrame, keys: list[str], match: str = "simple"
) -> DataFrame:
    """The references that fail, with orphan_kind `missing`, `deleted`, `late` or `malformed`.

    references: ref_id, ref_field, ref_time and the key columns. targets: the key columns, live and
    created_at. References are grouped by their null mask, and each mask is matched on its non-null
    columns alone:

    - simple: a reference with any null key column refers to nothing and never fails;
    - partial: the non-null columns must occur together in some target; all null refers to nothing;
    - full: all columns null refers to nothing, some null is `malformed`.

    Defined results: a null ref_time never makes a reference late; an empty target table makes every
    reference missing; repeated reference rows (same ref_id, ref_field) come out once. Output:
    ref_id, ref_field, ref_time, orphan_kind.

    Plan: the references are pre-aggregated to one row per key before they meet the targets, so a hot
    key is one row there. Only failing keys go back to the rows; those with many rows, at most
    HOT_KEYS of them, by broadcast, the rest by a shuffle of keys of bounded size.
    """
    if match not in MATCH:
        raise ValueError(f"match must be one of {MATCH}")
    names = ["ref_id", "ref_field", "ref_time"]
    # private names, so that extra columns of the inputs can't clash
    kept = [f"_k{i}" for i in range(len(keys))]
    refs = references.select(*names, *[F.col(k).alias(p) for k, p in zip(keys, kept)])
    goal = targets.select("live", "created_at", *[F.col(k).alias(p) for k, p in zip(keys, kept)])
    refs = refs.withColumn("_mask", null_mask([F.col(p) for p in kept]))
    everything = (1 << len(keys)) - 1
    found = []
    if match == "full":
        found.append(
            refs.filter((F.col("_mask") != 0) & (F.col("_mask") != everything)).select(
                *names, F.lit("malformed").alias("orphan_kind")
            )
        )
    masks = range(everything) if match == "partial" else [0]
    for mask in masks:
        use = [p for i, p in enumerate(kept) if not mask >> i & 1]
        part = refs.filter(F.col("_mask") == mask).select(*names, *use)
        states = key_states(goal.select("live", "created_at", *use), use)
        asked = part.groupBy(*use).agg(
            F.count(F.lit(1)).alias("_n"), F.max("ref_time").alias("_last"), F.min("ref_time").alias("_from")
        )
        failing = (
            asked.join(states, use, "left")
            .filter(
                F.col("_live").isNull()
                | (F.col("_live") == 0)
                | (F.col("_first") > F.col("_from"))
            )
            .select(*use, "_n", "_live", "_first")
        )
        hot = F.broadcast(
            failing.filter(F.col("_n") >= HOT_ROWS).orderBy(F.desc("_n"), *use).limit(HOT_KEYS)
        )
        head = part.join(hot, use, "inner")
        tail = part.join(hot.select(*use), use, "left_anti").join(failing, use, "inner")
        kind = (
            F.when(F.col("_live").isNull(), "missing")
            .when(F.col("_live") == 0, "deleted")
            .when(F.col("_first") > F.col("ref_time"), "late")
        )
        found.append(
            head.unionByName(tail).select(*names, kind.alias("orphan_kind")).filter("orphan_kind is not null")
        )
    return reduce(DataFrame.unionByName, found).dropDuplicates(["ref_id", "ref_field"])


def orphan_report(orphans: DataFrame, by: list[str]) -> DataFrame:
    """References that fail, counted per `by` (say table and period) and kind."""
    return orphans.groupBy(*by, "orphan_kind").agg(F.count(F.lit(1)).alias("n_references"))
