"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import cut_lineage

#: Ranges of the random key per source. Keys are uniform, so a source of any size is spread evenly over
#: them, and the table of range sums has at most BUCKETS rows per source of the targets.
BUCKETS = 1024


def source_key(source: Column) -> Column:
    """A source name: case, white space at its ends, and spaces or hyphens for underscores don't count."""
    key = F.regexp_replace(F.lower(F.regexp_replace(source, r"^[\p{Z}\s]+|[\p{Z}\s]+$", "")), r"[\s\-]+", "_")
    return F.when(F.length(key) > 0, key)


def _keyed(documents: DataFrame, targets: DataFrame, seed: int) -> DataFrame:
    named = F.broadcast(targets.select("source").distinct())
    key = F.xxhash64(F.col("doc_id"), F.lit(seed))
    # the key's 64 bits in BUCKETS equal ranges, smallest first
    bucket = F.shiftright(key, 64 - BUCKETS.bit_length() + 1)
    return documents.join(named, "source").select("doc_id", "source", "n_tokens", key.alias("_key"), bucket.alias("_bucket"))


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(uses, shares): how often each document is used, and what each source contributes.

    documents: doc_id (unique), source, n_tokens; a source that isn't in targets isn't used. targets:
    source, target_share, max_repeats. Each source is given target_share of total_tokens; by default
    that is the largest total of which every source that has any text can fill its share. A source is
    used whole as often as its budget holds it, then once more up to the place where its documents, in
    the order of a seeded hash of doc_id, reach the budget exactly or would pass it. So a source ends
    within one document below its budget, unless max_repeats of all of its text isn't enough.

    uses: doc_id, source, n_tokens, n_uses (at least 1). shares: source, target_share, actual_share,
    budget_tokens, used_tokens, available_tokens, n_documents, max_repeats; a source without text has
    zeros. Null token counts or shares count as 0, a null max_repeats as 1. Documents without any
    token are used like others of their place.

    Plan: range-sorting is by equal ranges of the hash (a hash partitioning of (source, range)); the
    range sums, BUCKETS rows a source, give each range its offset; a window within each range gives
    the prefix sums. No source is ever in one task.
    """
    documents = documents.withColumn("n_tokens", F.coalesce("n_tokens", F.lit(0)).cast("bigint"))
    targets = targets.select(
        "source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).alias("max_repeats")
    ).dropDuplicates(["source"])
    rows = cut_lineage(_keyed(documents, targets, seed))
    sums = cut_lineage(rows.groupBy("source", "_bucket").agg(F.sum("n_tokens").alias("_sum"), F.count(F.lit(1)).alias("_n")))
    have = targets.join(sums.groupBy("source").agg(F.sum("_sum").alias("available_tokens"), F.sum("_n").alias("n_documents")), "source", "left").fillna(0, ["available_tokens", "n_documents"])
    if total_tokens is None:
        can = have.filter("available_tokens > 0 and target_share > 0 and max_repeats > 0")
        limit = can.agg(F.min(F.col("available_tokens") * F.col("max_repeats") / F.col("target_share"))).first()[0]
        total_tokens = int(limit or 0)
    budget = F.floor(F.col("target_share") * F.lit(total_tokens) + 1e-6).cast("bigint")
    rounds = F.least(F.when(F.col("available_tokens") > 0, F.floor(F.col("budget_tokens") / F.col("available_tokens"))).otherwise(0), F.col("max_repeats"))
    plan = cut_lineage(
        have.withColumn("budget_tokens", budget)
        .withColumn("_rounds", rounds.cast("bigint"))
        .withColumn("_rest", F.when(F.col("_rounds") < F.col("max_repeats"), F.col("budget_tokens") - F.col("_rounds") * F.col("available_tokens")).otherwise(-1))
    )
    # BUCKETS rows per source at most
    before = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum", "_n")
    inside = Window.partitionBy("source", "_bucket").orderBy("_key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        rows.join(F.broadcast(offsets), ["source", "_bucket"])
        .withColumn("_upto", F.col("_before") + F.sum("n_tokens").over(inside))
        .join(F.broadcast(plan.select("source", "_rounds", "_rest")), "source")
    )
    uses = placed.select(
        "doc_id", "source", "n_tokens", (F.col("_rounds") + F.when(F.col("_upto") <= F.col("_rest"), 1).otherwise(0)).cast("int").alias("n_uses")
    ).filter("n_uses > 0")
    used = uses.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n_uses")).alias("used_tokens"))
    shares = plan.join(used, "source", "left").fillna(0, ["used_tokens"])
    everything = F.sum("used_tokens").over(Window.partitionBy())  # one row per source
    shares = shares.select(
        "source",
        "target_share",
        F.coalesce(F.try_divide(F.col("used_tokens"), everything), F.lit(0.0)).alias("actual_share"),
        "budget_tokens",
        "used_tokens",
        "available_tokens",
        "n_documents",
        "max_repeats",
    )
    return uses, shares
