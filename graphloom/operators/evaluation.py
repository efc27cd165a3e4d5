"""A predicted graph against labelled points and relations: matches, ratios and gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.course import UNDIRECTED
from graphloom.operators.lookup import known_hot, lookup_inner
from graphloom.operators.quality import ratio
from graphloom.session import cut_lineage

REQUIRED, ACCEPTABLE, FORBIDDEN = "required", "acceptable", "forbidden"
# --- fixed values: the default gates; at least, or at most where the name is in AT_MOST
THRESHOLDS = {
    "required_recall": 0.85, "effective_precision": 0.90, "extractable_outline_coverage": 0.85, "forbidden_leakage_rate": 0.0,
    "duplicate_rate": 0.05, "relation_precision": 0.80, "relation_recall": 0.75, "annotator_agreement": 0.80,
}
AT_MOST = ("forbidden_leakage_rate", "duplicate_rate")


def match_points(predicted: DataFrame, gold: DataFrame, names: DataFrame) -> DataFrame:
    """predicted with gold_id, label and ambiguous: the labelled point that each prediction means.

    predicted: id (one row per id), key, outline_id. gold: gold_id, label, outline_id. names: gold_id and
    key, a row per name or alias; keys are normalised. A required or acceptable point of the
    prediction's own section comes first; several of them, or none of them and several others, are
    ambiguous, and the smallest gold_id is taken. A null or empty key means nothing.
    """
    spelt = names.filter("key <> ''").distinct().join(gold.select("gold_id", "label", F.col("outline_id").alias("_where")), "gold_id")
    # labelled points of one key are few; each key's are gathered once, so a frequent name is a lookup
    by_key = spelt.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("gold_id", "label", "_where"))).alias("_all"))
    rows = predicted.select("id", "key", "outline_id")
    hit = lookup_inner(rows, by_key, ["key"], known_hot(rows, ["key"]))
    own = F.filter("_all", lambda g: (g["label"] != FORBIDDEN) & (g["_where"] == F.col("outline_id")))
    best = F.when(F.size(own) > 0, F.get(own, F.lit(0))).otherwise(F.get("_all", F.lit(0)))
    unclear = F.when(F.size(own) > 0, F.size(own) > 1).otherwise(F.size("_all") > 1)
    found = hit.select("id", best["gold_id"].alias("gold_id"), best["label"].alias("label"), unclear.alias("ambiguous"))
    return predicted.join(found, "id", "left")


def evaluate_graph(predicted: DataFrame, edges: DataFrame, gold: DataFrame, names: DataFrame, relations: DataFrame, labels: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """One row of ratios, counts and gates.

    predicted: id, key, outline_id, evidenced (boolean). edges: source_id, target_id, edge_type. gold,
    names: see match_points. relations: rel_id, label, source and target (gold ids), edge_type. labels:
    gold_id and label, a row per annotator. Ratios have six places; a ratio of nothing is 1, but 0 for
    leakage, duplicates and agreement. Relations between points that no labelled relation links are
    unscored. ambiguous counts predictions with several points, which a caller may take as an error.
    """
    limits = THRESHOLDS | (thresholds or {})
    gold = cut_lineage(gold.select("gold_id", "label", "outline_id"))
    # read by every count below
    matched = cut_lineage(match_points(predicted, gold, names))
    good = F.col("label").isin(REQUIRED, ACCEPTABLE)
    points = gold.select("gold_id", F.col("label").alias("_label"), F.col("outline_id").alias("_where"))
    # one row per labelled point that was predicted
    hit = matched.filter(F.col("gold_id").isNotNull()).groupBy("gold_id").agg(F.collect_set("outline_id").alias("_places")).join(points, "gold_id")
    placed = F.array_contains("_places", F.col("_where"))
    positive = F.col("_label") != FORBIDDEN
    n = lambda condition: F.count(F.when(condition, 1)).cast("double")
    parts = [
        matched.agg(
            F.count(F.lit(1)).cast("double").alias("predicted_nodes"), n(good).alias("_positive"), n(F.col("label") == FORBIDDEN).alias("forbidden_leaks"), n(F.col("evidenced")).alias("_evidenced"),
            F.count_distinct("key").cast("double").alias("_names"), n(F.col("ambiguous")).alias("ambiguous"),
        ),
        hit.agg(
            n(F.col("_label") == REQUIRED).alias("matched_required"), n(F.col("_label") == ACCEPTABLE).alias("matched_acceptable"), n(~positive).alias("_leaked"), n(positive & placed).alias("_placed"),
            F.count_distinct(F.when(positive & placed, F.col("_where"))).cast("double").alias("_covered"),
        ),
        gold.agg(n(F.col("label") == REQUIRED).alias("required_total"), n(F.col("label") == FORBIDDEN).alias("_forbidden"), F.count_distinct(F.when(F.col("label") != FORBIDDEN, F.col("outline_id"))).cast("double").alias("_extractable")),
        _relations(matched, edges, relations),
        _agreement(labels),
    ]
    c = F.col
    out = _one_row(parts).select(
        ratio(c("matched_required"), c("required_total")).alias("required_recall"),
        ratio(c("_positive"), c("predicted_nodes")).alias("effective_precision"),
        ratio(c("_leaked"), c("_forbidden"), 0.0).alias("forbidden_leakage_rate"),
        ratio(c("_placed"), c("matched_required") + c("matched_acceptable")).alias("outline_accuracy"),
        ratio(c("_covered"), c("_extractable")).alias("extractable_outline_coverage"),
        ratio(c("_evidenced"), c("predicted_nodes")).alias("evidence_coverage"),
        ratio(c("predicted_nodes") - c("_names"), c("predicted_nodes"), 0.0).alias("duplicate_rate"),
        ratio(c("matched_relations"), c("_assessed")).alias("relation_precision"),
        ratio(c("_found_required"), c("_required_relations")).alias("relation_recall"),
        ratio(c("_equal"), c("annotation_pairs"), 0.0).alias("annotator_agreement"),
        *[c(x).cast("bigint").alias(x) for x in ("annotation_pairs", "predicted_nodes", "matched_required", "required_total", "matched_acceptable", "forbidden_leaks", "ambiguous", "predicted_relations", "matched_relations", "unmatched_relations", "unscored_relations")],
    )
    passes = {name: (c(name) <= limit) if name in AT_MOST else (c(name) >= limit) for name, limit in limits.items()}
    failed = F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in sorted(passes.items())]))
    return out.withColumns({"failed_gates": F.array_join(failed, ","), "passed": F.size(failed) == 0})


def _one_row(parts: list[DataFrame]) -> DataFrame:
    """The columns of tables of one row each in one row, without a cross join."""
    pairs = [p.select(F.explode(F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).alias("v")) for c in p.columns])).alias("_x")).select("_x.*") for p in parts]
    every = reduce(DataFrame.unionByName, pairs)
    return every.agg(*[F.max(F.when(F.col("k") == c, F.col("v"))).alias(c) for p in parts for c in p.columns])


def _agreement(labels: DataFrame) -> DataFrame:
    each = labels.groupBy("gold_id", "label").agg(F.count(F.lit(1)).alias("n"))
    pairs = each.groupBy("gold_id").agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("e"), F.sum("n").alias("n"))
    return pairs.agg(F.coalesce(F.sum("e"), F.lit(0.0)).alias("_equal"), F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0.0)).alias("annotation_pairs"))


def _relations(matched: DataFrame, edges: DataFrame, relations: DataFrame) -> DataFrame:
    """One row of counts of predicted relations against labelled ones, by the points that their ends mean."""

    def keyed(rows: DataFrame, source: str, target: str) -> DataFrame:
        swap = F.col("edge_type").isin(*UNDIRECTED) & (F.col(source) > F.col(target))
        ends = {"_s": F.when(swap, F.col(target)).otherwise(F.col(source)), "_t": F.when(swap, F.col(source)).otherwise(F.col(target))}
        return rows.withColumns({**ends, "_a": F.least(source, target), "_b": F.greatest(source, target)})

    relations = cut_lineage(relations.select("rel_id", "label", "source", "target", "edge_type"))
    known = keyed(relations, "source", "target")
    # of labelled relations of one key the last id counts
    truth = known.groupBy("_s", "_t", "edge_type").agg(F.max(F.struct("rel_id", F.col("label").alias("_label"))).alias("_r")).select("_s", "_t", "edge_type", "_r.rel_id", "_r._label")
    pairs = known.select("_a", "_b").distinct().withColumn("_scoped", F.lit(True))
    ends = matched.filter(F.col("label") != FORBIDDEN).select("id", "gold_id")
    rows = edges.select("source_id", "target_id", "edge_type")
    for end in ("source", "target"):
        rows = lookup_inner(rows, ends.withColumnsRenamed({"id": f"{end}_id", "gold_id": f"_{end}"}), [f"{end}_id"], known_hot(rows, [f"{end}_id"]))
    # equal relations are one row with their number before they meet the labelled ones
    rows = keyed(rows, "_source", "_target").groupBy("_s", "_t", "_a", "_b", "edge_type").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.join(pairs, ["_a", "_b"], "left").join(truth, ["_s", "_t", "edge_type"], "left")
    scoped, right = F.coalesce("_scoped", F.lit(False)), F.coalesce(F.col("_label") != FORBIDDEN, F.lit(False))
    total = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).cast("double")
    counts = rows.agg(
        total(scoped).alias("_assessed"), total(~scoped).alias("unscored_relations"), total(scoped & ~right).alias("_wrong"),
        F.count_distinct(F.when(scoped & right, F.col("rel_id"))).cast("double").alias("matched_relations"),
        F.count_distinct(F.when(scoped & right & (F.col("_label") == REQUIRED), F.col("rel_id"))).cast("double").alias("_found_required"),
    )
    sizes = edges.agg(F.count(F.lit(1)).cast("double").alias("predicted_relations"))
    wanted = relations.agg(F.count(F.when(F.col("label") == REQUIRED, 1)).cast("double").alias("_required_relations"))
    out = _one_row([counts, sizes, wanted])
    return out.withColumn("unmatched_relations", F.col("predicted_relations") - F.col("_assessed") - F.col("unscored_relations") + F.col("_wrong")).drop("_wrong")
