"""Checks and measures of extracted graphs: gates with reasons, coverage, agreement with labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import normal_name, title_key
from graphloom.operators.lookup import known_hot, lookup_inner


def _blank(c: Column) -> Column:
    return F.coalesce(F.length(F.trim(c)), F.lit(0)) == 0


def repair_parents(nodes: DataFrame, outline: DataFrame) -> DataFrame:
    """Nodes whose name is the title of exactly one outline entry of their scope get it as parent.

    nodes: scope, name, parent_outline_id. outline: scope, outline_id, title.
    """
    titles = outline.select("scope", title_key(F.col("title")).alias("_key"), "outline_id").filter("_key <> ''").groupBy("scope", "_key")
    one = titles.agg(F.count(F.lit(1)).alias("_n"), F.min("outline_id").alias("_only")).filter("_n = 1").drop("_n")
    keyed = nodes.withColumn("_key", normal_name(F.col("name")))
    return keyed.join(one, ["scope", "_key"], "left").withColumn("parent_outline_id", F.coalesce("_only", "parent_outline_id")).select(*nodes.columns)


def gate_nodes(nodes: DataFrame, outline: DataFrame, seq: str, least_evidence: int = 1, longest_name: int = 60) -> DataFrame:
    """nodes with reason: null where accepted, else the first of missing_evidence,
    missing_parent_outline, unknown_outline, name_too_long, missing_summary, duplicate_node.

    nodes: scope, name, evidence, summary, parent_outline_id and seq, which orders them; duplicates
    are later accepted nodes of one normalised name in a scope. outline: scope, outline_id.
    """
    known = outline.select("scope", F.col("outline_id").alias("parent_outline_id")).distinct().withColumn("_known", F.lit(True))
    reason = (
        F.when(F.coalesce(F.length(F.trim("evidence")), F.lit(0)) < least_evidence, "missing_evidence")
        .when(_blank(F.col("parent_outline_id")), "missing_parent_outline")
        .when(F.col("_known").isNull(), "unknown_outline")
        .when(F.length(F.trim("name")) > longest_name, "name_too_long")
        .when(_blank(F.col("summary")), "missing_summary")
    )
    judged = nodes.join(known, ["scope", "parent_outline_id"], "left").withColumn("reason", reason).drop("_known")
    judged = judged.withColumn("_key", normal_name(F.col("name")))
    # the first accepted of each name, pre-aggregated, so that a frequent name is no large group
    first = judged.filter("reason is null").groupBy("scope", "_key").agg(F.min(seq).alias("_first"))
    judged = judged.join(first, ["scope", "_key"], "left")
    duplicate = F.col("reason").isNull() & (F.col(seq) != F.col("_first"))
    return judged.withColumn("reason", F.when(duplicate, "duplicate_node").otherwise(F.col("reason"))).select(*nodes.columns, "reason")


def gate_edges(edges: DataFrame, names: DataFrame, seq: str, undirected: tuple[str, ...] = ("related", "confusable"), broad: str = "related") -> DataFrame:
    """edges, ends of undirected types in order, with reason: null where accepted, else unknown_endpoint,
    self_loop, missing_relation_evidence, duplicate_edge (not the most confident of its key, ties by
    seq) or weaker_relation_conflict (a broad edge where another type links the same pair).

    edges: scope, source, target, edge_type, description, confidence and seq. names: scope, name.
    """
    for end in ("source", "target"):
        known = names.select("scope", F.col("name").alias(end)).filter("name is not null").distinct().withColumn(f"_{end}", F.lit(True))
        # an end such as a node that a tenth of all edges points to is spread by salts
        hit = lookup_inner(edges, known, ["scope", end], known_hot(edges, ["scope", end]))
        edges = hit.unionByName(edges.join(known, ["scope", end], "left_anti"), allowMissingColumns=True)
    unknown = F.col("_source").isNull() | F.col("_target").isNull()
    reason = (
        F.when(unknown, "unknown_endpoint")
        .when(F.col("source") == F.col("target"), "self_loop")
        .when(_blank(F.col("description")), "missing_relation_evidence")
    )
    swap = F.col("edge_type").isin(*undirected) & (F.col("source") > F.col("target")) & F.lit(True)
    judged = edges.withColumn("reason", reason).drop("_source", "_target")
    turn = F.col("reason").isNull() & swap
    judged = judged.withColumns(
        {"source": F.when(turn, F.col("target")).otherwise(F.col("source")), "target": F.when(turn, F.col("source")).otherwise(F.col("target"))}
    )
    key = ["scope", "source", "target", "edge_type"]
    order = F.struct(F.coalesce("confidence", F.lit(-1.0)), -F.col(seq))
    best = judged.filter("reason is null").groupBy(*key).agg(F.max_by(seq, order).alias("_best"))
    pair = [F.col("scope"), F.least("source", "target").alias("_a"), F.greatest("source", "target").alias("_b")]
    specific = best.filter(F.col("edge_type") != broad).select(*pair).distinct().withColumn("_specific", F.lit(True))
    judged = judged.join(best, key, "left").withColumns({"_a": F.least("source", "target"), "_b": F.greatest("source", "target")})
    judged = judged.join(specific, ["scope", "_a", "_b"], "left")
    late = (
        F.when(F.col("reason").isNotNull(), F.col("reason"))
        .when(F.col(seq) != F.col("_best"), "duplicate_edge")
        .when((F.col("edge_type") == broad) & F.col("_specific"), "weaker_relation_conflict")
    )
    columns = [c for c in edges.columns if c not in ("_source", "_target")]
    return judged.withColumn("reason", late).select(*columns, "reason")


def coverage(tree: DataFrame, covered: DataFrame, scope: str, node: str) -> DataFrame:
    """(scope, sections, direct, hierarchical, coverage): nodes of the hierarchy that are covered
    themselves, or have a covered node below them.

    tree: hierarchy(paths=True). covered: scope and node. Nodes without a path count as not covered.
    """
    direct = covered.select(scope, node).distinct()
    ancestors = tree.join(direct, [scope, node], "left_semi").select(scope, F.explode("path").alias(node)).distinct()
    rows = tree.select(scope, node).join(ancestors.withColumn("_h", F.lit(1)), [scope, node], "left").join(direct.withColumn("_d", F.lit(1)), [scope, node], "left")
    out = rows.groupBy(scope).agg(F.count(F.lit(1)).alias("sections"), F.count("_d").alias("direct"), F.count("_h").alias("hierarchical"))
    return out.withColumn("coverage", F.round(F.col("hierarchical") / F.col("sections"), 4))


def ratio(part: Column, whole: Column, empty: float = 1.0) -> Column:
    """part / whole to six places; `empty` where whole is 0 or null."""
    return F.coalesce(F.round(F.try_divide(part.cast("double"), whole), 6), F.lit(empty))


def evaluate(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """One row of measures of predicted nodes against labelled ones.

    predicted: name, outline_id. gold: gold_id, label (required, acceptable or forbidden), names (array
    of name and aliases), outline_id. A prediction matches gold nodes by any normalised name; where it
    matches several, a positive one of its own outline entry counts first, then the smallest gold_id.
    """
    spelt = gold.select("gold_id", "label", F.col("outline_id").alias("_where"), F.explode("names").alias("_n"))
    spelt = spelt.select("gold_id", "label", "_where", normal_name(F.col("_n")).alias("_key")).filter("_key <> ''").distinct()
    own = predicted.withColumns({"_id": F.monotonically_increasing_id(), "_key": normal_name(F.col("name"))})
    inside = (F.col("label") != "forbidden") & F.col("_where").eqNullSafe(F.col("outline_id"))
    matched = own.join(spelt, "_key", "left").groupBy("_id").agg(
        F.min_by(F.struct("gold_id", "label", inside.alias("placed")), F.struct(F.when(inside, 0).otherwise(1), "gold_id")).alias("m"), F.first("_key").alias("_key")
    )
    total = matched.agg(
        F.count(F.lit(1)).alias("predicted"),
        F.count(F.when(F.col("m.label").isin("required", "acceptable"), 1)).alias("positive"),
        F.count(F.when(F.col("m.label") == "forbidden", 1)).alias("leaks"),
        F.count_distinct(F.when(F.col("m.label") == "required", F.col("m.gold_id"))).alias("found_required"),
        F.count_distinct(F.when(F.col("m.label").isin("required", "acceptable"), F.col("m.gold_id"))).alias("found_positive"),
        F.count_distinct(F.when(F.col("m.placed"), F.col("m.gold_id"))).alias("found_placed"),
        F.count_distinct("_key").alias("names"),
    )
    wanted = gold.filter(F.col("label") == "required").count()
    return total.withColumn("required", F.lit(wanted)).select(
        "predicted",
        ratio(F.col("found_required"), F.col("required")).alias("recall"),
        ratio(F.col("positive"), F.col("predicted"), 0.0).alias("precision"),
        ratio(F.col("found_placed"), F.col("found_positive")).alias("placement"),
        ratio(F.col("leaks"), F.col("predicted"), 0.0).alias("leakage"),
        ratio(F.col("predicted") - F.col("names"), F.col("predicted"), 0.0).alias("duplicates"),
    )


def agreement(labels: DataFrame, item: str, label: str) -> DataFrame:
    """One row: equal, compared and agreement over all pairs of labels of one item.

    n labels of which c are equal hold c (c - 1) / 2 equal pairs, so no pair is ever made.
    """
    each = labels.groupBy(item, label).agg(F.count(F.lit(1)).alias("c"))
    items = each.groupBy(item).agg(F.sum("c").alias("n"), F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("e"))
    out = items.agg(F.coalesce(F.sum("e"), F.lit(0)).cast("bigint").alias("equal"), F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0)).cast("bigint").alias("compared"))
    return out.withColumn("agreement", ratio(F.col("equal"), F.col("compared"), 0.0))


def quarantine(records: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(good, bad, summary): records that pass all checks; the others with `violations`, the names of
    the checks that failed; one row with valid, rejected and ratio. A check that is null has failed."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))
    judged = records.withColumn("violations", failed)
    bad = F.size("violations") > 0
    summary = judged.agg(F.count(F.when(~bad, 1)).alias("valid"), F.count(F.when(bad, 1)).alias("rejected"))
    return judged.filter(~bad).drop("violations"), judged.filter(bad), summary.withColumn("ratio", ratio(F.col("rejected"), F.col("valid") + F.col("rejected"), 0.0))


def quarantine_report(bad: DataFrame, total: DataFrame, path: str, item: list[str], request: str, seq: str, most: float = 0.2, fail: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rejections, summary) of quarantine()'s bad records out of total, both with the columns request and seq.

    rejections: request, schema_path (`path[seq].check`), fingerprint (SHA-256 of the item as JSON), the
    violations. summary, a row per request: valid, rejected, ratio, status and failed. A request fails
    where more than `most` of its items are rejected, or any if `fail`; status is completed,
    completed_with_rejections or failed.
    """
    rows = bad.select(request, F.concat(F.lit(f"{path}["), F.col(seq).cast("string"), F.lit("]."), F.get("violations", F.lit(0))).alias("schema_path"), F.sha2(F.to_json(F.struct(*item)), 256).alias("fingerprint"), "violations")
    sizes = total.groupBy(request).agg(F.count(F.lit(1)).alias("_n")).join(bad.groupBy(request).agg(F.count(F.lit(1)).alias("rejected")), request, "left").fillna(0, ["rejected"])
    share = ratio(F.col("rejected"), F.col("_n"), 0.0)
    failed = (F.col("rejected") > 0) & (F.lit(fail) | (share > most))
    status = F.when(failed, "failed").when(F.col("rejected") > 0, "completed_with_rejections").otherwise("completed")
    return rows, sizes.select(request, (F.col("_n") - F.col("rejected")).alias("valid"), "rejected", share.alias("ratio"), status.alias("status"), failed.alias("failed"))


def rollup(calls: DataFrame, dimensions: list[str], measures: dict[str, Column]) -> DataFrame:
    """Totals and totals by each dimension alone, in one pass: columns dimension, value and the measures."""
    sides = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions], F.struct(F.lit("total").alias("dimension"), F.lit(None).cast("string").alias("value")))
    rows = calls.withColumn("_side", F.explode(sides))
    out = rows.groupBy("_side").agg(*[m.alias(n) for n, m in measures.items()])
    return out.select("_side.dimension", "_side.value", *measures)
