"""Published course graphs: structure, checks, gates with their rejections, and reports about them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators import quality
from graphloom.operators.graphs import prune_edges
from graphloom.operators.lookup import lookup_inner
from graphloom.session import cut_lineage

# --- fixed values: other names of knowledge kinds
KINDS = {
    "skill": "method", "technique": "method", "framework": "model", "procedure": "process", "guideline": "rule", "function": "concept", "role": "concept", "capability": "concept",
    "概念": "concept", "原则": "principle", "方法": "method", "流程": "process", "工具": "tool", "模型": "model", "规则": "rule",
}
# --- fixed values: types of outline entries by depth, of relations, and those of relations without direction
OUTLINE_TYPES, DEEPER = ("book", "chapter", "section"), "subsection"
RELATIONS, UNDIRECTED = ("prerequisite", "related", "derivative", "confusable"), ("related", "confusable")


def knowledge_kind(kind: Column) -> Column:
    """The kind in lower case and under its usual name; null stays null."""
    low = F.lower(F.trim(kind))
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair]), low), low)


def outline_type(depth: Column) -> Column:
    """book, chapter, section or subsection; null for a null depth."""
    return F.when(depth >= len(OUTLINE_TYPES), DEEPER).when(depth >= 0, F.element_at(F.array(*map(F.lit, OUTLINE_TYPES)), depth.cast("int") + 1))


def structural_edges(outline: DataFrame, nodes: DataFrame) -> DataFrame:
    """(scope, source_id, target_id, edge_type, system_generated): `contains` from each outline entry's
    parent and from each knowledge node's section. outline: scope, id, parent_id; nodes: scope, id,
    parent_outline_id. Entries and nodes without a parent have no such edge."""
    parts = [(outline, "parent_id"), (nodes, "parent_outline_id")]
    made = [rows.filter(F.col(up).isNotNull()).select("scope", F.col(up).alias("source_id"), F.col("id").alias("target_id")) for rows, up in parts]
    return made[0].unionByName(made[1]).withColumns({"edge_type": F.lit("contains"), "system_generated": F.lit(True)})


def _ordered_ends(edges: DataFrame) -> DataFrame:
    """edges with the ends of undirected types in order."""
    swap = F.col("edge_type").isin(*UNDIRECTED) & (F.col("source_id") > F.col("target_id"))
    ends = {"source_id": F.when(swap, F.col("target_id")).otherwise(F.col("source_id")), "target_id": F.when(swap, F.col("source_id")).otherwise(F.col("target_id"))}
    return edges.withColumns(ends)


def validate_graph(outline: DataFrame, nodes: DataFrame, structure: DataFrame, semantic: DataFrame) -> DataFrame:
    """(scope, subject, violation) of a published graph, one row per violation and subject; none if valid.

    outline: scope, id, parent_id. nodes: scope, id, parent_outline_id, parent_knowledge_id, run_id; the
    run of a scope is its smallest run_id. structure: scope, source_id, target_id, edge_type,
    system_generated. semantic: scope, source_id, target_id, edge_type. An edge's subject is
    `source>target:type`. Null ends are unknown ends. Keys are pre-aggregated, and ends that very many
    edges share are looked up with salts.
    """

    def found(rows: DataFrame, subject: Column | str, violation: str) -> DataFrame:
        return rows.select("scope", (F.col(subject) if isinstance(subject, str) else subject).alias("subject"), F.lit(violation).alias("violation"))

    def unknown(rows: DataFrame, column: str, known: DataFrame) -> DataFrame:
        return rows.join(known.withColumnRenamed("id", column), ["scope", column], "left_anti")

    # each is read by several checks
    outline, nodes, structure = cut_lineage(outline), cut_lineage(nodes), cut_lineage(structure)
    semantic = cut_lineage(semantic.select("scope", "source_id", "target_id", "edge_type"))
    entry, point = outline.select("scope", "id").distinct(), nodes.select("scope", "id").distinct()
    either = entry.unionByName(point).distinct()
    twice = outline.select("scope", "id").unionByName(nodes.select("scope", "id")).groupBy("scope", "id").count().filter("count > 1")
    runs = nodes.groupBy("scope").agg(F.min("run_id").alias("_run"))
    parts = [
        found(twice, "id", "duplicate node id"),
        found(unknown(outline.filter("parent_id is not null"), "parent_id", entry), "id", "unknown parent"),
        found(unknown(nodes, "parent_outline_id", entry), "id", "unknown outline"),
        found(unknown(nodes.filter("parent_knowledge_id is not null"), "parent_knowledge_id", point), "id", "unknown parent knowledge"),
        found(nodes.join(runs, "scope").filter("run_id <> _run"), "id", "run mismatch"),
        found(structure.filter(~F.coalesce("system_generated", F.lit(False))), "target_id", "structural edge by hand"),
    ]
    name = F.concat(F.coalesce("source_id", F.lit("")), F.lit(">"), F.coalesce("target_id", F.lit("")), F.lit(":"), F.coalesce("edge_type", F.lit("")))
    for kind, edges, known in (("structural", structure, either), ("semantic", _ordered_ends(semantic), point)):
        rows = edges.select("scope", "source_id", "target_id", "edge_type")
        distinct = rows.groupBy("scope", "source_id", "target_id", "edge_type").agg(F.count(F.lit(1)).alias("_n"))
        lost = unknown(distinct, "source_id", known).select("scope", "source_id", "target_id", "edge_type").unionByName(unknown(distinct, "target_id", known).select("scope", "source_id", "target_id", "edge_type"))
        parts += [
            found(lost, name, f"{kind} edge with an unknown end"),
            found(distinct.filter("source_id = target_id"), name, f"{kind} loop"),
            found(distinct.filter("_n > 1"), name, f"duplicate {kind} edge"),
        ]
    return reduce(DataFrame.unionByName, parts).distinct()


def attach_ids(edges: DataFrame, nodes: DataFrame, scope: list[str]) -> DataFrame:
    """edges (scope…, source, target and others) with source_id and target_id; edges with an end that no
    node is called are left out. nodes: scope…, name, id; of nodes of one name the smallest id is taken."""
    ids = nodes.filter("name is not null").groupBy(*scope, "name").agg(F.min("id").alias("id"))
    out = edges
    for end in ("source", "target"):
        out = lookup_inner(out, ids.withColumnsRenamed({"name": end, "id": f"{end}_id"}), [*scope, end])
    return out.select(*edges.columns, "source_id", "target_id")


def gate(nodes: DataFrame, outline: DataFrame, edges: DataFrame, node_seq: str, edge_seq: str, least_evidence: int = 1, longest_name: int = 60) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(accepted nodes, accepted edges, rejections): see quality.gate_nodes and gate_edges. Only names of
    accepted nodes are known to the edges. rejections: item (node or edge), scope, seq, reason."""
    judged = quality.gate_nodes(quality.repair_parents(nodes, outline), outline, node_seq, least_evidence, longest_name)
    judged = cut_lineage(judged)
    good = judged.filter("reason is null").drop("reason")
    linked = quality.gate_edges(edges, good.select("scope", "name"), edge_seq)
    rejected = [
        rows.filter("reason is not null").select(F.lit(item).alias("item"), "scope", F.col(seq).cast("bigint").alias("seq"), "reason")
        for item, rows, seq in (("node", judged, node_seq), ("edge", linked, edge_seq))
    ]
    return good, linked.filter("reason is null").drop("reason"), rejected[0].unionByName(rejected[1])


def quality_report(tree: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per scope: sections, covered, coverage, points, relations, one column per relation type,
    dangling edges and passed (no dangling edge, and a point).

    tree: hierarchy(paths=True) with scope and node. nodes: scope, name, node (its section). edges: scope,
    source, target, edge_type. Scopes without an outline have no row; entries at the root aren't sections.
    """
    sections = tree.filter("steps is null or steps <> 0")
    covered = quality.coverage(sections, nodes.select("scope", "node"), "scope", "node")
    points = nodes.groupBy("scope").agg(F.count(F.lit(1)).alias("points"))
    counted = edges.groupBy("scope").agg(F.count(F.lit(1)).alias("relations"), *[F.count(F.when(F.col("edge_type") == t, 1)).alias(t) for t in RELATIONS])
    names = nodes.select(F.concat_ws("\u0001", "scope", "name").alias("_key"))
    keyed = edges.select("scope", *[F.concat_ws("\u0001", "scope", end).alias(end) for end in ("source", "target")])
    whole = prune_edges(keyed, names, "_key").groupBy("scope").agg(F.count(F.lit(1)).alias("_whole"))
    out = covered.join(points, "scope", "left").join(counted, "scope", "left").join(whole, "scope", "left").fillna(0, ["points", "relations", *RELATIONS, "_whole"])
    out = out.withColumn("dangling", F.col("relations") - F.col("_whole"))
    return out.select("scope", "sections", F.col("hierarchical").alias("covered"), "coverage", "points", "relations", *RELATIONS, "dangling", ((F.col("dangling") == 0) & (F.col("points") > 0)).alias("passed"))


def rejection_summary(rejections: DataFrame) -> DataFrame:
    """(measure, subject, n) of rejected items: total and each action once per identity, then the requests,
    chunks and ends that quarantined items touch.

    rejections: rejection_id, request_id, stage, chunk_id, schema_path, raw_item (JSON text), action,
    source, target and seq. An item is what its rejection_id names, or else its request, stage, chunk,
    path and raw item; of several rows of an item the last by seq counts. A missing action is `failed`.
    """
    by_place = F.to_json(F.struct("request_id", "stage", "chunk_id", "schema_path", "raw_item"))
    identity = F.coalesce(F.when(F.length("rejection_id") > 0, F.col("rejection_id")), by_place)
    last = rejections.groupBy(identity.alias("_who")).agg(F.max_by(F.struct(F.coalesce("action", F.lit("failed")).alias("action"), "request_id", "chunk_id", "source", "target"), "seq").alias("_r")).select("_r.*")
    gone = F.col("action") == "quarantined"
    facts = F.array(
        F.struct(F.lit("total").alias("measure"), F.lit(None).cast("string").alias("subject")),
        F.struct(F.lit("action").alias("measure"), F.col("action").alias("subject")),
        *[F.struct(F.lit(m).alias("measure"), F.when(gone, F.col(c)).alias("subject")) for m, c in (("request", "request_id"), ("chunk", "chunk_id"), ("endpoint", "source"), ("endpoint", "target"))],
    )
    rows = last.select(F.explode(facts).alias("_f")).select("_f.*").filter("measure = 'total' or subject is not null")
    return rows.groupBy("measure", "subject").agg(F.count(F.lit(1)).alias("n"))


def recovery_rollup(events: DataFrame, last: int = 1000) -> tuple[DataFrame, DataFrame]:
    """((action, n) of all recovery events, the last events by seq, at most `last`, which is the audit trail)."""
    return events.groupBy("action").agg(F.count(F.lit(1)).alias("n")), events.orderBy(F.desc("seq")).limit(last)


def classify_failure(status: Column, code: Column, text: Column, error: Column) -> Column:
    """struct(category, reason) of a provider's failure by HTTP status, code, message and error name."""
    said, name = F.lower(F.concat_ws(" ", code, text)), F.lower(F.coalesce(error, F.lit("")))
    # --- fixed values: what a message says, by status, and the category and reason that follow
    limits = [
        ("insufficient_quota|quota exhausted|balance", "quota.exhausted", "account_quota_exhausted"),
        ("permission|not allowed|plan limit", "quota.permission", "model_or_tenant_limit"),
        ("token|tpm", "rate_limit.tokens", "tokens_per_minute"),
        ("concurrent|concurrency", "rate_limit.concurrency", "concurrent_requests"),
        ("capacity|overload|busy", "rate_limit.capacity", "provider_capacity"),
        ("", "rate_limit.requests", "requests_per_minute"),
    ]
    refusals = [
        ("response_format|json_schema|tool_choice|tools", "unsupported_capability", "capability_mismatch"),
        ("context length|maximum context|too many tokens", "context_window", "context_limit_exceeded"),
        ("unsupported parameter|unknown parameter", "unsupported_parameter", "parameter_rejected"),
        ("invalid input|input is invalid|embedding input|invalid embedding", "protocol", "invalid_input"),
        ("", "protocol", "bad_request"),
    ]
    result = lambda category, reason: F.struct(F.lit(category).alias("category"), F.lit(reason).alias("reason"))
    rules = [(status.isin(401, 403), "authentication", "auth_failed")]
    rules += [((status == 429) & said.rlike(words), c, r) for words, c, r in limits]
    rules += [(status == 529, "rate_limit.capacity", "provider_capacity"), (status >= 500, "transient", "server_error")]
    rules += [((status == 400) & said.rlike(words), c, r) for words, c, r in refusals]
    rules += [(name.rlike("timeout|connection"), "transient", "connection_or_timeout")]
    (first, c, r), *rest = rules
    return reduce(lambda case, rule: case.when(F.coalesce(rule[0], F.lit(False)), result(*rule[1:])), rest, F.when(F.coalesce(first, F.lit(False)), result(c, r))).otherwise(result("unknown", "unclassified_provider_error"))
