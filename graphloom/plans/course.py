"""Queries over published graphs: structure, checks, rejections, evaluation, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.functions.keys import clean_key
from graphloom.operators import course, evaluation, graphs, lists, sets
from graphloom.plans.integrity import _TREE, _clean, _outline_tree, current_outlines
from graphloom.plans.knowledge import _EDGES, _NODES, _edges, _nodes
from graphloom.session import cut_lineage, read_table


def knowledge_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """The usual name of each record's knowledge kind."""
    return _nodes(spark, folder).select("record_id", course.knowledge_kind(F.col("knowledge_kind")).alias("kind"))


def outline_types(spark: SparkSession, folder: str) -> DataFrame:
    """What each outline entry is called at its stored depth."""
    return current_outlines(spark, folder).select("pkg", "nid", course.outline_type(F.col("depth")).alias("node_type"))


def _graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(outline, nodes, edges) of all packages, live rows only, under cleaned keys."""
    scope = clean_key(F.col("package_id")).alias("scope")
    outline = current_outlines(spark, folder).filter("deleted_at is null").select(F.col("pkg").alias("scope"), F.col("nid").alias("id"), F.col("parent").alias("parent_id"))
    nodes = _nodes(spark, folder).filter("deleted_at is null").select(scope, clean_key(F.col("node_id")).alias("id"), clean_key(F.col("parent_outline_id")).alias("parent_outline_id"), F.lit(None).cast("string").alias("parent_knowledge_id"), "run_id")
    edges = _edges(spark, folder).select(scope, clean_key(F.col("source")).alias("source_id"), clean_key(F.col("target")).alias("target_id"), "edge_type")
    return outline, nodes.distinct(), edges


def graph_structure(spark: SparkSession, folder: str) -> DataFrame:
    """The `contains` edges of all packages' graphs."""
    outline, nodes, _ = _graph(spark, folder)
    return course.structural_edges(outline, nodes).distinct()


def graph_validation(spark: SparkSession, folder: str) -> DataFrame:
    """What is wrong with all packages' graphs, counted by violation."""
    outline, nodes, edges = _graph(spark, folder)
    found = course.validate_graph(outline, nodes, course.structural_edges(outline, nodes), edges)
    return found.groupBy("scope", "violation").agg(F.count(F.lit(1)).alias("n"), F.min("subject").alias("first_subject"))


def edge_records(spark: SparkSession, folder: str) -> DataFrame:
    """Edges with the smallest record of each end."""
    nodes = _nodes(spark, folder).select(clean_key(F.col("node_id")).alias("name"), F.col("record_id").alias("id"))
    edges = _edges(spark, folder).select("edge_id", clean_key(F.col("source")).alias("source"), clean_key(F.col("target")).alias("target"))
    return course.attach_ids(edges, nodes, []).select("edge_id", "source_id", "target_id")


def gate_rejections(spark: SparkSession, folder: str) -> DataFrame:
    """All nodes and edges that the whole gate rejects, with the reason. Edges name their ends by node."""
    nodes = _nodes(spark, folder).select("record_id", F.col("package_id").alias("scope"), "node_id", F.col("node_name").alias("name"), "evidence", "summary", F.lower(F.trim("parent_outline_id")).alias("parent_outline_id"))
    outline = current_outlines(spark, folder).select(F.col("package_id").alias("scope"), F.col("nid").alias("outline_id"), "title")
    edges = _edges(spark, folder).select("edge_id", F.col("package_id").alias("scope"), "source", "target", "edge_type", "description", "confidence")
    named = nodes.groupBy("scope", "node_id").agg(F.min_by("name", "record_id").alias("_name"))
    for end in ("source", "target"):
        edges = edges.join(named.withColumnRenamed("node_id", end), ["scope", end], "left").withColumn(end, F.coalesce("_name", end)).drop("_name")
    return course.gate(nodes.drop("node_id"), outline, edges, "record_id", "edge_id", 20, 40)[2]


def quality_report(spark: SparkSession, folder: str) -> DataFrame:
    """Coverage, relations and dangling edges of each package."""
    tree = _outline_tree(spark, folder, paths=True).withColumnsRenamed({"pkg": "scope", "nid": "node"})
    scope = clean_key(F.col("package_id")).alias("scope")
    nodes = _nodes(spark, folder).select(scope, clean_key(F.col("node_id")).alias("name"), clean_key(F.col("parent_outline_id")).alias("node"))
    edges = _edges(spark, folder).select(scope, clean_key(F.col("source")).alias("source"), clean_key(F.col("target")).alias("target"), "edge_type")
    return course.quality_report(tree, nodes, edges)


def _rejected(spark: SparkSession, folder: str) -> DataFrame:
    """Every edge that isn't accepted as a rejection record; repeated deliveries are rows of their own."""
    e = read_table(spark, folder, "course_edges").filter("status <> 'accepted'")
    action = F.when(F.col("edge_type") == "related", "quarantined").when(F.col("edge_type") == "derivative", "repaired").when(F.col("edge_type") == "confusable", "failed")
    return e.select(
        F.when(F.col("confidence") >= 0.5, F.concat(F.lit("r"), F.col("edge_id").cast("string"))).alias("rejection_id"), F.col("run_id").alias("request_id"), F.col("status").alias("stage"), F.col("package_id").alias("chunk_id"),
        F.lit("edges").alias("schema_path"), F.concat_ws(" ", F.col("edge_id").cast("string"), "description").alias("raw_item"), action.alias("action"), "source", "target", F.col("ingested_at").alias("seq"),
    )


def rejection_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Rejected edges by action, and the runs, packages and ends that quarantined ones touch."""
    return course.rejection_summary(_rejected(spark, folder))


def recovery_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Number of events by kind, as recovery actions are counted."""
    return course.recovery_rollup(read_table(spark, folder, "events").select(F.col("event_type").alias("action"), F.col("event_id").alias("seq")))[0]


def failure_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Category and reason of a failure per order: its priority is the message, its status the code."""
    o = read_table(spark, folder, "orders")
    status = F.when(F.col("o_orderstatus") == "F", 429).when(F.col("o_orderstatus") == "O", 400).when(F.col("o_orderstatus") == "P", 503)
    said = F.concat(F.lower("o_orderpriority"), F.when(F.col("o_orderpriority").startswith("1"), F.lit(" tokens in tools")).when(F.col("o_orderpriority").startswith("2"), F.lit(" busy, maximum context")).otherwise(F.lit("")))
    found = course.classify_failure(status, F.lit(None).cast("string"), said, F.lit("APIError"))
    return o.select("o_orderkey", found.alias("f")).select("o_orderkey", "f.category", "f.reason")


def graph_modularity(spark: SparkSession, folder: str) -> DataFrame:
    """Modularity of the whole graph cut by the smallest package of each node."""
    groups = _nodes(spark, folder).groupBy(clean_key(F.col("node_id")).alias("id")).agg(F.min("package_id").alias("community"))
    e = _edges(spark, folder).select(clean_key(F.col("source")).alias("src"), clean_key(F.col("target")).alias("dst"), F.lit(1.0).alias("weight"))
    return graphs.modularity(e, groups)


def layer_union(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes of two layers in one, by name, the first of the upper layer winning."""
    upper = read_table(spark, folder, "concept_registry").select(F.col("node_name").alias("name"), "node_id")
    lower = _nodes(spark, folder).select(F.col("node_name").alias("name"), "node_id")
    return sets.layers([upper, lower], "name", "node_id")


def set_order(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the nations, and the customers' nations, are equal in order to the nations by name."""
    n = read_table(spark, folder, "nation").select("n_nationkey", "n_name")
    c = read_table(spark, folder, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.min("c_custkey").alias("first"))
    a = sets.equal_in_order(n, n.withColumnRenamed("n_name", "first"), ["n_nationkey"], "n_name", "first").select(F.lit("itself").alias("other"), "equal")
    return a.unionByName(sets.equal_in_order(n, c, ["n_nationkey"], "n_name", "first").select(F.lit("customers").alias("other"), "equal"))


def numbered_lists(spark: SparkSession, folder: str) -> DataFrame:
    """The nations of each region as a numbered list."""
    return lists.numbered(read_table(spark, folder, "nation"), ["n_regionkey"], "n_name", "n_name")


def _evaluated(spark: SparkSession, folder: str) -> tuple[DataFrame, ...]:
    """(predicted, edges, gold, names, relations, labels): every node id is a prediction; every name of a
    package is a labelled point with its records' aliases; every kind of edge is a labelled relation."""
    inside = lambda key: F.concat(F.col("package_id"), F.lit(" "), key)
    nodes = _nodes(spark, folder).filter("k <> ''").withColumns({"key": inside(F.col("k")), "outline_id": clean_key(F.col("parent_outline_id")), "id": clean_key(F.col("node_id"))})
    nodes = cut_lineage(nodes.select("record_id", "package_id", "id", "key", "outline_id", "evidence", "source_refs", "aliases", "knowledge_level"))
    first = F.min_by(F.struct("key", "outline_id", ((F.coalesce(F.length(F.trim("evidence")), F.lit(0)) > 0) & (F.coalesce(F.size("source_refs"), F.lit(0)) > 0)).alias("evidenced")), "record_id")
    predicted = cut_lineage(nodes.filter("id is not null").groupBy("id").agg(first.alias("_p")).select("id", "_p.*"))
    gold = nodes.groupBy("key").agg(F.min("record_id").alias("gold_id"), F.min_by("outline_id", "record_id").alias("outline_id"))
    label = F.when(F.col("gold_id") % 3 == 0, "required").when(F.col("gold_id") % 3 == 1, "acceptable").otherwise("forbidden")
    gold = cut_lineage(gold.withColumn("label", label))
    own = gold.select("key", "gold_id")
    also = nodes.select("key", "package_id", F.explode("aliases").alias("_a")).join(own, "key").select("gold_id", inside(text.normal_name(F.col("_a"))).alias("key")).filter("not key like '% '")
    names = own.select("gold_id", "key").unionByName(also)
    edges = _edges(spark, folder).select("edge_id", clean_key(F.col("source")).alias("source_id"), clean_key(F.col("target")).alias("target_id"), "edge_type", "status")
    points = predicted.select("id", "key").join(own, "key").select("id", F.col("gold_id").cast("bigint").alias("gold"))
    ends = edges.join(points.withColumnsRenamed({"id": "source_id", "gold": "source"}), "source_id").join(points.withColumnsRenamed({"id": "target_id", "gold": "target"}), "target_id")
    judged = F.when(F.col("status") == "accepted", "required").when(F.col("status") == "pending", "acceptable").otherwise("forbidden")
    relations = ends.groupBy("source", "target", "edge_type").agg(F.min("edge_id").alias("rel_id"), F.min_by(judged, "edge_id").alias("label"))
    labels = nodes.join(own, "key").select("gold_id", F.coalesce("knowledge_level", F.lit("none")).alias("label"))
    return predicted, edges.select("source_id", "target_id", "edge_type"), gold.select("gold_id", "label", "outline_id"), names, relations, labels


def evaluation_report(spark: SparkSession, folder: str) -> DataFrame:
    """All node ids and edges measured against labelled points and relations, with the gates."""
    return evaluation.evaluate_graph(*_evaluated(spark, folder))


QUERIES = {
    f.__name__: f
    for f in (
        knowledge_kinds, outline_types, graph_structure, graph_validation, edge_records, gate_rejections, quality_report, rejection_summary, recovery_rollup, failure_classes,
        graph_modularity, layer_union, set_order, numbered_lists, evaluation_report,
    )
}

_KINDS = "CASE lower(trim(knowledge_kind)) " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in course.KINDS.items()) + " ELSE lower(trim(knowledge_kind)) END"
_GRAPH = f"""{_NODES}, {_EDGES}, o AS (SELECT pkg AS scope, nid AS id, parent AS parent_id FROM (SELECT {_clean("package_id")} AS pkg, {_clean("id")} AS nid,
          arg_max(struct_pack(p := {_clean("parent_id")}), updated_at).p AS parent, arg_max(struct_pack(d := deleted_at), updated_at).d AS gone FROM outlines GROUP BY 1, 2) WHERE gone IS NULL),
        n AS (SELECT DISTINCT {_clean("package_id")} AS scope, {_clean("node_id")} AS id, {_clean("parent_outline_id")} AS up, run_id FROM nodes WHERE deleted_at IS NULL),
        s AS (SELECT scope, parent_id AS a, id AS b, 'contains' AS t FROM o WHERE parent_id IS NOT NULL UNION ALL SELECT scope, up, id, 'contains' FROM n WHERE up IS NOT NULL),
        g AS (SELECT {_clean("package_id")} AS scope, {_clean("source")} AS a0, {_clean("target")} AS b0, edge_type AS t FROM edges),
        m AS (SELECT scope, CASE WHEN t IN ('related', 'confusable') AND a0 > b0 THEN b0 ELSE a0 END AS a, CASE WHEN t IN ('related', 'confusable') AND a0 > b0 THEN a0 ELSE b0 END AS b, t FROM g)"""
_NAME = "coalesce(a, '') || '>' || coalesce(b, '') || ':' || coalesce(t, '')"


def _edge_faults(kind: str, table: str, known: str) -> str:
    return f"""UNION SELECT scope, {_NAME}, '{kind} edge with an unknown end' FROM {table} x WHERE NOT EXISTS (SELECT 1 FROM {known} k WHERE k.scope = x.scope AND k.id = x.a) OR NOT EXISTS (SELECT 1 FROM {known} k WHERE k.scope = x.scope AND k.id = x.b)
        UNION SELECT scope, {_NAME}, '{kind} loop' FROM {table} WHERE a = b UNION SELECT scope, {_NAME}, 'duplicate {kind} edge' FROM {table} GROUP BY scope, a, b, t HAVING count(*) > 1"""


_JUDGED = """(SELECT record_id, package_id, CASE WHEN reason IS NOT NULL THEN reason WHEN row_number() OVER (PARTITION BY package_id, k, reason IS NULL ORDER BY record_id) > 1 THEN 'duplicate_node' END AS reason, node_name FROM (
          SELECT n.*, CASE WHEN coalesce(len(trim(evidence)), 0) < 20 THEN 'missing_evidence' WHEN coalesce(len(trim(up)), 0) = 0 THEN 'missing_parent_outline'
            WHEN NOT EXISTS (SELECT 1 FROM cur c WHERE c.scope = n.package_id AND c.outline_id = n.up) THEN 'unknown_outline' WHEN len(trim(node_name)) > 40 THEN 'name_too_long' WHEN coalesce(len(trim(summary)), 0) = 0 THEN 'missing_summary' END AS reason
          FROM (SELECT n.*, coalesce(o.only_one, lower(trim(n.parent_outline_id))) AS up FROM nodes n LEFT JOIN one o ON o.scope = n.package_id AND o.key = n.k) n))"""
_CUR = f"cur AS (SELECT arg_max(package_id, updated_at) AS scope, {_clean('package_id')} AS pkg, {_clean('id')} AS outline_id, arg_max(title, updated_at) AS title FROM outlines GROUP BY 2, 3)"
_ONE = "one AS (SELECT scope, regexp_replace(lower(regexp_replace(title, '^\\s*\\d+(\\.\\d+)*\\s*', '')), '[^0-9a-z㐀-鿿]+', '', 'g') AS key, min(outline_id) AS only_one FROM cur GROUP BY 1, 2 HAVING count(*) = 1 AND key <> '')"
_RATIO = "coalesce(round({0} / nullif({1}, 0), 6), {2})"

SQL = {
    "knowledge_kinds": f"SELECT DISTINCT record_id, {_KINDS} AS kind FROM course_nodes",
    "outline_types": f"""SELECT {_clean("package_id")} AS pkg, {_clean("id")} AS nid, CASE WHEN arg_max(struct_pack(d := depth), updated_at).d = 0 THEN 'book' WHEN arg_max(struct_pack(d := depth), updated_at).d = 1 THEN 'chapter'
        WHEN arg_max(struct_pack(d := depth), updated_at).d = 2 THEN 'section' WHEN arg_max(struct_pack(d := depth), updated_at).d > 2 THEN 'subsection' END AS node_type FROM outlines GROUP BY 1, 2""",
    "graph_structure": f"WITH {_GRAPH} SELECT DISTINCT scope, a AS source_id, b AS target_id, t AS edge_type, true AS system_generated FROM s",
    "graph_validation": f"""WITH {_GRAPH}, k AS (SELECT DISTINCT scope, id FROM n), every AS (SELECT scope, id FROM k UNION SELECT scope, id FROM o), r AS (SELECT scope, min(run_id) AS run FROM n GROUP BY 1),
        f AS (SELECT scope, id AS subject, 'duplicate node id' AS violation FROM (SELECT scope, id FROM o UNION ALL SELECT scope, id FROM n) GROUP BY 1, 2 HAVING count(*) > 1
        UNION SELECT scope, id, 'unknown parent' FROM o x WHERE parent_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM o WHERE o.scope = x.scope AND o.id = x.parent_id)
        UNION SELECT scope, id, 'unknown outline' FROM n x WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.scope = x.scope AND o.id = x.up) UNION SELECT n.scope, n.id, 'run mismatch' FROM n JOIN r ON r.scope = n.scope AND r.run <> n.run_id
        {_edge_faults("structural", "s", "every")} {_edge_faults("semantic", "m", "k")})
        SELECT scope, violation, count(*) AS n, min(subject) AS first_subject FROM f GROUP BY 1, 2""",
    "edge_records": f"""WITH {_EDGES}, k AS (SELECT {_clean("node_id")} AS id, min(record_id) AS r FROM course_nodes GROUP BY 1)
        SELECT e.edge_id, a.r AS source_id, b.r AS target_id FROM edges e JOIN k a ON a.id = {_clean("e.source")} JOIN k b ON b.id = {_clean("e.target")}""",
    "gate_rejections": f"""WITH {_NODES}, {_EDGES}, {_CUR}, {_ONE}, j AS {_JUDGED}, w AS (SELECT package_id, node_id, arg_min(node_name, record_id) AS name FROM nodes GROUP BY 1, 2), good AS (SELECT DISTINCT package_id, node_name FROM j WHERE reason IS NULL),
        x AS (SELECT e.edge_id, e.package_id, coalesce(a.name, e.source) AS source, coalesce(b.name, e.target) AS target, e.edge_type, e.description, e.confidence FROM edges e LEFT JOIN w a ON a.package_id = e.package_id AND a.node_id = e.source LEFT JOIN w b ON b.package_id = e.package_id AND b.node_id = e.target),
        y AS (SELECT edge_id, x.package_id, edge_type, confidence, CASE WHEN edge_type IN ('related', 'confusable') THEN least(source, target) ELSE source END AS s, CASE WHEN edge_type IN ('related', 'confusable') THEN greatest(source, target) ELSE target END AS t,
          CASE WHEN ga.node_name IS NULL OR gb.node_name IS NULL THEN 'unknown_endpoint' WHEN source = target THEN 'self_loop' WHEN coalesce(len(trim(description)), 0) = 0 THEN 'missing_relation_evidence' END AS reason
          FROM x LEFT JOIN good ga ON ga.package_id = x.package_id AND ga.node_name = source LEFT JOIN good gb ON gb.package_id = x.package_id AND gb.node_name = target),
        b AS (SELECT package_id, s, t, edge_type, arg_max(edge_id, (coalesce(confidence, -1), -edge_id)) AS best FROM y WHERE reason IS NULL GROUP BY ALL),
        z AS (SELECT y.edge_id, y.package_id, CASE WHEN reason IS NOT NULL THEN reason WHEN y.edge_id <> b.best THEN 'duplicate_edge'
          WHEN y.edge_type = 'related' AND EXISTS (SELECT 1 FROM b q WHERE q.package_id = y.package_id AND q.edge_type <> 'related' AND least(q.s, q.t) = least(y.s, y.t) AND greatest(q.s, q.t) = greatest(y.s, y.t)) THEN 'weaker_relation_conflict' END AS reason
          FROM y LEFT JOIN b ON b.package_id = y.package_id AND b.s = y.s AND b.t = y.t AND b.edge_type = y.edge_type)
        SELECT 'node' AS item, package_id AS scope, record_id AS seq, reason FROM j WHERE reason IS NOT NULL UNION ALL SELECT 'edge', package_id, edge_id, reason FROM z WHERE reason IS NOT NULL""",
    "quality_report": _TREE + f""", {_NODES}, {_EDGES}, q AS (SELECT {_clean("package_id")} AS scope, {_clean("node_id")} AS name, {_clean("parent_outline_id")} AS nid FROM nodes),
        d AS (SELECT DISTINCT scope AS pkg, nid FROM q), h AS (SELECT pkg, nid FROM d UNION SELECT u.pkg, u.anc FROM up u JOIN d ON d.pkg = u.pkg AND d.nid = u.nid JOIN status s ON s.pkg = u.pkg AND s.nid = u.nid AND s.status = 'ok'),
        c AS (SELECT s.pkg AS scope, count(*) AS sections, count(CASE WHEN s.status = 'ok' THEN h.nid END) AS covered FROM status s LEFT JOIN h ON h.pkg = s.pkg AND h.nid = s.nid WHERE NOT (s.status = 'ok' AND s.steps = 0) GROUP BY 1),
        p AS (SELECT scope, count(*) AS points FROM q GROUP BY 1),
        g AS (SELECT {_clean("package_id")} AS scope, {_clean("source")} AS a, {_clean("target")} AS b, edge_type AS t FROM edges),
        r AS (SELECT scope, count(*) AS relations, count(*) FILTER (WHERE t = 'prerequisite') AS prerequisite, count(*) FILTER (WHERE t = 'related') AS related, count(*) FILTER (WHERE t = 'derivative') AS derivative, count(*) FILTER (WHERE t = 'confusable') AS confusable,
          count(*) FILTER (WHERE NOT (EXISTS (SELECT 1 FROM q WHERE q.scope = g.scope AND q.name = g.a) AND EXISTS (SELECT 1 FROM q WHERE q.scope = g.scope AND q.name = g.b))) AS dangling FROM g GROUP BY 1)
        SELECT c.scope, c.sections, c.covered, round(c.covered / c.sections, 4) AS coverage, coalesce(p.points, 0) AS points, coalesce(relations, 0) AS relations, coalesce(prerequisite, 0) AS prerequisite, coalesce(related, 0) AS related, coalesce(derivative, 0) AS derivative,
          coalesce(confusable, 0) AS confusable, coalesce(dangling, 0) AS dangling, coalesce(dangling, 0) = 0 AND coalesce(p.points, 0) > 0 AS passed FROM c LEFT JOIN p ON p.scope = c.scope LEFT JOIN r ON r.scope = c.scope""",
    "rejection_summary": """WITH e AS (SELECT *, CASE edge_type WHEN 'related' THEN 'quarantined' WHEN 'derivative' THEN 'repaired' ELSE 'failed' END AS action,
          CASE WHEN confidence >= 0.5 THEN 'r' || edge_id ELSE concat_ws('|', run_id, status, package_id, edge_id, description) END AS who FROM course_edges WHERE status <> 'accepted'),
        l AS (SELECT DISTINCT ON (who) * FROM e ORDER BY who, ingested_at DESC),
        f AS (SELECT 'total' AS measure, NULL::VARCHAR AS subject FROM l UNION ALL SELECT 'action', action FROM l UNION ALL SELECT 'request', run_id FROM l WHERE action = 'quarantined' UNION ALL SELECT 'chunk', package_id FROM l WHERE action = 'quarantined'
          UNION ALL SELECT 'endpoint', source FROM l WHERE action = 'quarantined' UNION ALL SELECT 'endpoint', target FROM l WHERE action = 'quarantined')
        SELECT measure, subject, count(*) AS n FROM f WHERE measure = 'total' OR subject IS NOT NULL GROUP BY 1, 2""",
    "recovery_rollup": "SELECT event_type AS action, count(*) AS n FROM events GROUP BY 1",
    "failure_classes": """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_orderpriority LIKE '1%' THEN 'rate_limit.tokens' WHEN o_orderstatus = 'F' AND o_orderpriority LIKE '2%' THEN 'rate_limit.capacity' WHEN o_orderstatus = 'F' THEN 'rate_limit.requests'
          WHEN o_orderstatus = 'O' AND o_orderpriority LIKE '1%' THEN 'unsupported_capability' WHEN o_orderstatus = 'O' AND o_orderpriority LIKE '2%' THEN 'context_window' WHEN o_orderstatus = 'O' THEN 'protocol' WHEN o_orderstatus = 'P' THEN 'transient' ELSE 'unknown' END AS category,
        CASE WHEN o_orderstatus = 'F' AND o_orderpriority LIKE '1%' THEN 'tokens_per_minute' WHEN o_orderstatus = 'F' AND o_orderpriority LIKE '2%' THEN 'provider_capacity' WHEN o_orderstatus = 'F' THEN 'requests_per_minute'
          WHEN o_orderstatus = 'O' AND o_orderpriority LIKE '1%' THEN 'capability_mismatch' WHEN o_orderstatus = 'O' AND o_orderpriority LIKE '2%' THEN 'context_limit_exceeded' WHEN o_orderstatus = 'O' THEN 'bad_request' WHEN o_orderstatus = 'P' THEN 'server_error' ELSE 'unclassified_provider_error' END AS reason FROM orders""",
    "graph_modularity": f"""WITH {_EDGES}, c AS (SELECT {_clean("node_id")} AS id, min(package_id) AS c FROM course_nodes GROUP BY 1), e AS (SELECT a.c AS ca, b.c AS cb FROM edges x JOIN c a ON a.id = {_clean("x.source")} JOIN c b ON b.id = {_clean("x.target")} WHERE a.id <> b.id),
        d AS (SELECT c, sum(k) AS k, sum(i) AS i FROM (SELECT ca AS c, 1 AS k, (ca = cb)::INT AS i FROM e UNION ALL SELECT cb, 1, 0 FROM e) GROUP BY 1), m AS (SELECT count(*) AS m FROM e)
        SELECT count(*) AS communities, (SELECT m FROM m)::DOUBLE AS weight, round(sum(i / m.m - (k / (2.0 * m.m)) ^ 2), 6) AS modularity FROM d, m""",
    "layer_union": f"""WITH {_NODES}, a AS (SELECT node_name AS name, node_id, 0 AS layer FROM concept_registry UNION ALL SELECT node_name, node_id, 1 FROM nodes)
        SELECT name, arg_min(node_id, (layer, node_id)) AS node_id FROM a WHERE name IS NOT NULL GROUP BY 1""",
    "set_order": """SELECT 'itself' AS other, true AS equal UNION ALL SELECT 'customers', (SELECT string_agg(n_nationkey, ',' ORDER BY n_name) FROM nation) = (SELECT string_agg(k, ',' ORDER BY f) FROM (SELECT c_nationkey AS k, min(c_custkey) AS f FROM customer GROUP BY 1))""",
    "numbered_lists": "SELECT n_regionkey, string_agg(r || '. ' || n_name, chr(10) ORDER BY r) AS list FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS r FROM nation) GROUP BY 1",
    "evaluation_report": f"""WITH {_NODES}, {_EDGES}, n AS (SELECT *, package_id || ' ' || k AS key, {_clean("parent_outline_id")} AS outline_id, {_clean("node_id")} AS id FROM nodes WHERE k <> ''),
        p AS (SELECT id, arg_min(key, record_id) AS key, arg_min(struct_pack(o := outline_id), record_id).o AS outline_id, arg_min(coalesce(len(trim(evidence)), 0) > 0 AND coalesce(len(source_refs), 0) > 0, record_id) AS evidenced FROM n WHERE id IS NOT NULL GROUP BY 1),
        g AS (SELECT key, min(record_id) AS gold_id, arg_min(struct_pack(o := outline_id), record_id).o AS outline_id, CASE min(record_id) % 3 WHEN 0 THEN 'required' WHEN 1 THEN 'acceptable' ELSE 'forbidden' END AS label FROM n GROUP BY 1),
        a AS (SELECT gold_id, key FROM g UNION SELECT g.gold_id, n.package_id || ' ' || regexp_replace(lower(n.a), '[^0-9a-z㐀-鿿]+', '', 'g') FROM (SELECT key, package_id, unnest(aliases) AS a FROM n) n JOIN g USING (key) WHERE regexp_replace(lower(n.a), '[^0-9a-z㐀-鿿]+', '', 'g') <> ''),
        c AS (SELECT p.id, g.gold_id, g.label, coalesce(g.label <> 'forbidden' AND g.outline_id = p.outline_id, false) AS own FROM p JOIN a ON a.key = p.key JOIN g ON g.gold_id = a.gold_id),
        m0 AS (SELECT id, bool_or(own) AS any_own, count(*) FILTER (WHERE own) AS n_own, count(*) AS n_all, arg_min(struct_pack(g := gold_id, l := label), (NOT own, gold_id)) AS b FROM c GROUP BY 1),
        m AS (SELECT p.*, b.g AS gold_id, b.l AS label, CASE WHEN any_own THEN n_own > 1 ELSE n_all > 1 END AS ambiguous FROM p LEFT JOIN m0 USING (id)),
        h AS (SELECT m.gold_id, g.label, g.outline_id AS w, bool_or(m.outline_id = g.outline_id) AS placed FROM m JOIN g ON g.gold_id = m.gold_id GROUP BY ALL),
        e AS (SELECT edge_id, {_clean("source")} AS s, {_clean("target")} AS t, edge_type, status FROM edges),
        pg AS (SELECT p.id, g.gold_id AS g FROM p JOIN g USING (key)),
        r AS (SELECT x.g AS s, y.g AS t, edge_type, min(edge_id) AS rel_id, CASE arg_min(status, edge_id) WHEN 'accepted' THEN 'required' WHEN 'pending' THEN 'acceptable' ELSE 'forbidden' END AS label FROM e JOIN pg x ON x.id = e.s JOIN pg y ON y.id = e.t GROUP BY 1, 2, 3),
        rk AS (SELECT CASE WHEN edge_type IN ('related', 'confusable') THEN least(s, t) ELSE s END AS s, CASE WHEN edge_type IN ('related', 'confusable') THEN greatest(s, t) ELSE t END AS t, edge_type, arg_max(label, rel_id) AS label, max(rel_id) AS rel_id FROM r GROUP BY 1, 2, 3),
        rp AS (SELECT DISTINCT least(s, t) AS a, greatest(s, t) AS b FROM r),
        ej AS (SELECT e.*, x.gold_id AS gs, y.gold_id AS gt FROM e LEFT JOIN m x ON x.id = e.s AND x.label <> 'forbidden' LEFT JOIN m y ON y.id = e.t AND y.label <> 'forbidden'),
        ek AS (SELECT ej.*, rp.a IS NOT NULL AS scoped, rk.rel_id, rk.label FROM ej LEFT JOIN rp ON rp.a = least(gs, gt) AND rp.b = greatest(gs, gt)
          LEFT JOIN rk ON rk.edge_type = ej.edge_type AND rk.s = CASE WHEN ej.edge_type IN ('related', 'confusable') THEN least(gs, gt) ELSE gs END AND rk.t = CASE WHEN ej.edge_type IN ('related', 'confusable') THEN greatest(gs, gt) ELSE gt END),
        q AS (SELECT count(*) AS predicted_relations, count(*) FILTER (WHERE gs IS NOT NULL AND gt IS NOT NULL AND scoped) AS assessed, count(*) FILTER (WHERE gs IS NOT NULL AND gt IS NOT NULL AND NOT scoped) AS unscored_relations,
          count(DISTINCT rel_id) FILTER (WHERE gs IS NOT NULL AND gt IS NOT NULL AND label <> 'forbidden') AS matched_relations, count(DISTINCT rel_id) FILTER (WHERE gs IS NOT NULL AND gt IS NOT NULL AND label = 'required') AS found,
          count(*) FILTER (WHERE gs IS NULL OR gt IS NULL OR (scoped AND coalesce(label, 'forbidden') = 'forbidden')) AS unmatched_relations FROM ek),
        l AS (SELECT sum(n * (n - 1) / 2) AS equal FROM (SELECT g.gold_id, coalesce(knowledge_level, 'none') AS l, count(*) AS n FROM n JOIN g USING (key) GROUP BY 1, 2)), l2 AS (SELECT sum(n * (n - 1) / 2) AS pairs FROM (SELECT key, count(*) AS n FROM n GROUP BY 1)),
        v AS (SELECT count(*) AS predicted_nodes, count(*) FILTER (WHERE label IN ('required', 'acceptable')) AS positive, count(*) FILTER (WHERE label = 'forbidden') AS forbidden_leaks, count(*) FILTER (WHERE evidenced) AS evidenced, count(DISTINCT key) AS names, count(*) FILTER (WHERE ambiguous) AS ambiguous FROM m),
        w AS (SELECT count(*) FILTER (WHERE label = 'required') AS matched_required, count(*) FILTER (WHERE label = 'acceptable') AS matched_acceptable, count(*) FILTER (WHERE label = 'forbidden') AS leaked, count(*) FILTER (WHERE label <> 'forbidden' AND placed) AS placed, count(DISTINCT w) FILTER (WHERE label <> 'forbidden' AND placed) AS covered FROM h),
        u AS (SELECT count(*) FILTER (WHERE label = 'required') AS required_total, count(*) FILTER (WHERE label = 'forbidden') AS forbidden, count(DISTINCT outline_id) FILTER (WHERE label <> 'forbidden') AS extractable FROM g),
        z AS (SELECT {_RATIO.format("matched_required", "required_total", "1.0")} AS required_recall, {_RATIO.format("positive", "predicted_nodes", "1.0")} AS effective_precision, {_RATIO.format("leaked", "forbidden", "0.0")} AS forbidden_leakage_rate,
          {_RATIO.format("placed", "(matched_required + matched_acceptable)", "1.0")} AS outline_accuracy, {_RATIO.format("covered", "extractable", "1.0")} AS extractable_outline_coverage, {_RATIO.format("evidenced", "predicted_nodes", "1.0")} AS evidence_coverage,
          {_RATIO.format("(predicted_nodes - names)", "predicted_nodes", "0.0")} AS duplicate_rate, {_RATIO.format("matched_relations", "assessed", "1.0")} AS relation_precision, {_RATIO.format("found", "(SELECT count(*) FROM r WHERE label = 'required')", "1.0")} AS relation_recall,
          {_RATIO.format("equal", "pairs", "0.0")} AS annotator_agreement, pairs::BIGINT AS annotation_pairs, predicted_nodes, matched_required, required_total, matched_acceptable, forbidden_leaks, ambiguous, predicted_relations, matched_relations, unmatched_relations, unscored_relations FROM v, w, u, q, l, l2)
        SELECT *, concat_ws(',', CASE WHEN annotator_agreement < 0.8 THEN 'annotator_agreement' END, CASE WHEN duplicate_rate > 0.05 THEN 'duplicate_rate' END, CASE WHEN effective_precision < 0.9 THEN 'effective_precision' END, CASE WHEN extractable_outline_coverage < 0.85 THEN 'extractable_outline_coverage' END,
          CASE WHEN forbidden_leakage_rate > 0 THEN 'forbidden_leakage_rate' END, CASE WHEN relation_precision < 0.8 THEN 'relation_precision' END, CASE WHEN relation_recall < 0.75 THEN 'relation_recall' END, CASE WHEN required_recall < 0.85 THEN 'required_recall' END) AS failed_gates, failed_gates = '' AS passed FROM z""",
}
