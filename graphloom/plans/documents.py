"""Queries over extraction, packages and notes, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.containers import KeyedSet
from graphloom.functions import text, vectors
from graphloom.functions.keys import clean_key
from graphloom.operators import candidates, extract, prompts
from graphloom.operators.course import attach_ids
from graphloom.operators.hierarchy import hierarchy
from graphloom.plans.integrity import _TREE, _clean, current_outlines
from graphloom.session import cut_lineage, read_table
from graphloom.sources import packages, vault
from graphloom.streaming.incremental import windowed_counts


def extract_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Term nodes of all documents with the number of documents that name them."""
    found = extract.extract(read_table(spark, folder, "documents"), ["doc_id"], "text", extract.term_nodes, extract.NODE)
    return found.filter("error is null").groupBy("name").agg(F.count_distinct("doc_id").alias("n_documents"))


def extract_term_graph(spark: SparkSession, folder: str) -> DataFrame:
    """Edges between terms, two-stage, merged by ends with their number of mentions."""
    chunks = read_table(spark, folder, "documents").select("doc_id", "text")
    _, edges = extract.extract_graph(chunks, ["doc_id"], "text", extract.TERMS)
    return edges.filter("error is null").groupBy("source", "target", "edge_type").agg(F.count(F.lit(1)).alias("n_mentions"))


def parse_answers(spark: SparkSession, folder: str) -> DataFrame:
    """What JSON each model answer holds."""
    rows = read_table(spark, folder, "generation_responses").dropDuplicates(["response_id"]).select("response_id", F.col("final_text").alias("answer"))
    parsed = extract.parse_records(rows, "answer", "nodes array<struct<name: string, summary: string, confidence: double>>, edges array<struct<name: string>>, answer string, error string")
    return parsed.groupBy("state").agg(F.count(F.lit(1)).alias("n_answers"))


def package_blocks(spark: SparkSession, folder: str) -> DataFrame:
    contents = read_table(spark, folder, "package_contents").dropDuplicates(["content_key"]).filter("deleted_at is null")
    now = current_outlines(spark, folder).select("package_id", "id", F.col("parent").alias("parent_id"), "title")
    provenance = read_table(spark, folder, "provenance").dropDuplicates(["prov_id"])
    out = packages.package_blocks(contents, now, provenance)
    return out.select("package_id", "content_id", "top_level_id", F.array_join("outline_path", " > ").alias("outline_path"), F.size("source_refs").alias("n_refs"))


def package_validation(spark: SparkSession, folder: str) -> DataFrame:
    contents = read_table(spark, folder, "package_contents").dropDuplicates(["content_key"])
    now = current_outlines(spark, folder).select("package_id", "id", F.col("parent").alias("parent_id"), "depth")
    return packages.validate(contents, now)


def _concepts(spark: SparkSession, folder: str) -> DataFrame:
    """(node_id, node_name, domain, seq): one row per node id of courses and shared concepts, the earliest."""
    columns = [clean_key(F.col("node_id")).alias("node_id"), "node_name", "created_at"]
    courses = read_table(spark, folder, "course_nodes").select(*columns, F.lit(None).cast("string").alias("domain"), "record_id")
    shared = read_table(spark, folder, "concept_registry").select(*columns, "domain", F.lit(None).cast("bigint").alias("record_id"))
    first = F.min_by(F.struct("node_name", "domain", F.col("created_at").alias("seq")), F.struct("created_at", "record_id", "node_name"))
    return courses.unionByName(shared).filter("node_id is not null").groupBy("node_id").agg(first.alias("_n")).select("node_id", "_n.*")


def vault_notes(spark: SparkSession, folder: str) -> DataFrame:
    """Notes of all course nodes and shared concepts and the links that edges make between them."""
    edges = read_table(spark, folder, "course_edges").select(clean_key(F.col("source")).alias("source"), clean_key(F.col("target")).alias("target"), "edge_type")
    files = vault.notes(_concepts(spark, folder).drop("seq"), edges, "node_id", "node_name", ["node_id", "domain"])
    return vault.manifest(files)


def note_names(spark: SparkSession, folder: str) -> DataFrame:
    nodes = read_table(spark, folder, "course_nodes").groupBy("record_id").agg(F.first("node_name").alias("node_name"))
    return vault.note_stems(nodes, "record_id", "node_name").select("record_id", "stem")


def set_search(spark: SparkSession, folder: str) -> DataFrame:
    """The course nodes and concepts nearest to a phrase, from a keyed set with its index."""
    items = KeyedSet.of(_concepts(spark, folder), "node_id").build_index(["node_name"])
    return items.search("blood culture", 5).select("node_id", "node_name", F.round("distance", 4).alias("distance"))


def event_windows(spark: SparkSession, folder: str) -> DataFrame:
    return windowed_counts(read_table(spark, folder, "events"), "ts", "10 minutes", "1 hour", ["event_type"])


def exact_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with the same text: one row per document with its class and the class's size."""
    d = read_table(spark, folder, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    classes = d.groupBy("digest").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return d.join(classes, "digest").select("doc_id", "class_id", "class_size")


def similar_names(spark: SparkSession, folder: str) -> DataFrame:
    """Node names of each package with their class of similar names and their number of links."""
    rows = read_table(spark, folder, "course_nodes").select(F.col("package_id").alias("scope"), text.normal_name(F.col("node_name")).alias("name"))
    return candidates.similar_names(rows)


def _merged(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of each package, by name, after similar nodes were merged."""
    rows = read_table(spark, folder, "course_nodes").dropDuplicates(["record_id"]).select(F.col("package_id").alias("scope"), F.col("node_name").alias("name"), "summary")
    named = read_table(spark, folder, "course_nodes").groupBy(F.col("package_id").alias("scope"), "node_id").agg(F.min_by("node_name", "record_id").alias("_name"))
    edges = read_table(spark, folder, "course_edges").select(F.col("package_id").alias("scope"), "source", "target", "edge_type").distinct()
    for end in ("source", "target"):
        # an end of another package keeps its id
        edges = edges.join(named.withColumnRenamed("node_id", end), ["scope", end], "left").withColumn(end, F.coalesce("_name", end)).drop("_name")
    return candidates.merge_similar(rows, edges)


def semantic_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes of each package after similar ones were merged."""
    return _merged(spark, folder)[0].select("scope", "name")


def semantic_dedup_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Edges between the merged nodes, loops and repeated ones left out."""
    return _merged(spark, folder)[1].select("scope", "source", "target", "edge_type")


def _queried(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = read_table(spark, folder, "course_nodes").dropDuplicates(["record_id"])
    rows = rows.select(F.col("package_id").alias("scope"), F.col("record_id").alias("id"), text.normal_name(F.col("node_name")).alias("name"), "parent_outline_id", vectors.embed(F.col("node_name")).alias("vector"), F.concat_ws("\n", "node_name", "summary", "evidence").alias("body"))
    return rows.filter("id % 20 = 0"), rows


def contrast_partners(spark: SparkSession, folder: str) -> DataFrame:
    """For every twentieth node the most contrasting name of its package."""
    queries, rows = _queried(spark, folder)
    return candidates.partners(queries, rows, ["name"], candidates.contrast, 1).drop("reason")


def edge_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """For every twentieth node the closest of its package that are similar, near or mentioned."""
    queries, rows = _queried(spark, folder)
    return candidates.partners(queries, rows, ["vector", "parent_outline_id", "name", "body"], candidates.closeness(0.7), 2).drop("reason")


def global_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """For every twentieth node the unrelated node of its chapter worth asking about, and the pair of most
    contrast of its section, with the reasons."""
    now = current_outlines(spark, folder)
    tree = hierarchy(now.select("pkg", "nid", "parent"), "pkg", "nid", "parent")
    chapters = tree.select("pkg", F.col("nid").alias("_up"), F.concat_ws("/", "pkg", F.coalesce(F.get("path", F.lit(1)), "root", "nid")).alias("scope"))
    nodes = read_table(spark, folder, "course_nodes").dropDuplicates(["record_id"])
    nodes = nodes.select(
        F.col("record_id").alias("id"), clean_key(F.col("node_id")).alias("_node"), clean_key(F.col("package_id")).alias("pkg"), clean_key(F.col("parent_outline_id")).alias("_up"),
        text.normal_name(F.col("node_name")).alias("name"), F.concat_ws("\n", "node_name", "summary", "evidence").alias("body"), vectors.embed(F.col("node_name")).alias("vector"),
    )
    nodes = cut_lineage(nodes.join(chapters, ["pkg", "_up"]).withColumn("section", F.concat_ws("/", "pkg", "_up")).drop("pkg", "_up"))
    ids = nodes.groupBy(F.col("_node").alias("name")).agg(F.min("id").alias("id"))
    edges = read_table(spark, folder, "course_edges").select(clean_key(F.col("source")).alias("source"), clean_key(F.col("target")).alias("target")).distinct()
    linked = attach_ids(edges, ids, []).select(F.col("source_id").alias("source"), F.col("target_id").alias("target"))
    return candidates.global_candidates(nodes.filter("id % 20 = 0"), nodes.drop("_node"), linked)


def chunk_contexts(spark: SparkSession, folder: str) -> DataFrame:
    """Which context fits each source block: its package's outline with its section as the current one,
    known terms, pages and text, within a window."""
    rows = read_table(spark, folder, "outlines").withColumns({"pkg": clean_key(F.col("package_id")), "nid": clean_key(F.col("id")), "parent": clean_key(F.col("parent_id"))})
    # the current state as current_outlines() finds it, behind the hierarchy's own exchange
    latest = ["updated_at", "created_at", "id", "parent", "depth", "package_id"]
    tree = hierarchy(rows.filter("pkg is not null"), "pkg", "nid", "parent", paths=False, latest=latest, carry=["title", "sort_order"], branches=True)
    entries = cut_lineage(prompts.outline_entries(tree.withColumnsRenamed({"pkg": "scope", "nid": "id"})))
    none = F.array().cast("array<string>")
    blocks = read_table(spark, folder, "source_blocks")
    blocks = blocks.select("block_id", F.col("package_id").alias("document"), clean_key(F.col("package_id")).alias("scope"), clean_key(F.col("outline_id")).alias("id"), "text", F.coalesce("outline_path", none).alias("terms"))
    blocks = blocks.withColumn("scope_text", prompts.scope_lines(F.array("id"), F.array("terms")))
    fitted = prompts.fit_outlines(blocks, entries, 2000, 500).select("block_id", "context_level", F.md5("context").alias("digest"))
    # repeated rows are left out by their results, which are short
    return fitted.groupBy("block_id").agg(F.min(F.struct("context_level", "digest")).alias("_r")).select("block_id", "_r.*")


QUERIES = {f.__name__: f for f in (extract_terms, extract_term_graph, parse_answers, package_blocks, package_validation, vault_notes, note_names, set_search, event_windows, exact_duplicates, similar_names, semantic_dedup, semantic_dedup_edges, contrast_partners, edge_candidates, global_candidates, chunk_contexts)}

SQL = {
    "package_validation": _TREE
    + f""", c AS (SELECT DISTINCT ON (content_key) {_clean("package_id")} AS pkg, {_clean("content_id")} AS cid, content_path, sort_order, {_clean("outline_id")} AS oid, sha256 FROM package_contents),
         stored AS (SELECT {_clean("package_id")} AS pkg, {_clean("id")} AS nid, arg_max(struct_pack(d := depth), updated_at).d AS d FROM outlines GROUP BY 1, 2)
         SELECT pkg AS package_id, cid AS subject, 'duplicate content id' AS violation FROM c GROUP BY 1, 2 HAVING count(*) > 1
         UNION ALL SELECT pkg, sort_order::VARCHAR, 'duplicate order' FROM c GROUP BY 1, 2 HAVING count(*) > 1 UNION ALL SELECT pkg, content_path, 'duplicate path' FROM c GROUP BY 1, 2 HAVING count(*) > 1
         UNION ALL SELECT pkg, cid, 'unsafe path' FROM c WHERE content_path IS NULL OR trim(content_path) = '' OR regexp_matches(content_path, '^[/\\\\]|^[A-Za-z]:|(^|[/\\\\])\\.\\.([/\\\\]|$)|\\\\')
         UNION ALL SELECT pkg, cid, 'bad digest' FROM c WHERE NOT coalesce(regexp_matches(sha256, '^[0-9a-f]{{64}}$'), false)
         UNION ALL SELECT pkg, cid, 'unknown outline entry' FROM c WHERE oid IS NOT NULL AND NOT EXISTS (SELECT 1 FROM status s WHERE s.pkg = c.pkg AND s.nid = c.oid)
         UNION ALL SELECT pkg, nid, 'outline ' || status FROM status WHERE status <> 'ok'
         UNION ALL SELECT s.pkg, s.nid, 'wrong depth' FROM status s JOIN stored t ON t.pkg = s.pkg AND t.nid = s.nid WHERE status = 'ok' AND t.d <> steps
         UNION ALL SELECT pkg, count(*)::VARCHAR, 'several roots' FROM status WHERE status = 'ok' AND steps = 0 GROUP BY 1 HAVING count(*) > 1""",
    "event_windows": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "exact_duplicates": "SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS class_id, count(*) OVER (PARTITION BY text) AS class_size FROM documents",
    "package_blocks": _TREE
    + f""", titles AS (SELECT {_clean("package_id")} AS pkg, {_clean("id")} AS nid, arg_max(title, updated_at) AS title FROM outlines GROUP BY 1, 2),
         refs AS (SELECT {_clean("package_id")} AS pkg, {_clean("content_id")} AS cid, count(DISTINCT r.ref) AS n FROM (SELECT package_id, content_id, unnest(source_refs) AS r FROM provenance) GROUP BY 1, 2),
         paths(pkg, nid, path, top) AS (
           SELECT c.pkg, c.nid, t.title, NULL::VARCHAR FROM status c JOIN titles t ON t.pkg = c.pkg AND t.nid = c.nid WHERE c.status = 'ok' AND c.parent IS NULL
           UNION ALL SELECT s.pkg, s.nid, p.path || ' > ' || t.title, coalesce(p.top, s.nid) FROM paths p JOIN status s ON s.pkg = p.pkg AND s.parent = p.nid JOIN titles t ON t.pkg = s.pkg AND t.nid = s.nid WHERE s.status = 'ok')
         SELECT c.package_id, c.content_id, CASE WHEN p.nid IS NOT NULL THEN coalesce(p.top, p.nid) END AS top_level_id, p.path AS outline_path, coalesce(r.n, 0) AS n_refs
         FROM (SELECT DISTINCT ON (content_key) * FROM package_contents) c LEFT JOIN paths p ON p.pkg = {_clean("c.package_id")} AND p.nid = {_clean("c.outline_id")}
         LEFT JOIN refs r ON r.pkg = {_clean("c.package_id")} AND r.cid = {_clean("c.content_id")} WHERE c.deleted_at IS NULL AND c.extract_flag""",
}
