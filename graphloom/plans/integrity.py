"""Queries over references and hierarchies: p3_ and p5_, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.keys import clean_key
from graphloom.operators.hierarchy import descendants, hierarchy
from graphloom.operators.references import orphan_references, orphan_report
from graphloom.session import read_table


def current_outlines(spark: SparkSession, folder: str) -> DataFrame:
    """The current state of each outline node by (pkg, nid): the row with the latest updated_at.

    A null updated_at counts as earliest; among rows of one time the greatest (created_at, id,
    parent_id, depth) is taken, so equal rows are one.
    """
    rows = read_table(spark, folder, "outlines").select(
        clean_key(F.col("package_id")).alias("pkg"),
        clean_key(F.col("id")).alias("nid"),
        F.struct(
            "updated_at", "created_at", "id", clean_key(F.col("parent_id")).alias("parent"), "depth", "package_id", "title", "sort_order", "deleted_at"
        ).alias("now"),
    )
    return (
        rows.filter(F.col("nid").isNotNull())
        .groupBy("pkg", "nid")
        .agg(F.max("now").alias("now"))
        .select("pkg", "nid", "now.*")
    )


def p3_orphans(spark: SparkSession, folder: str) -> DataFrame:
    """Failing references of provenance, package_contents and course_edges, with table and period."""
    contents = read_table(spark, folder, "package_contents")
    package = clean_key(F.col("package_id")).alias("pkg")
    provenance = read_table(spark, folder, "provenance").select(
        F.col("prov_id").alias("ref_id"),
        F.lit("content_id").alias("ref_field"),
        F.col("recorded_at").alias("ref_time"),
        package,
        clean_key(F.col("content_id")).alias("key"),
    )
    content_keys = contents.select(
        package, clean_key(F.col("content_id")).alias("key"), F.col("deleted_at").isNull().alias("live"), "created_at"
    )
    in_outlines = contents.select(
        F.col("content_key").alias("ref_id"),
        F.lit("outline_id").alias("ref_field"),
        F.col("created_at").alias("ref_time"),
        package,
        clean_key(F.col("outline_id")).alias("key"),
    )
    outlines = read_table(spark, folder, "outlines").select(
        package, clean_key(F.col("id")).alias("key"), F.struct("updated_at", F.col("deleted_at").isNull().alias("live")).alias("state"), "created_at"
    )
    # of an outline node only the current state says whether it is deleted
    outline_keys = (
        outlines.groupBy("pkg", "key")
        .agg(F.max("state").alias("state"), F.min("created_at").alias("created_at"))
        .select("pkg", "key", F.col("state.live").alias("live"), "created_at")
    )
    ends = (
        read_table(spark, folder, "course_edges")
        .select(
            F.col("edge_id").alias("ref_id"),
            F.col("created_at").alias("ref_time"),
            F.explode(
                F.array(
                    F.struct(F.lit("source").alias("ref_field"), clean_key(F.col("source")).alias("key")),
                    F.struct(F.lit("target").alias("ref_field"), clean_key(F.col("target")).alias("key")),
                )
            ).alias("end"),
        )
        .select("ref_id", "end.ref_field", "ref_time", "end.key")
    )
    node = [clean_key(F.col("node_id")).alias("key"), F.col("deleted_at").isNull().alias("live"), "created_at"]
    node_keys = read_table(spark, folder, "course_nodes").select(*node).unionByName(
        read_table(spark, folder, "concept_registry").select(*node)
    )
    parts = [
        ("provenance", orphan_references(provenance, content_keys, ["pkg", "key"])),
        ("package_contents", orphan_references(in_outlines, outline_keys, ["pkg", "key"])),
        ("course_edges", orphan_references(ends, node_keys, ["key"])),
    ]
    made = [
        found.select(
            F.lit(table).alias("ref_table"),
            F.col("ref_id").cast("bigint").alias("ref_id"),
            "ref_field",
            "orphan_kind",
            F.date_format("ref_time", "yyyy-MM").alias("period"),
        )
        for table, found in parts
    ]
    return made[0].unionByName(made[1]).unionByName(made[2])


def p3_report(spark: SparkSession, folder: str) -> DataFrame:
    """Failing references per table, field, month and kind."""
    return orphan_report(p3_orphans(spark, folder), ["ref_table", "ref_field", "period"])


def _manifest_match(spark: SparkSession, folder: str, match: str) -> DataFrame:
    """The manifest's references (package, outline entry) that fail under a match semantics of their own;
    blank columns are null, so all null masks occur."""
    contents, outlines = read_table(spark, folder, "package_contents"), read_table(spark, folder, "outlines")
    keys = lambda a, b: [clean_key(F.col(a)).alias("pkg"), clean_key(F.col(b)).alias("key")]
    refs = contents.select(F.col("content_key").alias("ref_id"), F.lit("outline_id").alias("ref_field"), F.col("created_at").alias("ref_time"), *keys("package_id", "outline_id"))
    goal = outlines.select(*keys("package_id", "id"), F.col("deleted_at").isNull().alias("live"), "created_at")
    return orphan_references(refs, goal, ["pkg", "key"], match).select("ref_id", "orphan_kind")


def p3_partial(spark: SparkSession, folder: str) -> DataFrame:
    """Manifest references whose non-null columns occur together in no living or earlier outline row."""
    return _manifest_match(spark, folder, "partial")


def p3_full(spark: SparkSession, folder: str) -> DataFrame:
    """Manifest references that fail where all columns or none have to be given."""
    return _manifest_match(spark, folder, "full")


def _outline_tree(spark: SparkSession, folder: str, paths: bool) -> DataFrame:
    """The hierarchy of the current outline nodes (see current_outlines) by (pkg, nid)."""
    rows = read_table(spark, folder, "outlines").select(
        clean_key(F.col("package_id")).alias("pkg"), clean_key(F.col("id")).alias("nid"), clean_key(F.col("parent_id")).alias("parent"), "updated_at", "created_at", "id", "depth", "package_id"
    )
    latest = ["updated_at", "created_at", "id"]
    return hierarchy(rows, "pkg", "nid", "parent", paths, latest=latest, carry=[] if paths else ["depth", "package_id", "id"])


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes on, below or off a hierarchy, and those whose stored depth is not their steps."""
    tree = _outline_tree(spark, folder, paths=False)
    finding = F.when(F.col("status") != "ok", F.col("status")).when(F.col("depth") != F.col("steps"), "wrong_depth")
    return tree.select("package_id", "id", finding.alias("finding")).filter("finding is not null")


def p5_hierarchy(spark: SparkSession, folder: str) -> DataFrame:
    """Path, depth, root and number of descendants of every node that reaches a root."""
    tree = _outline_tree(spark, folder, paths=True)
    return tree.filter("status = 'ok'").select(
        F.col("pkg").alias("package_id"),
        F.col("nid").alias("id"),
        F.array_join("path", "/").alias("path"),
        F.col("steps").alias("depth"),
        "root",
        "n_descendants",
    )


def p5_descendants(spark: SparkSession, folder: str) -> DataFrame:
    """Every (ancestor, descendant, distance) of a package."""
    tree = _outline_tree(spark, folder, paths=True)
    return descendants(tree, "pkg", "nid").select(
        F.col("pkg").alias("package_id"), "ancestor", "descendant", "distance"
    )


QUERIES = {
    "p3_found": p3_orphans,
    "p3_report": p3_report,
    "p3_partial": p3_partial,
    "p3_full": p3_full,
    "p5_found": p5_found,
    "p5_hierarchy": p5_hierarchy,
    "p5_descendants": p5_descendants,
}

_CLEAN = r"nullif(lower(regexp_replace({}, '^[\p{{Z}}\s]+|[\p{{Z}}\s]+$', '', 'g')), '')"


def _clean(column: str) -> str:
    return _CLEAN.format(column)


_ORPHANS = f"""
WITH refs AS (
  SELECT DISTINCT 'provenance' AS ref_table, prov_id AS ref_id, 'content_id' AS ref_field, recorded_at AS at,
         {_clean("package_id")} AS pkg, {_clean("content_id")} AS k FROM provenance
  UNION SELECT 'package_contents', content_key, 'outline_id', created_at,
         {_clean("package_id")}, {_clean("outline_id")} FROM package_contents
  UNION SELECT 'course_edges', edge_id, 'source', created_at, '', {_clean("source")} FROM course_edges
  UNION SELECT 'course_edges', edge_id, 'target', created_at, '', {_clean("target")} FROM course_edges),
goal AS (
  SELECT 'provenance' AS ref_table, {_clean("package_id")} AS pkg, {_clean("content_id")} AS k,
         bool_or(deleted_at IS NULL) AS live, min(created_at) AS born FROM package_contents GROUP BY ALL
  UNION ALL
  SELECT 'package_contents', {_clean("package_id")}, {_clean("id")},
         arg_max(deleted_at IS NULL, updated_at), min(created_at) FROM outlines GROUP BY ALL
  UNION ALL
  SELECT 'course_edges', '', k, bool_or(live), min(born) FROM (
    SELECT {_clean("node_id")} AS k, deleted_at IS NULL AS live, created_at AS born FROM course_nodes
    UNION ALL SELECT {_clean("node_id")}, deleted_at IS NULL, created_at FROM concept_registry) GROUP BY k),
found AS (
  SELECT r.ref_table, r.ref_id, r.ref_field,
         CASE WHEN g.k IS NULL THEN 'missing' WHEN NOT g.live THEN 'deleted' WHEN g.born > r.at THEN 'late' END AS orphan_kind,
         strftime(r.at AT TIME ZONE 'UTC', '%Y-%m') AS period
  FROM refs r LEFT JOIN goal g ON r.ref_table = g.ref_table AND r.pkg = g.pkg AND r.k = g.k
  WHERE r.k IS NOT NULL AND r.pkg IS NOT NULL)
"""

_TREE = f"""
WITH RECURSIVE now AS (
  SELECT {_clean("package_id")} AS pkg, {_clean("id")} AS nid, arg_max(id, updated_at) AS id, arg_max(package_id, updated_at) AS package_id,
         arg_max({_clean("parent_id")}, updated_at) FILTER (WHERE true) AS parent0, max(updated_at) AS at
  FROM outlines GROUP BY ALL),
cur AS (
  SELECT DISTINCT n.pkg, n.nid, n.id, n.package_id, {_clean("o.parent_id")} AS parent, o.depth
  FROM now n JOIN outlines o ON {_clean("o.package_id")} = n.pkg AND {_clean("o.id")} = n.nid AND o.updated_at = n.at),
up(pkg, nid, anc) AS (
  SELECT pkg, nid, parent FROM cur WHERE parent IS NOT NULL
  UNION SELECT u.pkg, u.nid, c.parent FROM up u JOIN cur c ON c.pkg = u.pkg AND c.nid = u.anc WHERE c.parent IS NOT NULL),
ring AS (SELECT pkg, nid FROM up WHERE anc = nid),
lost AS (SELECT DISTINCT u.pkg, u.nid FROM up u LEFT JOIN cur c ON c.pkg = u.pkg AND c.nid = u.anc WHERE c.nid IS NULL),
status AS (
  SELECT c.pkg, c.nid, c.id, c.package_id, c.depth, c.parent,
         CASE WHEN r.nid IS NOT NULL THEN 'cycle'
              WHEN EXISTS (SELECT 1 FROM up u JOIN ring q ON q.pkg = u.pkg AND q.nid = u.anc WHERE u.pkg = c.pkg AND u.nid = c.nid) THEN 'below_cycle'
              WHEN l.nid IS NOT NULL THEN 'detached' ELSE 'ok' END AS status,
         (SELECT count(*) FROM up u WHERE u.pkg = c.pkg AND u.nid = c.nid) AS steps
  FROM cur c LEFT JOIN ring r ON r.pkg = c.pkg AND r.nid = c.nid LEFT JOIN lost l ON l.pkg = c.pkg AND l.nid = c.nid)
"""

_MANIFEST = f"""
WITH r AS (SELECT DISTINCT content_key AS ref_id, created_at AS made, {_clean("package_id")} AS pkg, {_clean("outline_id")} AS k FROM package_contents),
g AS (SELECT {_clean("package_id")} AS pkg, {_clean("id")} AS k, deleted_at IS NULL AS live, created_at AS born FROM outlines),
g2 AS (SELECT pkg, k, bool_or(live) AS live, min(born) AS born FROM g WHERE pkg IS NOT NULL AND k IS NOT NULL GROUP BY 1, 2),
gp AS (SELECT pkg, bool_or(live) AS live, min(born) AS born FROM g WHERE pkg IS NOT NULL GROUP BY 1),
gk AS (SELECT k, bool_or(live) AS live, min(born) AS born FROM g WHERE k IS NOT NULL GROUP BY 1),
m AS (SELECT r.*, CASE WHEN r.pkg IS NOT NULL AND r.k IS NOT NULL THEN 'both' WHEN r.pkg IS NOT NULL THEN 'pkg' WHEN r.k IS NOT NULL THEN 'key' END AS mask FROM r),
j AS (SELECT m.*, coalesce(a.born, b.born, c.born) AS born, coalesce(a.live, b.live, c.live) AS live FROM m LEFT JOIN g2 a ON m.mask = 'both' AND a.pkg = m.pkg AND a.k = m.k
  LEFT JOIN gp b ON m.mask = 'pkg' AND b.pkg = m.pkg LEFT JOIN gk c ON m.mask = 'key' AND c.k = m.k),
f AS (SELECT ref_id, mask, CASE WHEN live IS NULL THEN 'missing' WHEN NOT live THEN 'deleted' WHEN born > made THEN 'late' END AS orphan_kind FROM j WHERE mask IS NOT NULL)
"""

SQL = {
    "p3_partial": _MANIFEST + "SELECT ref_id, orphan_kind FROM f WHERE orphan_kind IS NOT NULL",
    "p3_full": _MANIFEST + "SELECT ref_id, CASE WHEN mask <> 'both' THEN 'malformed' ELSE orphan_kind END AS orphan_kind FROM f WHERE mask <> 'both' OR orphan_kind IS NOT NULL",
    "p3_found": _ORPHANS + "SELECT * FROM found WHERE orphan_kind IS NOT NULL",
    "p3_report": _ORPHANS
    + """SELECT ref_table, ref_field, period, orphan_kind, count(*) AS n_references
         FROM found WHERE orphan_kind IS NOT NULL GROUP BY ALL""",
    "p5_found": _TREE
    + """SELECT package_id, id, finding FROM (
         SELECT package_id, id, CASE WHEN status <> 'ok' THEN status WHEN depth <> steps THEN 'wrong_depth' END AS finding FROM status)
         WHERE finding IS NOT NULL""",
    "p5_hierarchy": _TREE
    + """, paths(pkg, nid, path, depth, root) AS (
           SELECT pkg, nid, nid, 0, nid FROM status WHERE status = 'ok' AND parent IS NULL
           UNION ALL SELECT s.pkg, s.nid, p.path || '/' || s.nid, p.depth + 1, p.root
           FROM paths p JOIN status s ON s.pkg = p.pkg AND s.parent = p.nid WHERE s.status = 'ok')
         SELECT p.pkg AS package_id, p.nid AS id, p.path, CAST(p.depth AS BIGINT) AS depth, p.root,
                (SELECT count(*) FROM up u JOIN status s ON s.pkg = u.pkg AND s.nid = u.nid AND s.status = 'ok'
                 WHERE u.pkg = p.pkg AND u.anc = p.nid) AS n_descendants FROM paths p""",
    "p5_descendants": _TREE
    + """, pairs(pkg, anc, nid, distance) AS (
           SELECT pkg, parent, nid, 1 FROM status WHERE status = 'ok' AND parent IS NOT NULL
           UNION ALL SELECT p.pkg, s.parent, p.nid, p.distance + 1
           FROM pairs p JOIN status s ON s.pkg = p.pkg AND s.nid = p.anc WHERE s.parent IS NOT NULL)
         SELECT pkg AS package_id, anc AS ancestor, nid AS descendant, distance FROM pairs""",
}
