"""Method flows over all documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import flows
from graphloom.session import read_table

#: When the documents count as observed.
OBSERVED = "2025-01-01"


def _run(spark: SparkSession, folder: str, method: str) -> flows.Graph | flows.Layers:
    return flows.run(method, read_table(spark, folder, "documents").select("doc_id", "text"), "doc_id", "text", OBSERVED)


def _links(spark: SparkSession, folder: str, method: str, *more: str) -> DataFrame:
    edges = _run(spark, folder, method).edges
    return edges.select(F.col("_key").alias("edge_key"), "source", "target", F.md5("description").alias("digest"), *more)


def method_graph_rag(spark: SparkSession, folder: str) -> DataFrame:
    return _links(spark, folder, "graph_rag")


def method_light_rag(spark: SparkSession, folder: str) -> DataFrame:
    return _links(spark, folder, "light_rag")


def method_kg_gen(spark: SparkSession, folder: str) -> DataFrame:
    return _links(spark, folder, "kg_gen")


def method_itext2kg(spark: SparkSession, folder: str) -> DataFrame:
    return _links(spark, folder, "itext2kg")


def method_itext2kg_star(spark: SparkSession, folder: str) -> DataFrame:
    return _links(spark, folder, "itext2kg_star", "observed")


def method_atom(spark: SparkSession, folder: str) -> DataFrame:
    """Facts packed, edges of the packs, observation times united."""
    out = _links(spark, folder, "atom", "t_obs")
    return out.withColumn("t_obs", F.array_join("t_obs", ","))


def _members(graph: flows.Graph) -> DataFrame:
    return graph.edges.select(F.md5("_key").alias("edge_key"), F.size("members").alias("n_members"), F.md5(F.array_join("members", ",")).alias("members"))


def method_hyper_rag(spark: SparkSession, folder: str) -> DataFrame:
    return _members(_run(spark, folder, "hyper_rag"))


def method_hypergraph_rag(spark: SparkSession, folder: str) -> DataFrame:
    return _members(_run(spark, folder, "hypergraph_rag"))


def method_cog_rag(spark: SparkSession, folder: str) -> DataFrame:
    """Both layers: themes of the documents and details of their sentences."""
    layers = _run(spark, folder, "cog_rag")
    themes, details = _members(layers.themes), _members(layers.details)
    return themes.withColumn("layer", F.lit("theme")).unionByName(details.withColumn("layer", F.lit("detail")))


def method_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """The nodes of a two-stage method and whether an edge-first method has them too."""
    texts = read_table(spark, folder, "documents").select("doc_id", "text")
    all_nodes = flows.run("kg_gen", texts, "doc_id", "text").nodes.select("name")
    linked = flows.run("itext2kg_star", texts, "doc_id", "text", OBSERVED).nodes.select("name", F.lit(True).alias("linked"))
    return all_nodes.join(linked, "name", "left").fillna({"linked": False})


QUERIES = {
    f.__name__: f
    for f in (method_graph_rag, method_light_rag, method_hyper_rag, method_hypergraph_rag, method_cog_rag, method_kg_gen, method_itext2kg, method_itext2kg_star, method_atom, method_nodes)
}

_FACTS = r"""s0 AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(text, '([。！？])', '\1' || chr(10), 'g'), '([.!?])\s+', '\1' || chr(10), 'g'), '\n+'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: len(s) > 0) AS ss FROM documents),
    f AS (SELECT doc_id, unnest(ss) AS fact, generate_subscripts(ss, 1) - 1 AS place FROM s0),
    w AS (SELECT f.*, unnest(x) AS term, generate_subscripts(x, 1) AS nth FROM (SELECT *, regexp_extract_all(lower(fact), '[a-z]{6,}') AS x FROM f) f),
    t AS (SELECT doc_id, place, fact, term, row_number() OVER (PARTITION BY doc_id, place ORDER BY min(nth)) AS i FROM w GROUP BY doc_id, place, fact, term),
    l AS (SELECT a.doc_id, a.place, a.i, a.term AS source, b.term AS target, a.fact AS description FROM t a JOIN t b ON b.doc_id = a.doc_id AND b.place = a.place AND b.i = a.i + 1),
    h AS (SELECT doc_id, place, fact, list(term ORDER BY term) AS members FROM t GROUP BY ALL)"""


def _sql(key: str, joined: bool, more: str = "") -> str:
    # by `rule` an edge's distinct descriptions are lines in the order of their first places
    digest = "md5(string_agg(description, chr(10) ORDER BY seq))" if joined else "md5(arg_min(description, seq))"
    rows = "(SELECT source, target, description, min((doc_id, place, i)) AS seq FROM l GROUP BY ALL)"
    return f"WITH {_FACTS} SELECT {key} AS edge_key, source, target, {digest} AS digest{more} FROM {rows} GROUP BY source, target"


_HYPER = "SELECT md5({0}) AS edge_key, len(members) AS n_members, md5(array_to_string(members, ',')) AS members FROM {1} GROUP BY ALL"
_THEMES = """th AS (SELECT description, list_sort(list_distinct(flatten(list(members)))) AS members FROM (SELECT h.doc_id, f.fact AS description, list_distinct(flatten(list(h.members))) AS members FROM h JOIN f ON f.doc_id = h.doc_id AND f.place = 0 GROUP BY 1, 2) GROUP BY 1)"""

SQL = {
    "method_graph_rag": _sql("'(' || source || ',' || target || ')'", True),
    "method_light_rag": _sql("source || '->' || target", True),
    "method_kg_gen": _sql("source || '|related|' || target", False),
    "method_itext2kg": _sql("source || '|related|' || target", True),
    "method_itext2kg_star": _sql("source || '|related|' || target", False, f", '{OBSERVED}' AS observed"),
    "method_atom": _sql("source || '|related|' || target", True, f", '{OBSERVED}' AS t_obs"),
    "method_hyper_rag": f"WITH {_FACTS} " + _HYPER.format("array_to_string(members, '_')", "h WHERE len(members) > 1"),
    "method_hypergraph_rag": f"WITH {_FACTS} " + _HYPER.format("md5(fact)", "(SELECT DISTINCT fact, members FROM h)"),
    "method_cog_rag": f"WITH {_FACTS}, {_THEMES} SELECT *, 'theme' AS layer FROM (" + _HYPER.format("md5(description)", "th") + ") UNION ALL SELECT *, 'detail' FROM (" + _HYPER.format("array_to_string(members, '_')", "h WHERE len(members) > 1") + ")",
    "method_nodes": f"WITH {_FACTS} SELECT DISTINCT term AS name, term IN (SELECT source FROM l UNION SELECT target FROM l) AS linked FROM t",
}
