"""Method flows: from texts to merged graphs, hypergraphs and layers, by column expressions alone.

Facts are sentences; a fact's terms are what a pattern finds in it. Binary methods link neighbouring terms
of a fact, hypergraph methods take all terms of a fact as one edge's members. A two-stage method
names the nodes first and links only known ones; an edge-first method takes its nodes from the edges.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.containers import Graph
from graphloom.functions.vectors import embed
from graphloom.methods import METHODS
from graphloom.operators import chunks, graphs
from graphloom.operators.candidates import close_vectors
from graphloom.operators.graphs import connected_components
from graphloom.session import cut_lineage

#: Terms: words of six and more plain letters, in lower case.
WORDS = "[a-z]{6,}"


def sentences(text: Column) -> Column:
    """The non-blank sentences of text, trimmed."""
    marked = F.regexp_replace(F.regexp_replace(text, "([。！？])", "$1\n"), r"([.!?])\s+", "$1\n")
    return F.filter(F.transform(F.split(marked, r"\n+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: F.length(s) > 0)


def facts(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, place, fact) of every sentence of every text, in order from 0; null texts have none."""
    return texts.select(key, F.posexplode(sentences(F.col(text))).alias("place", "fact"))


def terms(fact: Column, pattern: str = WORDS) -> Column:
    """The distinct terms of a fact, in order of their first occurrence."""
    return F.array_distinct(F.regexp_extract_all(F.lower(fact), F.lit(f"({pattern})"), F.lit(1)))


def packed_facts(rows: DataFrame, key: str, size: int, most: int) -> DataFrame:
    """facts() after packing: each pack's facts again, so that an extractor may work on packs."""
    packs = chunks.pack_facts(rows.withColumn("place", F.col("place").cast("bigint")), [key], ["place"], "fact", size, most)
    lines = F.split("pack_text", r"\n(?=\[Fact \d+\]: )")
    first = packs.select(key, "pack_no", F.posexplode(lines).alias("_i", "_line"))
    return first.select(key, (F.col("pack_no") * most + F.col("_i")).alias("place"), F.regexp_replace("_line", r"^\[Fact \d+\]: ", "").alias("fact"))


def term_links(rows: DataFrame, key: str, pattern: str = WORDS) -> DataFrame:
    """(source, target, name, description, seq): links between neighbouring terms of a fact."""
    found = rows.select(key, "place", "fact", terms(F.col("fact"), pattern).alias("_t")).filter(F.size("_t") > 1)
    pairs = F.arrays_zip(F.slice("_t", F.lit(1), F.size("_t") - 1).alias("a"), F.slice("_t", F.lit(2), F.size("_t") - 1).alias("b"))
    out = found.select(key, "place", "fact", F.posexplode(pairs).alias("_i", "_p"))
    return out.select(F.col("_p.a").alias("source"), F.col("_p.b").alias("target"), F.lit("related").alias("name"), F.col("fact").alias("description"), F.struct(F.col(key).alias("a"), F.col("place").cast("bigint").alias("b"), F.col("_i").alias("c")).alias("seq"))


def term_segments(rows: DataFrame, key: str, least: int, pattern: str = WORDS) -> DataFrame:
    """(members, knowledge_segment, seq): facts with at least so many terms as hyperedges."""
    found = rows.select(F.array_sort(terms(F.col("fact"), pattern)).alias("members"), F.col("fact").alias("knowledge_segment"), F.struct(F.col(key).alias("a"), F.col("place").cast("bigint").alias("b"), F.lit(0).alias("c")).alias("seq"))
    return found.filter(F.size("members") >= least)


def nodes_of(edges: DataFrame, hyper: bool) -> DataFrame:
    """(name, seq) of the nodes that edges name, each once, at its first place."""
    names = F.col("members") if hyper else F.array("source", "target")
    return edges.select(F.explode(names).alias("name"), "seq").groupBy("name").agg(F.min("seq").alias("seq"))


@dataclass(frozen=True)
class Layers:
    """Two hypergraphs over one text: themes above, details below."""

    themes: Graph
    details: Graph


def run(method: str, texts: DataFrame, key: str, text: str, observed: str | None = None, pattern: str = WORDS, size: int = chunks.CHUNK_SIZE, most: int = 10) -> Graph | Layers:
    """The graph that a method makes of texts: extracted, merged by the method's keys and strategy, pruned.

    observed is the time of observation: atom keeps it with each edge as `t_obs`, itext2kg_star as
    `observed`. texts without any term give an empty graph.
    """
    preset = METHODS[method]
    rows = facts(texts, key, text)
    if method == "cog_rag":
        # a theme is told by a text's opening, and all that the text names takes part in it
        opening = F.struct(F.col(key).alias("a"), F.lit(0).cast("bigint").alias("b"), F.lit(0).alias("c"))
        named = texts.select(key, sentences(F.col(text)).alias("_s")).filter(F.size("_s") > 0)
        members = F.array_sort(F.array_distinct(F.flatten(F.transform("_s", lambda s: terms(s, pattern)))))
        themes = named.select(members.alias("members"), F.get("_s", F.lit(0)).alias("description"), opening.alias("seq")).filter(F.size("members") > 0)
        themes = cut_lineage(themes.withColumn("segment", F.md5("description")))
        details = cut_lineage(term_segments(rows, key, 2, pattern).withColumnRenamed("knowledge_segment", "description"))
        upper = Graph.of(nodes_of(themes, True), themes, edge_key="segment", strategy="rule", hyper=True)
        return Layers(upper, preset.build(nodes_of(details, True), details))
    if preset.hyper:
        edges = term_segments(rows, key, 1 if method == "hypergraph_rag" else 2, pattern)
        edges = edges.withColumn("knowledge_segment", F.md5("knowledge_segment")) if method == "hypergraph_rag" else edges.withColumnRenamed("knowledge_segment", "description")
        edges = cut_lineage(edges)
        return preset.build(nodes_of(edges, True), edges)
    if method == "atom":
        rows = packed_facts(rows, key, size, most)
    links = term_links(rows, key, pattern)
    if method == "atom":
        links = links.withColumn("t_obs", F.array(F.lit(observed)))
    elif method == "itext2kg_star":
        links = links.withColumn("observed", F.lit(observed))
    links = cut_lineage(links.withColumn("edge_type", F.col("name")))
    if preset.stages == 2:
        # the first stage names the nodes, among them such as no link has
        every = rows.select(F.explode(terms(F.col("fact"), pattern)).alias("name"), F.struct(F.col(key).alias("a"), F.col("place").cast("bigint").alias("b"), F.lit(0).alias("c")).alias("seq"))
        return preset.build(every.groupBy("name").agg(F.min("seq").alias("seq")), links)
    return preset.build(nodes_of(links, False), links)


def match_nodes(graph: Graph, least: float) -> Graph:
    """graph with nodes that are alike by their names' vectors made one: the smallest name of each class of
    nodes linked by a cosine of at least `least` (chains count). Edges are renamed and merged again."""
    names = graph.nodes.select("name").distinct()
    close = close_vectors(names.select(F.lit(0).alias("scope"), "name", embed(F.col("name")).alias("vector")), least)
    classes = connected_components(names.select(F.col("name").alias("id")), close.select(F.col("name").alias("src"), F.col("other").alias("dst")))
    mapping = cut_lineage(classes.filter("id <> component").select(F.col("id").alias("old"), F.col("component").alias("new")))
    nodes = graphs.relabel(graph.nodes, mapping, ["name"]).drop("_key")
    edges = graphs.relabel(graph.edges, mapping, ["source", "target"]).filter("source <> target").drop("_key")
    options = {"node_key": graph.node_key, "edge_key": graph.edge_key, "time": graph.time, "place": graph.place, "strategy": graph.strategy}
    return Graph.of(nodes, edges, **options)


def two_layer_context(layers: Layers, query: str, themes: int = 3, entities: int = 3) -> str:
    """The context of an answer from both layers (indexed): the nearest themes with their members, then
    the nearest entities. Both are bounded top-k lists."""
    upper, _ = layers.themes.search(query, 0, themes)[::-1]
    lower = layers.details.search(query, entities, 0)[0]
    told = [f"- {r.description} (Involved: {', '.join(r.members)})" for r in upper.orderBy("distance", "_key").collect()]
    named = [f"- {r.name}" for r in lower.orderBy("distance", "_key").collect()]
    parts = (["=== THEMES ===", *told] if told else []) + (["=== ENTITIES ===", *named] if named else [])
    return "\n".join(parts) or "No relevant information found."


def graph_context(graph: Graph, query: str, nodes: int = 3, edges: int = 3) -> str:
    """The context of an answer from a graph or hypergraph: the nearest nodes and edges under headings, each
    as JSON without its key."""
    found = graph.search(query, nodes, edges)
    parts = []
    for title, rows in zip(("## Nodes", "## Edges"), found):
        shown = [c for c in rows.columns if c not in ("_key", "seq", "distance")]
        if "distance" in rows.columns:
            lines = [r.j for r in rows.orderBy("distance", "_key").select(F.to_json(F.struct(*shown)).alias("j")).collect()]
            parts += [title, *lines] if lines else []
    return "\n".join(parts) or "No relevant information found."


def global_context(reports: DataFrame, rating: str, title: str, summary: str, first: int = 3) -> DataFrame:
    """The best-rated reports, ties by title: the context of a question about the whole."""
    return reports.orderBy(F.desc(rating), title).limit(first).select(title, summary, rating)
