"""Queries over keyed sets, lists, graphs, hypergraphs, gates, measures and vectors, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import dates, ids, text, vectors
from graphloom.functions.keys import clean_key
from graphloom.operators import chunks, graphs, lists, merge, quality, search, sets
from graphloom.operators.hierarchy import hierarchy
from graphloom.plans.integrity import _TREE, _clean, _outline_tree, current_outlines
from graphloom.session import cut_lineage, read_table

# ---------------------------------------------------------------- shared inputs


def _nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Course nodes, one row per record, keyed by package and normalised name. A confidence of NaN is no
    confidence, so it is null here."""
    rows = read_table(spark, folder, "course_nodes").dropDuplicates(["record_id"])
    if "confidence" in rows.columns:
        rows = rows.withColumn("confidence", F.nanvl("confidence", F.lit(None).cast("double")))
    return rows.withColumn("k", text.normal_name(F.col("node_name")))


_NODES = "nodes AS (SELECT DISTINCT ON (record_id) * REPLACE (CASE WHEN NOT isnan(confidence) THEN confidence END AS confidence), regexp_replace(lower(node_name), '[^0-9a-z㐀-鿿]+', '', 'g') AS k FROM course_nodes)"


def _edges(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "course_edges").dropDuplicates(["edge_id"])


_EDGES = "edges AS (SELECT DISTINCT ON (edge_id) * FROM course_edges)"

# ---------------------------------------------------------------- scalar functions


def scalar_names(spark: SparkSession, folder: str) -> DataFrame:
    n = read_table(spark, folder, "course_nodes").dropDuplicates(["record_id"])
    name = F.col("node_name")
    return n.select(
        "record_id",
        text.normal_name(name).alias("normal"),
        ids.node_id(name).alias("stable_id"),
        ids.short_id("sec", name).alias("section_id"),
        F.md5(name).alias("md5_key"),
        text.file_stem(name).alias("stem"),
        text.wikilink(text.file_stem(name), F.col("knowledge_kind")).alias("link"),
        text.first_filled(F.col("summary"), F.col("evidence"), name).alias("shown"),
    )


def scalar_tokens(spark: SparkSession, folder: str) -> DataFrame:
    d = read_table(spark, folder, "documents")
    return d.select("doc_id", text.token_estimate(F.col("text")).alias("tokens"), text.token_estimate(F.col("text"), 0).alias("usage_tokens"))


def scalar_titles(spark: SparkSession, folder: str) -> DataFrame:
    now = current_outlines(spark, folder)
    return now.select("pkg", "nid", text.title_key(F.col("title")).alias("title_key"))


def key_templates(spark: SparkSession, folder: str) -> DataFrame:
    e = _edges(spark, folder)
    raw = ids.key_template("{source}|{edge_type}|{target}")
    a, b = ids.undirected(F.col("source"), F.col("target"))
    return e.select(
        "edge_id",
        raw.alias("edge_key"),
        ids.key_template("{source}|{description}", "None").alias("none_key"),
        ids.edge_key(raw, F.date_format("created_at", "yyyy-MM"), F.col("package_id")).alias("timed_key"),
        F.concat_ws("|", a, b).alias("pair_key"),
    )


def relative_dates(spark: SparkSession, folder: str) -> DataFrame:
    o = read_table(spark, folder, "orders")
    day = F.col("o_orderdate")
    names = ["yesterday", "last week", "this month", "last month", "this year", "last year"]
    return o.select("o_orderkey", *[dates.relative_date(F.lit(n), day).alias(n.replace(" ", "_")) for n in names])


def secret_redaction(spark: SparkSession, folder: str) -> DataFrame:
    e = read_table(spark, folder, "events")
    line = F.concat(F.lit("call by api_key="), F.md5(F.col("user_id").cast("string")), F.lit(" used Bearer "), F.sha1(F.col("event_id").cast("string")), F.lit(" and sk-"), F.md5(F.col("event_id").cast("string")), F.lit(" done"))
    return e.select("event_id", text.redact_secrets(line).alias("line"))


# ---------------------------------------------------------------- keyed merge


def _items(spark: SparkSession, folder: str) -> DataFrame:
    return _nodes(spark, folder).filter("k <> ''").select("package_id", "k", "record_id", "node_name", "knowledge_kind", "confidence", "aliases")


def merge_keep_existing(spark: SparkSession, folder: str) -> DataFrame:
    return merge.keyed_merge(_items(spark, folder), ["package_id", "k"], ["record_id"], "keep_existing")


def merge_keep_incoming(spark: SparkSession, folder: str) -> DataFrame:
    return merge.keyed_merge(_items(spark, folder), ["package_id", "k"], ["record_id"], "keep_incoming")


def merge_fields(spark: SparkSession, folder: str) -> DataFrame:
    out = merge.keyed_merge(_items(spark, folder), ["package_id", "k"], ["record_id"], "merge_field")
    return out.withColumn("aliases", F.array_join("aliases", "|"))


def merge_rule(spark: SparkSession, folder: str) -> DataFrame:
    rows = _nodes(spark, folder).filter("k <> ''").select("package_id", "k", "record_id", "knowledge_kind", F.col("summary").alias("description"), "aliases")
    out = merge.keyed_merge(rows, ["package_id", "k"], ["record_id"], "rule")
    return out.withColumn("aliases", F.array_join("aliases", "|"))


def merge_longest(spark: SparkSession, folder: str) -> DataFrame:
    rows = _nodes(spark, folder).filter("k <> ''").select("package_id", "k", "record_id", "node_name", "summary", "evidence", "aliases", "confidence")
    out = merge.longest_merge(rows, ["package_id", "k"], ["record_id"], ["summary", "evidence"], ["aliases"], ["confidence"])
    return out.withColumn("aliases", F.array_join("aliases", "|"))


def merge_edges(spark: SparkSession, folder: str) -> DataFrame:
    rows = _edges(spark, folder).filter("source is not null and target is not null").select("edge_id", "source", "target", "edge_type", "confidence")
    return merge.best_edges(rows, "edge_id")


def merge_singleton(spark: SparkSession, folder: str) -> DataFrame:
    """One record per order: the fields of its last line."""
    rows = read_table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    rows = rows.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("l_partkey"), F.max("l_suppkey").alias("l_suppkey"))
    return merge.keyed_merge(rows, ["l_orderkey"], ["l_linenumber"], "merge_field")


# ---------------------------------------------------------------- sets and lists


def _point_key(name: Column) -> Column:
    """normal_name, or the bytes of a name that has nothing it keeps, so that no name is without a key."""
    key = text.normal_name(name)
    return F.when(key != "", key).otherwise(F.hex(F.lower(F.trim(F.coalesce(name, F.lit(""))))))


def _live_and_deleted(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The points that records not deleted name, and those that deleted ones name: each record is in one."""
    rows = _nodes(spark, folder).withColumn("k", _point_key(F.col("node_name")))
    points = lambda some: merge.keyed_merge(some.select("package_id", "k", "record_id", "node_name"), ["package_id", "k"], ["record_id"])
    return points(rows.filter("deleted_at is null")), points(rows.filter("deleted_at is not null"))


def set_union(spark: SparkSession, folder: str) -> DataFrame:
    return sets.union(*_live_and_deleted(spark, folder), ["package_id", "k"])


def set_intersection(spark: SparkSession, folder: str) -> DataFrame:
    return sets.intersection(*_live_and_deleted(spark, folder), ["package_id", "k"])


def set_difference(spark: SparkSession, folder: str) -> DataFrame:
    return sets.difference(*_live_and_deleted(spark, folder), ["package_id", "k"])


def set_symmetric_difference(spark: SparkSession, folder: str) -> DataFrame:
    return sets.symmetric_difference(*_live_and_deleted(spark, folder), ["package_id", "k"])


def set_relation(spark: SparkSession, folder: str) -> DataFrame:
    c, s = read_table(spark, folder, "customer"), read_table(spark, folder, "supplier")
    a, b = c.select(F.col("c_nationkey").alias("n")), s.select(F.col("s_nationkey").alias("n")).filter("n < 12")
    return sets.relation(b, a, ["n"])


def list_slice(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return lists.slice_(lists.renumber(rows, [F.col("o_orderkey")]), -5, 10, -3)


def list_edits(spark: SparkSession, folder: str) -> DataFrame:
    rows = lists.renumber(read_table(spark, folder, "part").select("p_partkey", "p_name"), [F.col("p_partkey")])
    more = lists.renumber(read_table(spark, folder, "nation").select(F.col("n_nationkey").cast("bigint").alias("p_partkey"), F.col("n_name").alias("p_name")), [F.col("p_partkey")])
    changed = lists.replace(lists.delete(lists.insert(rows, 10, more), 3), -1, {"p_name": "last"})
    return lists.reverse(lists.concat(changed, more))


def list_count(spark: SparkSession, folder: str) -> DataFrame:
    e = read_table(spark, folder, "events")
    return e.groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n_equal"))


# ---------------------------------------------------------------- graphs


def prune_dangling(spark: SparkSession, folder: str) -> DataFrame:
    nodes = read_table(spark, folder, "course_nodes").select("node_id").unionByName(read_table(spark, folder, "concept_registry").select("node_id"))
    return graphs.prune_edges(_edges(spark, folder).select("edge_id", "source", "target"), nodes, "node_id")


def _hyperedges(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with the parts of their lines: a hyperedge per order."""
    lines = read_table(spark, folder, "lineitem").select("l_orderkey", "l_partkey").distinct()
    return lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_partkey")).alias("members"))


def prune_hyper(spark: SparkSession, folder: str) -> DataFrame:
    parts = read_table(spark, folder, "part").filter("p_size > 5")
    kept = graphs.prune_hyperedges(_hyperedges(spark, folder), parts, "p_partkey", "l_orderkey", "members")
    return kept.select("l_orderkey", F.size("members").alias("n_members"), F.array_join("members", ",").alias("members"))


def hyper_incidence(spark: SparkSession, folder: str) -> DataFrame:
    return graphs.incidence(_hyperedges(spark, folder), "l_orderkey", "members")


def graph_undirected(spark: SparkSession, folder: str) -> DataFrame:
    return graphs.merge_parallel(_edges(spark, folder).select("edge_id", "source", "target", "weight"), "edge_id")


def graph_degrees(spark: SparkSession, folder: str) -> DataFrame:
    return graphs.degrees(_edges(spark, folder))


def _whole_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """All ids that a node, a shared concept or an edge names, and all edges with two ends as links."""
    e = _edges(spark, folder).select(clean_key(F.col("source")).alias("src"), clean_key(F.col("target")).alias("dst"))
    named = [read_table(spark, folder, t).select(clean_key(F.col("node_id")).alias("id")) for t in ("course_nodes", "concept_registry")]
    ids_ = named[0].unionByName(named[1]).unionByName(e.select(F.explode(F.array("src", "dst")).alias("id")))
    return ids_.filter("id is not null").distinct(), e.filter("src is not null and dst is not null")


def graph_components(spark: SparkSession, folder: str) -> DataFrame:
    """The component of every node, shared concept and edge end."""
    return graphs.connected_components(*_whole_graph(spark, folder))


def graph_communities(spark: SparkSession, folder: str) -> DataFrame:
    _, e = _whole_graph(spark, folder)
    return graphs.communities(e.withColumn("weight", F.lit(1.0)))


def graph_reports(spark: SparkSession, folder: str) -> DataFrame:
    """Size, first members and first relations of every component."""
    nodes, e = _whole_graph(spark, folder)
    parts = cut_lineage(graphs.connected_components(nodes, e))
    return graphs.community_report(parts, "component", "id", edges=e)


def graph_induced(spark: SparkSession, folder: str) -> DataFrame:
    nodes = read_table(spark, folder, "course_nodes").groupBy("node_id").agg(F.min("package_id").alias("grp"))
    e = _edges(spark, folder).select("edge_id", "source", "target")
    return graphs.induced_subgraphs(nodes, e, "node_id", "grp")


def graph_impact(spark: SparkSession, folder: str) -> DataFrame:
    """What the rejected edges would have connected."""
    nodes, _ = _whole_graph(spark, folder)
    e = _edges(spark, folder).select(clean_key(F.col("source")).alias("src"), clean_key(F.col("target")).alias("dst"), (F.coalesce("status", F.lit("")) == "rejected").alias("out")).filter("src is not null and dst is not null")
    return graphs.connectivity_impact(nodes, e.filter("not out"), e.filter("out"))


def graph_relabel(spark: SparkSession, folder: str) -> DataFrame:
    """Edge ends renamed to the smallest spelling of their cleaned id."""
    e = _edges(spark, folder).select("edge_id", "source", "target")
    ends = e.select(F.explode(F.array("source", "target")).alias("old")).filter("old is not null").distinct()
    ends = ends.withColumn("c", F.lower(F.trim("old")))
    mapping = ends.join(ends.groupBy("c").agg(F.min("old").alias("new")), "c").filter("old <> new").select("old", "new")
    return graphs.relabel(e, mapping, ["source", "target"])


def graph_ancestors(spark: SparkSession, folder: str) -> DataFrame:
    """Top-level ancestor of each outline node: the second place of its path, or itself."""
    tree = _outline_tree(spark, folder, paths=True)
    return tree.filter("status = 'ok'").select("pkg", "nid", F.coalesce(F.get("path", F.lit(1)), F.col("nid")).alias("top_level"))


def graph_v1(spark: SparkSession, folder: str) -> DataFrame:
    """Published graph: outline and knowledge nodes with the structural edge that holds each."""
    now = current_outlines(spark, folder).filter("deleted_at is null")
    outline = now.select("pkg", F.col("nid").alias("id"), F.lit("outline").alias("kind"), F.col("parent").alias("held_by"), F.col("title").alias("name"))
    kept = _nodes(spark, folder).filter("deleted_at is null and k <> ''")
    kept = kept.groupBy(F.lower(F.trim("package_id")).alias("pkg"), ids.node_id(F.col("node_name")).alias("id")).agg(
        F.min_by(F.lower(F.trim("parent_outline_id")), "record_id").alias("held_by"), F.min_by("node_name", "record_id").alias("name")
    )
    return outline.unionByName(kept.select("pkg", "id", F.lit("knowledge").alias("kind"), "held_by", "name"))


# ---------------------------------------------------------------- quality


def _outline_rows(spark: SparkSession, folder: str) -> DataFrame:
    return current_outlines(spark, folder).select(F.col("package_id").alias("scope"), F.col("nid").alias("outline_id"), "title")


def _gate_input(spark: SparkSession, folder: str) -> DataFrame:
    return _nodes(spark, folder).select("record_id", F.col("package_id").alias("scope"), F.col("node_name").alias("name"), "evidence", "summary", F.lower(F.trim("parent_outline_id")).alias("parent_outline_id"))


def gate_nodes(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.gate_nodes(_gate_input(spark, folder), _outline_rows(spark, folder), "record_id", 20, 40)
    return judged.select("record_id", F.coalesce("reason", F.lit("accepted")).alias("reason"))


def repair_parents(spark: SparkSession, folder: str) -> DataFrame:
    titles = _outline_rows(spark, folder)
    nodes = _gate_input(spark, folder)
    # every fourth node is called like an outline entry of its package
    named = titles.groupBy("scope").agg(F.min("title").alias("_t"))
    nodes = nodes.join(named, "scope", "left").withColumn("name", F.when(F.col("record_id") % 4 == 0, F.coalesce("_t", "name")).otherwise(F.col("name"))).drop("_t")
    return quality.repair_parents(nodes, titles).select("record_id", "parent_outline_id")


def gate_edges(spark: SparkSession, folder: str) -> DataFrame:
    e = _edges(spark, folder).select("edge_id", F.lit("all").alias("scope"), "source", "target", "edge_type", "description", "confidence")
    names = read_table(spark, folder, "course_nodes").select(F.lit("all").alias("scope"), F.col("node_id").alias("name"))
    return quality.gate_edges(e, names, "edge_id").select("edge_id", F.coalesce("reason", F.lit("accepted")).alias("reason"))


def quality_coverage(spark: SparkSession, folder: str) -> DataFrame:
    tree = _outline_tree(spark, folder, paths=True)
    covered = read_table(spark, folder, "course_nodes").select(F.lower(F.trim("package_id")).alias("pkg"), F.lower(F.trim("parent_outline_id")).alias("nid"))
    return quality.coverage(tree, covered, "pkg", "nid")


def quality_evaluation(spark: SparkSession, folder: str) -> DataFrame:
    """All nodes measured against labelled points: every point of every package with its aliases."""
    nodes = _nodes(spark, folder).withColumn("k", _point_key(F.col("node_name")))
    inside = lambda key: F.concat(F.col("package_id"), F.lit(" "), key)
    predicted = nodes.select(inside(F.col("k")).alias("name"), F.col("parent_outline_id").alias("outline_id"))
    label = F.element_at(F.array(F.lit("required"), F.lit("acceptable"), F.lit("forbidden")), (F.col("record_id") % 3 + 1).cast("int"))
    gold = nodes.groupBy("package_id", "k").agg(F.min("record_id").alias("record_id"), F.min_by("parent_outline_id", "record_id").alias("outline_id"), F.flatten(F.collect_list("aliases")).alias("_aliases"))
    also = F.transform(F.filter("_aliases", lambda a: F.length(F.trim(a)) > 0), lambda a: inside(_point_key(a)))
    gold = gold.select(F.col("record_id").alias("gold_id"), label.alias("label"), F.array_distinct(F.concat(F.array(inside(F.col("k"))), also)).alias("names"), "outline_id")
    return quality.evaluate(predicted, gold)


def quality_agreement(spark: SparkSession, folder: str) -> DataFrame:
    return quality.agreement(read_table(spark, folder, "lineitem"), "l_partkey", "l_returnflag")


def quality_quarantine(spark: SparkSession, folder: str) -> DataFrame:
    checks = {
        "confidence": F.col("confidence").between(0, 1),
        "name": F.length(F.trim("node_name")) > 0,
        "summary": F.col("summary").isNotNull(),
        "refs": F.size("source_refs") > 0,
    }
    _, bad, _ = quality.quarantine(_nodes(spark, folder), checks)
    return bad.select("record_id", F.array_join("violations", ",").alias("violations"))


def usage_rollup(spark: SparkSession, folder: str) -> DataFrame:
    e = read_table(spark, folder, "events").withColumn("mode", F.concat(F.lit("m"), (F.col("user_id") % 4).cast("string")))
    measures = {"calls": F.count(F.lit(1)), "failed": F.count(F.when(F.col("event_type") == "error", 1)), "amount": F.round(F.sum(F.col("value").cast("decimal(18,2)")), 2).cast("double")}
    return quality.rollup(e, ["event_type", "mode"], measures)


def latest_per_key(spark: SparkSession, folder: str) -> DataFrame:
    e = read_table(spark, folder, "events")
    return e.groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id")).alias("x")).select("user_id", "x.event_id", "x.event_type")


# ---------------------------------------------------------------- chunks


def chunk_halving(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "source_blocks").dropDuplicates(["block_id"]).select("block_id", F.col("text").alias("chunk_text"))
    out = chunks.halve(rows, "block_id", "chunk_text")
    return out.select("block_id", F.md5("chunk_text").alias("digest"), F.length("chunk_text").alias("n_chars"))


def chunk_table_text(spark: SparkSession, folder: str) -> DataFrame:
    cells = read_table(spark, folder, "nation").select(F.col("n_regionkey").alias("t"), F.col("n_nationkey").alias("r"), F.explode(F.map_from_arrays(F.array(F.lit(0), F.lit(1)), F.array("n_name", F.col("n_nationkey").cast("string")))).alias("c", "v"))
    return chunks.table_text(cells, "t", "r", "c", "v")


def chunk_split(spark: SparkSession, folder: str) -> DataFrame:
    return chunks.split_texts(read_table(spark, folder, "documents"), "doc_id", "text", 512, 64)


def chunk_packing(spark: SparkSession, folder: str) -> DataFrame:
    blocks = read_table(spark, folder, "source_blocks").dropDuplicates(["block_id"])
    blocks = blocks.select(F.col("package_id").alias("doc"), F.col("top_level_id").alias("chapter"), F.col("block_id").alias("block_no"), "block_id", "outline_id", "text")
    return chunks.pack_blocks(blocks, 400, 600).drop("text")


def chunk_facts(spark: SparkSession, folder: str) -> DataFrame:
    rows = _nodes(spark, folder).select("package_id", "record_id", "evidence")
    return chunks.pack_facts(rows, ["package_id"], ["record_id"], "evidence")


def chunk_batches(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "documents").select("collection_id", "doc_id", "n_chars")
    return chunks.batch_numbers(rows, ["collection_id"], ["doc_id"], "n_chars", 16, 20_000)


def ref_hydration(spark: SparkSession, folder: str) -> DataFrame:
    refs = _nodes(spark, folder).select("record_id", F.posexplode("source_refs").alias("place", "ref")).filter("trim(ref) <> ''")
    pattern = r"^(.*)#L(\d+)-L(\d+)$"
    return refs.select("record_id", "place", F.regexp_extract("ref", pattern, 1).alias("path"), *[F.regexp_extract("ref", pattern, i).try_cast("int").alias(n) for i, n in ((2, "start_line"), (3, "end_line"))])


# ---------------------------------------------------------------- vectors


def search_one(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "embeddings")
    query = [float(x) for x in rows.filter("vec_id = 0").first()["embedding"]]
    return search.search(rows, "vec_id", "embedding", query, 10).select("vec_id", F.round("distance", 5).alias("distance"))


def search_batch(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "embeddings")
    found = search.search_many(rows.filter("vec_id % 20 = 0"), rows, "vec_id", "embedding", 5)
    return found.withColumn("distance", F.round("distance", 5))


def similar_batch(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "embeddings")
    found = search.similar_many(rows.filter("vec_id % 20 = 0"), rows, "vec_id", "embedding", 0.75)
    return found.withColumn("similarity", F.round("similarity", 5))


def vector_mean(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "embeddings").select("label", "embedding")
    pooled = vectors.mean_pool(rows, "label", "embedding")
    return pooled.select("label", F.posexplode("embedding").alias("place", "x")).select("label", "place", F.round("x", 5).alias("x"))


def search_context(spark: SparkSession, folder: str) -> DataFrame:
    """An answer's context: the three largest orders as JSON records."""
    top = read_table(spark, folder, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(3)
    return search.context_text(top, "o_orderkey", ["o_orderkey", "o_custkey"])


QUERIES = {
    f.__name__: f
    for f in (
        scalar_names, scalar_tokens, scalar_titles, key_templates, relative_dates, secret_redaction,
        merge_keep_existing, merge_keep_incoming, merge_fields, merge_rule, merge_longest, merge_edges, merge_singleton,
        set_union, set_intersection, set_difference, set_symmetric_difference,
        set_relation, list_slice, list_edits, list_count,
        prune_dangling, prune_hyper, hyper_incidence, graph_undirected, graph_degrees, graph_components, graph_communities, graph_reports,
        graph_induced, graph_impact, graph_relabel, graph_ancestors, graph_v1,
        gate_nodes, repair_parents, gate_edges, quality_coverage, quality_evaluation, quality_agreement, quality_quarantine, usage_rollup, latest_per_key,
        chunk_halving, chunk_table_text, chunk_split, chunk_packing, chunk_facts, chunk_batches, ref_hydration,
        search_one, search_batch, similar_batch, vector_mean, search_context,
    )
}

_ITEMS = f"{_NODES}, items AS (SELECT package_id, k, record_id, node_name, knowledge_kind, confidence, aliases FROM nodes WHERE k <> '')"
_KEPT = (
    f"{_NODES}, keyed AS (SELECT *, CASE WHEN k <> '' THEN k ELSE upper(hex(encode(lower(trim(coalesce(node_name, '')))))) END AS key FROM nodes), "
    "l AS (SELECT package_id, key AS k, min(record_id) AS record_id, arg_min(node_name, record_id) AS node_name FROM keyed WHERE deleted_at IS NULL GROUP BY 1, 2), "
    "r AS (SELECT package_id, key AS k, min(record_id) AS record_id, arg_min(node_name, record_id) AS node_name FROM keyed WHERE deleted_at IS NOT NULL GROUP BY 1, 2)"
)
_TOKENS = "len(regexp_replace(text, '[^㐀-鿿]', '', 'g'))"
_STEM = r"nullif(trim(left(regexp_replace(trim(regexp_replace(regexp_replace(node_name, '[\\/:*?\"<>|#^\[\]\r\n\t]', ' ', 'g'), '\s+', ' ', 'g')), '^\.+|\.+$', '', 'g'), 120)), '')"
_PARTS = r"list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: len(p) > 0)"
_ENDS = f"{_EDGES}, e AS (SELECT {_clean('source')} AS src, {_clean('target')} AS dst, coalesce(status, '') = 'rejected' AS out FROM edges), v AS (SELECT id FROM (SELECT {_clean('node_id')} AS id FROM course_nodes UNION SELECT {_clean('node_id')} FROM concept_registry UNION SELECT src FROM e UNION SELECT dst FROM e) WHERE id IS NOT NULL), both_ways AS (SELECT src, dst FROM e WHERE src IS NOT NULL AND dst IS NOT NULL UNION SELECT dst, src FROM e WHERE src IS NOT NULL AND dst IS NOT NULL)"
_LABELS = "cc(id, label) USING KEY (id) AS (SELECT id, id FROM {v} UNION SELECT n.id, n.label FROM (SELECT b.dst AS id, min(cc.label) AS label FROM cc JOIN {b} b ON b.src = cc.id GROUP BY b.dst) n JOIN recurring.cc r ON r.id = n.id WHERE n.label < r.label)"
_HYPER = "h AS (SELECT l_orderkey, list_sort(list(DISTINCT l_partkey)) AS members FROM lineitem GROUP BY ALL)"
_CUR = _TREE
_OUTLINES = f"cur AS (SELECT arg_max(package_id, updated_at) AS scope, {_clean('package_id')} AS pkg, {_clean('id')} AS outline_id, arg_max(title, updated_at) AS title FROM outlines GROUP BY 2, 3)"

SQL = {
    "scalar_names": f"""SELECT DISTINCT record_id, regexp_replace(lower(node_name), '[^0-9a-z㐀-鿿]+', '', 'g') AS normal,
        'kp-' || left(sha1(regexp_replace(lower(node_name), '[^0-9a-z㐀-鿿]+', '', 'g')), 16) AS stable_id,
        'sec-' || left(sha1(node_name), 12) AS section_id, md5(node_name) AS md5_key, coalesce({_STEM}, 'untitled') AS stem,
        CASE WHEN knowledge_kind <> coalesce({_STEM}, 'untitled') AND len(knowledge_kind) > 0 THEN '[[' || coalesce({_STEM}, 'untitled') || '|' || knowledge_kind || ']]'
             ELSE '[[' || coalesce({_STEM}, 'untitled') || ']]' END AS link,
        CASE WHEN len(trim(summary)) > 0 THEN summary WHEN len(trim(evidence)) > 0 THEN evidence WHEN len(trim(node_name)) > 0 THEN node_name END AS shown FROM course_nodes""",
    "scalar_tokens": f"SELECT doc_id, greatest(1, {_TOKENS} + ceil((len(text) - {_TOKENS}) / 4))::INT AS tokens, ({_TOKENS} + ceil((len(text) - {_TOKENS}) / 4))::INT AS usage_tokens FROM documents",
    "scalar_titles": f"WITH {_OUTLINES} SELECT pkg, outline_id AS nid, regexp_replace(lower(regexp_replace(title, '^\\s*\\d+(\\.\\d+)*\\s*', '')), '[^0-9a-z㐀-鿿]+', '', 'g') AS title_key FROM cur",
    "key_templates": f"""WITH {_EDGES} SELECT edge_id, coalesce(source, '') || '|' || coalesce(edge_type, '') || '|' || coalesce(target, '') AS edge_key,
        coalesce(source, 'None') || '|' || coalesce(description, 'None') AS none_key,
        coalesce(source, '') || '|' || coalesce(edge_type, '') || '|' || coalesce(target, '') || ' @ ' || strftime(created_at AT TIME ZONE 'UTC', '%Y-%m') || ' at ' || package_id AS timed_key,
        concat_ws('|', least(source, target), greatest(source, target)) AS pair_key FROM edges""",
    "relative_dates": """SELECT o_orderkey, (o_orderdate::DATE - 1) AS yesterday, date_trunc('week', o_orderdate::DATE - 7)::DATE AS last_week,
        date_trunc('month', o_orderdate)::DATE AS this_month, date_trunc('month', o_orderdate - INTERVAL 1 MONTH)::DATE AS last_month,
        date_trunc('year', o_orderdate)::DATE AS this_year, date_trunc('year', o_orderdate - INTERVAL 1 YEAR)::DATE AS last_year FROM orders""",
    "secret_redaction": "SELECT event_id, 'call by api_key=[REDACTED] used Bearer [REDACTED] and sk-[REDACTED] done' AS line FROM events",
    "merge_keep_existing": f"WITH {_ITEMS} SELECT * FROM items QUALIFY row_number() OVER (PARTITION BY package_id, k ORDER BY record_id) = 1",
    "merge_keep_incoming": f"WITH {_ITEMS} SELECT * FROM items QUALIFY row_number() OVER (PARTITION BY package_id, k ORDER BY record_id DESC) = 1",
    "merge_fields": f"""WITH {_ITEMS} SELECT package_id, k, min(record_id) AS record_id, arg_max(node_name, record_id) AS node_name, arg_max(knowledge_kind, record_id) AS knowledge_kind,
        arg_max(confidence, record_id) AS confidence, array_to_string(flatten(list(aliases ORDER BY record_id)), '|') AS aliases FROM items GROUP BY package_id, k""",
    "merge_rule": f"""WITH {_NODES}, kinds AS (SELECT package_id, k, arg_min(knowledge_kind, (-n, knowledge_kind)) AS knowledge_kind FROM
          (SELECT package_id, k, knowledge_kind, count(*) AS n FROM nodes WHERE k <> '' AND knowledge_kind IS NOT NULL GROUP BY ALL) GROUP BY ALL),
        texts AS (SELECT package_id, k, string_agg(summary, chr(10) ORDER BY r) AS description FROM (SELECT package_id, k, summary, min(record_id) AS r FROM nodes WHERE k <> '' AND summary IS NOT NULL GROUP BY ALL) GROUP BY ALL)
        SELECT n.package_id, n.k, min(n.record_id) AS record_id, any_value(q.knowledge_kind) AS knowledge_kind, coalesce(any_value(t.description), '') AS description,
          array_to_string(list_sort(list_distinct(flatten(list(n.aliases)))), '|') AS aliases
        FROM nodes n LEFT JOIN kinds q ON q.package_id = n.package_id AND q.k = n.k LEFT JOIN texts t ON t.package_id = n.package_id AND t.k = n.k WHERE n.k <> '' GROUP BY n.package_id, n.k""",
    "merge_longest": f"""WITH {_NODES} SELECT package_id, k, min(record_id) AS record_id, arg_min(node_name, record_id) AS node_name, arg_max(summary, (len(summary), -record_id)) FILTER (WHERE summary IS NOT NULL) AS summary,
        arg_max(evidence, (len(evidence), -record_id)) FILTER (WHERE evidence IS NOT NULL) AS evidence, array_to_string(list_sort(list_distinct(flatten(list(aliases)))), '|') AS aliases,
        max(confidence) AS confidence FROM nodes WHERE k <> '' GROUP BY package_id, k""",
    "merge_edges": f"""WITH {_EDGES}, t AS (SELECT edge_id, CASE WHEN edge_type IN ('related', 'confusable') THEN least(source, target) ELSE source END AS source,
        CASE WHEN edge_type IN ('related', 'confusable') THEN greatest(source, target) ELSE target END AS target, edge_type, confidence FROM edges WHERE source IS NOT NULL AND target IS NOT NULL)
        SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY source, target, edge_type ORDER BY coalesce(confidence, -1) DESC, edge_id) = 1""",
    "merge_singleton": """WITH o AS (SELECT l_orderkey, l_linenumber, max(l_partkey) AS p, max(l_suppkey) AS s FROM lineitem GROUP BY ALL)
        SELECT l_orderkey, min(l_linenumber) AS l_linenumber, arg_max(p, l_linenumber) AS l_partkey, arg_max(s, l_linenumber) AS l_suppkey FROM o GROUP BY l_orderkey""",
    "set_union": f"WITH {_KEPT} SELECT l.* FROM l UNION ALL SELECT r.* FROM r ANTI JOIN l USING (package_id, k)",
    "set_intersection": f"WITH {_KEPT} SELECT l.* FROM l SEMI JOIN r USING (package_id, k)",
    "set_difference": f"WITH {_KEPT} SELECT l.* FROM l ANTI JOIN r USING (package_id, k)",
    "set_symmetric_difference": f"WITH {_KEPT} SELECT l.* FROM l ANTI JOIN r USING (package_id, k) UNION ALL SELECT r.* FROM r ANTI JOIN l USING (package_id, k)",
    "set_relation": """WITH a AS (SELECT DISTINCT s_nationkey AS n FROM supplier WHERE s_nationkey < 12), b AS (SELECT DISTINCT c_nationkey AS n FROM customer),
        c AS (SELECT (SELECT count(*) FROM a ANTI JOIN b USING (n)) AS l, (SELECT count(*) FROM b ANTI JOIN a USING (n)) AS r, (SELECT count(*) FROM a SEMI JOIN b USING (n)) AS m)
        SELECT l = 0 AND r = 0 AS equal, l = 0 AS subset, l = 0 AND r > 0 AS proper_subset, r = 0 AS superset, r = 0 AND l > 0 AS proper_superset, m = 0 AS disjoint FROM c""",
    "list_slice": """WITH o AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS p, count(*) OVER () AS n FROM orders)
        SELECT o_orderkey, o_totalprice, (n - 5 - p) // 3 AS pos FROM o WHERE p <= n - 5 AND p > 10 AND (n - 5 - p) % 3 = 0""",
    "list_edits": """WITH p AS (SELECT p_partkey, p_name, row_number() OVER (ORDER BY p_partkey) - 1 AS i FROM part), m AS (SELECT n_nationkey::BIGINT AS p_partkey, n_name AS p_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS i FROM nation),
        a AS (SELECT p_partkey, p_name, CASE WHEN i < 10 THEN (0, i) ELSE (2, i) END AS o FROM p UNION ALL SELECT p_partkey, p_name, (1, i) FROM m),
        b AS (SELECT p_partkey, p_name, row_number() OVER (ORDER BY o) - 1 AS i, count(*) OVER () AS n FROM a),
        c AS (SELECT p_partkey, CASE WHEN i = n - 1 THEN 'last' ELSE p_name END AS p_name, i FROM b WHERE i <> 3),
        d AS (SELECT p_partkey, p_name, (0, i) AS o FROM c UNION ALL SELECT p_partkey, p_name, (1, i) FROM m)
        SELECT p_partkey, p_name, row_number() OVER (ORDER BY o DESC) - 1 AS pos FROM d""",
    "list_count": "SELECT event_type, user_id, count(*) AS n_equal FROM events GROUP BY ALL",
    "prune_dangling": f"WITH {_EDGES}, k AS (SELECT node_id FROM course_nodes UNION SELECT node_id FROM concept_registry) SELECT edge_id, source, target FROM edges WHERE source IN (SELECT node_id FROM k) AND target IN (SELECT node_id FROM k)",
    "prune_hyper": f"WITH {_HYPER}, k AS (SELECT list(p_partkey) AS ks FROM part WHERE p_size > 5) SELECT l_orderkey, len(members) AS n_members, array_to_string(members, ',') AS members FROM h WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5))",
    "hyper_incidence": f"WITH {_HYPER} SELECT l_orderkey, unnest(members) AS member, generate_subscripts(members, 1) - 1 AS place FROM h",
    "graph_undirected": f"WITH {_EDGES} SELECT least(source, target) AS source, greatest(source, target) AS target, max(edge_id) AS edge_id, arg_max(weight, edge_id) AS weight FROM edges WHERE source <> target GROUP BY 1, 2",
    "graph_degrees": f"""WITH {_EDGES} SELECT node, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM (SELECT source AS node, 1 AS o, 0 AS i FROM edges UNION ALL SELECT target, 0, 1 FROM edges) WHERE node IS NOT NULL GROUP BY node""",
    "graph_components": f"WITH RECURSIVE {_ENDS}, {_LABELS.format(v='v', b='both_ways')} SELECT id, label AS component FROM cc",
    "graph_reports": f"""WITH RECURSIVE {_ENDS}, {_LABELS.format(v="v", b="both_ways")}, x AS (SELECT c.label, src || ' -> ' || dst AS line FROM (SELECT DISTINCT src, dst FROM e WHERE dst IS NOT NULL) e JOIN cc c ON c.id = e.src)
        SELECT c.label AS component, count(*) AS n_members, array_to_string(list(c.id ORDER BY c.id)[1:10], ', ') AS members, coalesce(any_value(y.n), 0) AS n_relations, coalesce(any_value(y.relations), '') AS relations
        FROM cc c LEFT JOIN (SELECT label, count(*) AS n, array_to_string(list(line ORDER BY line)[1:10], chr(10)) AS relations FROM x GROUP BY 1) y ON y.label = c.label GROUP BY c.label""",
    "graph_impact": f"""WITH RECURSIVE {_ENDS}, w AS (SELECT t || id AS id FROM v, (VALUES ('k'), ('a')) AS t(t)), both_sides AS (SELECT 'a' || src AS src, 'a' || dst AS dst FROM both_ways
          UNION SELECT 'k' || src, 'k' || dst FROM (SELECT src, dst FROM e WHERE NOT out AND src IS NOT NULL AND dst IS NOT NULL UNION SELECT dst, src FROM e WHERE NOT out AND src IS NOT NULL AND dst IS NOT NULL)), {_LABELS.format(v="w", b="both_sides")},
        i AS (SELECT count(DISTINCT src) AS n FROM both_ways WHERE src NOT IN (SELECT src FROM e WHERE NOT out AND src IS NOT NULL AND dst IS NOT NULL) AND src NOT IN (SELECT dst FROM e WHERE NOT out AND src IS NOT NULL AND dst IS NOT NULL))
        SELECT count(DISTINCT label) FILTER (WHERE id LIKE 'k%') AS components_kept, count(DISTINCT label) FILTER (WHERE id LIKE 'a%') AS components_all, (SELECT n FROM i) AS newly_isolated FROM cc""",
    "graph_induced": f"WITH {_EDGES}, g AS (SELECT node_id, min(package_id) AS grp FROM course_nodes GROUP BY 1) SELECT e.edge_id, e.source, e.target, a.grp FROM edges e JOIN g a ON a.node_id = e.source JOIN g b ON b.node_id = e.target AND a.grp = b.grp",
    "graph_relabel": f"""WITH {_EDGES}, o AS (SELECT DISTINCT unnest([source, target]) AS old FROM edges), m AS (SELECT old, min(old) OVER (PARTITION BY lower(trim(old))) AS new FROM o WHERE old IS NOT NULL)
        SELECT e.edge_id, coalesce(a.new, e.source) AS source, coalesce(b.new, e.target) AS target FROM edges e LEFT JOIN m a ON a.old = e.source LEFT JOIN m b ON b.old = e.target""",
    "graph_ancestors": _TREE + """, paths(pkg, nid, top) AS (
           SELECT pkg, nid, nid FROM status WHERE status = 'ok' AND parent IS NULL
           UNION ALL SELECT s.pkg, s.nid, CASE WHEN (SELECT parent FROM cur c WHERE c.pkg = s.pkg AND c.nid = p.nid) IS NULL THEN s.nid ELSE p.top END
           FROM paths p JOIN status s ON s.pkg = p.pkg AND s.parent = p.nid WHERE s.status = 'ok') SELECT pkg, nid, top AS top_level FROM paths""",
    "graph_v1": f"""WITH {_NODES}, o AS (SELECT {_clean('package_id')} AS pkg, {_clean('id')} AS id, 'outline' AS kind, arg_max(struct_pack(p := {_clean('parent_id')}), updated_at).p AS held_by,
          arg_max(title, updated_at) AS name, arg_max(struct_pack(d := deleted_at), updated_at).d AS gone FROM outlines GROUP BY 1, 2)
        SELECT pkg, id, kind, held_by, name FROM o WHERE gone IS NULL UNION ALL
        SELECT lower(trim(package_id)), 'kp-' || left(sha1(k), 16), 'knowledge', arg_min(struct_pack(p := lower(trim(parent_outline_id))), record_id).p, arg_min(node_name, record_id) FROM nodes WHERE deleted_at IS NULL AND k <> '' GROUP BY 1, 2""",
    "gate_nodes": f"""WITH {_NODES}, {_OUTLINES}, j AS (SELECT n.record_id, n.package_id, n.k, CASE
          WHEN coalesce(len(trim(evidence)), 0) < 20 THEN 'missing_evidence' WHEN coalesce(len(trim(parent_outline_id)), 0) = 0 THEN 'missing_parent_outline'
          WHEN NOT EXISTS (SELECT 1 FROM cur c WHERE c.scope = n.package_id AND c.outline_id = lower(trim(n.parent_outline_id))) THEN 'unknown_outline'
          WHEN len(trim(node_name)) > 40 THEN 'name_too_long' WHEN coalesce(len(trim(summary)), 0) = 0 THEN 'missing_summary' END AS reason FROM nodes n)
        SELECT record_id, CASE WHEN reason IS NOT NULL THEN reason WHEN row_number() OVER (PARTITION BY package_id, k, reason IS NULL ORDER BY record_id) > 1 THEN 'duplicate_node' ELSE 'accepted' END AS reason FROM j""",
    "repair_parents": f"""WITH {_NODES}, {_OUTLINES}, t AS (SELECT scope, min(title) AS t FROM cur GROUP BY 1),
        one AS (SELECT scope, regexp_replace(lower(regexp_replace(title, '^\\s*\\d+(\\.\\d+)*\\s*', '')), '[^0-9a-z㐀-鿿]+', '', 'g') AS key, min(outline_id) AS only_one FROM cur GROUP BY 1, 2 HAVING count(*) = 1 AND key <> '')
        SELECT n.record_id, coalesce(o.only_one, lower(trim(n.parent_outline_id))) AS parent_outline_id FROM nodes n LEFT JOIN t ON t.scope = n.package_id
        LEFT JOIN one o ON o.scope = n.package_id AND o.key = regexp_replace(lower(CASE WHEN n.record_id % 4 = 0 THEN coalesce(t.t, n.node_name) ELSE n.node_name END), '[^0-9a-z㐀-鿿]+', '', 'g')""",
    "gate_edges": f"""WITH {_EDGES}, k AS (SELECT DISTINCT node_id FROM course_nodes), j AS (SELECT edge_id, edge_type, confidence,
          CASE WHEN edge_type IN ('related', 'confusable') THEN least(source, target) ELSE source END AS s, CASE WHEN edge_type IN ('related', 'confusable') THEN greatest(source, target) ELSE target END AS t,
          CASE WHEN source IS NULL OR target IS NULL OR source NOT IN (SELECT node_id FROM k) OR target NOT IN (SELECT node_id FROM k) THEN 'unknown_endpoint' WHEN source = target THEN 'self_loop'
               WHEN coalesce(len(trim(description)), 0) = 0 THEN 'missing_relation_evidence' END AS reason FROM edges),
        b AS (SELECT s, t, edge_type, arg_max(edge_id, (coalesce(confidence, -1), -edge_id)) AS best FROM j WHERE reason IS NULL GROUP BY ALL)
        SELECT j.edge_id, CASE WHEN reason IS NOT NULL THEN reason WHEN j.edge_id <> b.best THEN 'duplicate_edge'
          WHEN j.edge_type = 'related' AND EXISTS (SELECT 1 FROM b x WHERE x.edge_type <> 'related' AND least(x.s, x.t) = least(j.s, j.t) AND greatest(x.s, x.t) = greatest(j.s, j.t)) THEN 'weaker_relation_conflict' ELSE 'accepted' END AS reason
        FROM j LEFT JOIN b ON b.s = j.s AND b.t = j.t AND b.edge_type = j.edge_type""",
    "quality_coverage": _TREE + """, d AS (SELECT DISTINCT lower(trim(package_id)) AS pkg, lower(trim(parent_outline_id)) AS nid FROM course_nodes),
        h AS (SELECT pkg, nid FROM d UNION SELECT u.pkg, u.anc FROM up u JOIN d ON d.pkg = u.pkg AND d.nid = u.nid JOIN status s ON s.pkg = u.pkg AND s.nid = u.nid AND s.status = 'ok')
        SELECT s.pkg, count(*) AS sections, count(d.nid) AS direct, count(CASE WHEN s.status = 'ok' THEN h.nid END) AS hierarchical, round(count(CASE WHEN s.status = 'ok' THEN h.nid END) / count(*), 4) AS coverage
        FROM status s LEFT JOIN d ON d.pkg = s.pkg AND d.nid = s.nid LEFT JOIN h ON h.pkg = s.pkg AND h.nid = s.nid GROUP BY s.pkg""",
    "quality_agreement": """WITH p AS (SELECT a.l_returnflag = b.l_returnflag AS same FROM (SELECT *, row_number() OVER () AS i FROM lineitem) a JOIN (SELECT *, row_number() OVER () AS i FROM lineitem) b ON a.l_partkey = b.l_partkey AND a.i < b.i)
        SELECT count(*) FILTER (WHERE same) AS equal, count(*) AS compared, round(count(*) FILTER (WHERE same) / count(*), 6) AS agreement FROM p""",
    "quality_quarantine": f"""WITH {_NODES} SELECT record_id, concat_ws(',', CASE WHEN coalesce(confidence BETWEEN 0 AND 1, false) THEN NULL ELSE 'confidence' END,
        CASE WHEN coalesce(len(trim(node_name)) > 0, false) THEN NULL ELSE 'name' END, CASE WHEN summary IS NOT NULL THEN NULL ELSE 'summary' END, CASE WHEN coalesce(len(source_refs) > 0, false) THEN NULL ELSE 'refs' END) AS violations
        FROM nodes WHERE violations <> ''""",
    "usage_rollup": """WITH e AS (SELECT event_type, event_type = 'error' AS is_error, value::DECIMAL(18, 2) AS v, 'm' || (user_id % 4) AS mode FROM events)
        SELECT CASE WHEN grouping(event_type) = 0 THEN 'event_type' WHEN grouping(mode) = 0 THEN 'mode' ELSE 'total' END AS dimension, coalesce(event_type, mode) AS value,
        count(*) AS calls, sum(is_error::INT)::BIGINT AS failed, sum(v)::DOUBLE AS amount FROM e GROUP BY GROUPING SETS ((), (event_type), (mode))""",
    "latest_per_key": "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id",
    "chunk_halving": f"""WITH b AS (SELECT DISTINCT ON (block_id) block_id, text, {_PARTS} AS parts FROM source_blocks),
        c AS (SELECT block_id || '-a' AS block_id, array_to_string(parts[1:len(parts) // 2], chr(10) || chr(10)) AS t FROM b WHERE len(parts) > 1
        UNION ALL SELECT block_id || '-b', array_to_string(parts[len(parts) // 2 + 1:], chr(10) || chr(10)) FROM b WHERE len(parts) > 1 UNION ALL SELECT block_id::VARCHAR, text FROM b WHERE len(parts) < 2)
        SELECT block_id, md5(t) AS digest, len(t) AS n_chars FROM c""",
    "chunk_table_text": "SELECT n_regionkey AS t, string_agg(n_name || ' | ' || n_nationkey, chr(10) ORDER BY n_nationkey) AS table_text FROM nation GROUP BY 1",
    "chunk_facts": f"""WITH RECURSIVE {_NODES}, o AS (SELECT package_id, evidence, row_number() OVER (PARTITION BY package_id ORDER BY record_id) AS r FROM nodes WHERE evidence IS NOT NULL),
        fold(package_id, r, pack_no, i, total) AS (SELECT package_id, r, 0, 1, len(evidence) + 12 FROM o WHERE r = 1
          UNION ALL SELECT f.package_id, o.r, CASE WHEN f.total + len(o.evidence) + 12 > 2048 OR f.i >= 10 THEN f.pack_no + 1 ELSE f.pack_no END, CASE WHEN f.total + len(o.evidence) + 12 > 2048 OR f.i >= 10 THEN 1 ELSE f.i + 1 END,
            CASE WHEN f.total + len(o.evidence) + 12 > 2048 OR f.i >= 10 THEN 0 ELSE f.total END + len(o.evidence) + 12 FROM fold f JOIN o ON o.package_id = f.package_id AND o.r = f.r + 1)
        SELECT f.package_id, f.pack_no::BIGINT AS pack_no, string_agg('[Fact ' || f.i || ']: ' || o.evidence, chr(10) ORDER BY f.i) AS pack_text FROM fold f JOIN o ON o.package_id = f.package_id AND o.r = f.r GROUP BY 1, 2""",
    "chunk_batches": """WITH RECURSIVE o AS (SELECT *, coalesce(collection_id, '') AS c, row_number() OVER (PARTITION BY collection_id ORDER BY doc_id) AS r FROM documents),
        fold(c, r, no, i, total) AS (SELECT c, r, 0, 1, n_chars FROM o WHERE r = 1
          UNION ALL SELECT f.c, o.r, CASE WHEN f.i >= 16 OR f.total + o.n_chars > 20000 THEN f.no + 1 ELSE f.no END, CASE WHEN f.i >= 16 OR f.total + o.n_chars > 20000 THEN 1 ELSE f.i + 1 END,
            CASE WHEN f.i >= 16 OR f.total + o.n_chars > 20000 THEN 0 ELSE f.total END + o.n_chars FROM fold f JOIN o ON o.c = f.c AND o.r = f.r + 1)
        SELECT o.collection_id, o.doc_id, o.n_chars, f.no::BIGINT AS batch_no FROM fold f JOIN o ON o.c = f.c AND o.r = f.r""",
    "quality_evaluation": f"""WITH {_NODES}, n AS (SELECT *, package_id || ' ' || CASE WHEN k <> '' THEN k ELSE upper(hex(encode(lower(trim(coalesce(node_name, '')))))) END AS full0 FROM nodes),
        m AS (SELECT *, regexp_replace(lower(full0), '[^0-9a-z㐀-鿿]+', '', 'g') AS key FROM n), g AS (SELECT key, min(record_id) AS gold_id, arg_min(struct_pack(o := parent_outline_id), record_id).o AS w FROM m GROUP BY 1),
        a AS (SELECT gold_id, key FROM g UNION SELECT g.gold_id, regexp_replace(lower(x.package_id || ' ' || CASE WHEN regexp_replace(lower(x.a), '[^0-9a-z㐀-鿿]+', '', 'g') <> '' THEN regexp_replace(lower(x.a), '[^0-9a-z㐀-鿿]+', '', 'g') ELSE upper(hex(encode(lower(trim(x.a))))) END), '[^0-9a-z㐀-鿿]+', '', 'g')
          FROM (SELECT key, package_id, unnest(aliases) AS a FROM m) x JOIN g USING (key) WHERE len(trim(x.a)) > 0),
        c AS (SELECT m.record_id, m.key, g.gold_id, CASE g.gold_id % 3 WHEN 0 THEN 'required' WHEN 1 THEN 'acceptable' WHEN 2 THEN 'forbidden' END AS label, coalesce(g.gold_id % 3 <> 2 AND g.w IS NOT DISTINCT FROM m.parent_outline_id, false) AS placed
          FROM m LEFT JOIN a ON a.key = m.key LEFT JOIN g ON g.gold_id = a.gold_id),
        b AS (SELECT record_id, any_value(key) AS key, arg_min(struct_pack(g := gold_id, l := label, p := placed), (NOT placed, gold_id)) AS x FROM c GROUP BY 1),
        t AS (SELECT count(*) AS predicted, count(*) FILTER (WHERE x.l IN ('required', 'acceptable')) AS positive, count(*) FILTER (WHERE x.l = 'forbidden') AS leaks, count(DISTINCT x.g) FILTER (WHERE x.l = 'required') AS r, count(DISTINCT x.g) FILTER (WHERE x.l IN ('required', 'acceptable')) AS p,
          count(DISTINCT x.g) FILTER (WHERE x.p) AS w, count(DISTINCT key) AS names FROM b)
        SELECT predicted, round(r / (SELECT count(*) FROM g WHERE gold_id % 3 = 0), 6) AS recall, round(positive / predicted, 6) AS precision, round(w / p, 6) AS placement, round(leaks / predicted, 6) AS leakage, round((predicted - names) / predicted, 6) AS duplicates FROM t""",
    "ref_hydration": f"""WITH {_NODES}, r AS (SELECT record_id, unnest(source_refs) AS ref, generate_subscripts(source_refs, 1) - 1 AS place FROM nodes)
        SELECT record_id, place, regexp_extract(ref, '^(.*)#L(\\d+)-L(\\d+)$', 1) AS path, try_cast(regexp_extract(ref, '^(.*)#L(\\d+)-L(\\d+)$', 2) AS INT) AS start_line, try_cast(regexp_extract(ref, '^(.*)#L(\\d+)-L(\\d+)$', 3) AS INT) AS end_line FROM r WHERE trim(ref) <> ''""",
    "search_one": "SELECT e.vec_id, round(list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 5) AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), e.vec_id LIMIT 10",
    "search_batch": """SELECT query, rank::INT AS rank, vec_id, round(d, 5) AS distance FROM (SELECT q.vec_id AS query, e.vec_id, list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS d,
        row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), e.vec_id) AS rank FROM embeddings q JOIN embeddings e ON q.vec_id % 20 = 0 AND e.vec_id <> q.vec_id) WHERE rank <= 5""",
    "similar_batch": """SELECT q.vec_id AS query, e.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 5) AS similarity
        FROM embeddings q JOIN embeddings e ON q.vec_id % 20 = 0 AND e.vec_id <> q.vec_id WHERE list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) >= 0.75""",
    "vector_mean": "WITH x AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS place FROM embeddings) SELECT label, place, round(avg(x::DOUBLE), 5) AS x FROM x GROUP BY ALL",
    "search_context": "SELECT string_agg('{\"o_orderkey\":' || o_orderkey || ',\"o_custkey\":' || o_custkey || '}', chr(10) || '---' || chr(10) ORDER BY o_orderkey) AS context FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 3)",
}
