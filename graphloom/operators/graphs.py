"""Graphs and hypergraphs as DataFrames: pruning, subgraphs, components, communities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.lookup import known_hot, lookup_inner
from graphloom.session import cut_lineage


def prune_edges(edges: DataFrame, keys: DataFrame, key: str, source: str = "source", target: str = "target") -> DataFrame:
    """Edges both of whose ends are among keys; null ends are in none.

    keys is made distinct, so each end is a lookup of many rows in one row per key; hot ends, such as
    a node that a tenth of all edges points to, are counted first and spread by salts.
    """
    known = keys.select(key).filter(F.col(key).isNotNull()).distinct()
    for end in (source, target):
        edges = lookup_inner(edges, known.withColumnRenamed(key, end), [end], known_hot(edges, [end])).select(*edges.columns)
    return edges


def incidence(hyperedges: DataFrame, edge_id: str, members: str) -> DataFrame:
    """(edge_id, member, place) of every member of every hyperedge."""
    return hyperedges.select(edge_id, F.posexplode(members).alias("place", "member"))


def prune_hyperedges(hyperedges: DataFrame, keys: DataFrame, key: str, edge_id: str, members: str) -> DataFrame:
    """Hyperedges with at least one member and no unknown one; a null member is unknown."""
    inside = incidence(hyperedges, edge_id, members).select(edge_id, "member")
    known = keys.select(F.col(key).alias("member")).filter("member is not null").distinct()
    found = lookup_inner(inside, known, ["member"]).groupBy(edge_id).agg(F.count(F.lit(1)).alias("_n"))
    kept = hyperedges.join(found, edge_id)
    return kept.filter(F.col("_n") == F.size(members)).select(*hyperedges.columns)


def merge_parallel(edges: DataFrame, seq: str, source: str = "source", target: str = "target") -> DataFrame:
    """Undirected edges, one per pair of ends: of parallel ones the last by seq. Loops and null ends go."""
    a, b = F.least(source, target), F.greatest(source, target)
    rest = [c for c in edges.columns if c not in (source, target)]
    turned = edges.filter(F.col(source) != F.col(target)).withColumns({"_a": a, "_b": b})
    last = turned.groupBy("_a", "_b").agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_e"))
    return last.select(F.col("_a").alias(source), F.col("_b").alias(target), "_e.*")


def degrees(edges: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """(node, out_degree, in_degree) of every node with an edge; pre-aggregated per side."""
    out = edges.groupBy(F.col(source).alias("node")).agg(F.count(F.lit(1)).alias("out_degree"), F.lit(0).cast("bigint").alias("in_degree"))
    in_ = edges.groupBy(F.col(target).alias("node")).agg(F.lit(0).cast("bigint").alias("out_degree"), F.count(F.lit(1)).alias("in_degree"))
    both = out.unionByName(in_).filter("node is not null")
    return both.groupBy("node").agg(F.sum("out_degree").alias("out_degree"), F.sum("in_degree").alias("in_degree"))


def induced_subgraphs(membership: DataFrame, edges: DataFrame, node: str, group: str, source: str = "source", target: str = "target") -> DataFrame:
    """Edges with both ends in one group, with that group. membership has one row per node."""
    a = membership.select(F.col(node).alias(source), F.col(group).alias("_g1"))
    b = membership.select(F.col(node).alias(target), F.col(group).alias("_g2"))
    both = lookup_inner(lookup_inner(edges, a, [source]), b, [target])
    return both.filter(F.col("_g1") == F.col("_g2")).withColumnRenamed("_g1", group).drop("_g2")


def connected_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that can be reached from each id of vertices.

    edges has src and dst; null ends link nothing, ends that aren't vertices link like others. Each
    round takes the least label of all neighbours, then that label's own label, so a chain of n links
    needs about log n rounds; rounds are cut by reliable checkpoints. Nothing is gathered anywhere: a
    node with very many links is a pre-aggregated minimum.
    """
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    both = cut_lineage(both.filter(F.col("src") != F.col("dst")).distinct())
    labels = cut_lineage(both.groupBy(F.col("src").alias("id")).agg(F.least(F.min("dst"), F.col("src")).alias("label")))
    hot = known_hot(both, ["dst"])
    while True:
        near = lookup_inner(both, labels.withColumnsRenamed({"id": "dst"}), ["dst"], hot)
        near = near.groupBy(F.col("src").alias("id")).agg(F.min("label").alias("near"))
        step = labels.join(near, "id").select("id", "label", F.least("label", "near").alias("to"))
        jump = labels.select(F.col("id").alias("to"), F.col("label").alias("further"))
        following = cut_lineage(lookup_inner(step, jump, ["to"]).select("id", F.least("to", "further").alias("label"), F.col("label").alias("was")))
        if not following.filter("label <> was").take(1):
            break
        labels = following.select("id", "label")
    return vertices.select("id").join(labels, "id", "left").select("id", F.coalesce("label", "id").alias("component"))


def _propagate(edges: DataFrame, least_gain: float) -> DataFrame:
    """(id, label) by label propagation over weighted undirected edges (src, dst, weight), both ways.

    Rounds go on as long as each brings more than least_gain of the whole weight inside labels, which has
    to end; the labels before the first that doesn't are the result.
    """
    labels = cut_lineage(edges.select(F.col("src").alias("id")).distinct().withColumn("label", F.col("id")))
    inside, hot = -1.0, known_hot(edges, ["dst"])
    total = edges.agg(F.coalesce(F.sum("weight"), F.lit(0.0))).first()[0]
    before = labels
    while True:
        votes = lookup_inner(edges, labels.withColumnRenamed("id", "dst"), ["dst"], hot).groupBy("src", "label").agg(F.sum("weight").alias("w"))
        # a node's own label counts half a link, which ends two nodes' endless exchange of labels
        own = labels.select(F.col("id").alias("src"), "label", F.lit(0.0).alias("w"), F.lit(0.5).alias("o"))
        votes = votes.withColumn("o", F.lit(0.0)).unionByName(own).groupBy("src", "label").agg(F.sum("w").alias("w"), F.sum("o").alias("o"))
        best = F.min_by("label", F.struct(-(F.col("w") + F.col("o")), "label"))
        following = cut_lineage(votes.groupBy(F.col("src").alias("id")).agg(best.alias("label"), F.max(F.when(F.col("o") > 0, F.col("w"))).alias("w")))
        same = following.agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0]
        if inside >= 0 and same <= inside + least_gain * total:
            return before
        inside, before, labels = same, labels, following.select("id", "label")


def communities(edges: DataFrame, levels: int = 2, max_size: int = 100, least_gain: float = 0.002) -> DataFrame:
    """(id, level, community): a hierarchy of communities over edges (src, dst, weight).

    Level 0 is label propagation over the whole graph, ties by the smaller label; each further level
    cuts the communities of more than max_size nodes by propagation over their own edges, and carries
    the others along. Community names are LEVEL_<level>_CID_<smallest member>. Nodes without an edge
    are in none. Propagation ends where a round gains no more than least_gain of the weight. The result
    is deterministic.
    """
    both = edges.filter(F.col("src") != F.col("dst")).select("src", "dst", "weight")
    both = both.unionByName(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    both = cut_lineage(both.groupBy("src", "dst").agg(F.sum("weight").alias("weight")))
    made, inside = [], both
    previous = None
    for level in range(levels):
        labels = _propagate(inside, least_gain)
        if previous is not None:
            # nodes whose links were all cut away keep their community as one of their own
            labels = previous.join(labels, "id", "left").select("id", F.coalesce("label", "_whole", "id").alias("label"))
        smallest = labels.groupBy("label").agg(F.min("id").alias("_least"), F.count(F.lit(1)).alias("_n"))
        sized = cut_lineage(labels.join(smallest, "label").select("id", "_least", "_n"))
        name = F.concat(F.lit(f"LEVEL_{level}_CID_"), F.col("_least").cast("string"))
        made.append(sized.select("id", F.lit(level).alias("level"), name.alias("community")))
        large = sized.filter(F.col("_n") > max_size)
        if level + 1 == levels or not large.take(1):
            break
        member = large.select("id", F.col("_least").alias("_c"))
        inside = cut_lineage(induced_subgraphs(member, both, "id", "_c", "src", "dst").select("src", "dst", "weight"))
        previous = sized.select("id", F.when(F.col("_n") <= max_size, F.col("_least")).alias("_whole"))
    out = made[0]
    for part in made[1:]:
        out = out.unionByName(part)
    return out


def modularity(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """One row: communities, weight and modularity of a partition of an undirected graph.

    edges: src, dst, weight; loops and edges with an end that membership (id, community; one row per id)
    doesn't have are left out. Without any weight modularity is 0.
    """
    a = membership.select(F.col("id").alias("src"), F.col("community").alias("_a"))
    b = membership.select(F.col("id").alias("dst"), F.col("community").alias("_b"))
    rows = lookup_inner(lookup_inner(edges.filter("src <> dst"), a, ["src"]), b, ["dst"])
    ends = F.explode(F.array(F.struct(F.col("_a").alias("c"), F.when(F.col("_a") == F.col("_b"), F.col("weight")).otherwise(0.0).alias("i")), F.struct(F.col("_b").alias("c"), F.lit(0.0).alias("i"))))
    each = rows.select(ends.alias("_e"), "weight").groupBy("_e.c").agg(F.sum("weight").alias("k"), F.sum("_e.i").alias("i"))
    # with m the whole weight: the sum over communities of i / m - (k / 2m)^2
    out = each.agg(F.count(F.lit(1)).alias("communities"), (F.coalesce(F.sum("k"), F.lit(0.0)) / 2).alias("weight"), F.sum("i").alias("_i"), F.sum(F.col("k") * F.col("k")).alias("_k2"))
    value = F.try_divide("_i", F.col("weight")) - F.try_divide(F.col("_k2"), 4 * F.col("weight") * F.col("weight"))
    return out.select("communities", "weight", F.coalesce(F.round(value, 6), F.lit(0.0)).alias("modularity"))


def _first_names(rows: DataFrame, group: str, first: int) -> DataFrame:
    """(group, _n, _some): number of the names _m of each group and its first ones, which are kept while
    aggregating, so that a group of any size is a few names."""
    part = F.pmod(F.xxhash64("_m"), F.lit(64))
    window = Window.partitionBy(group, "_part").orderBy("_m")
    # a rank within a part of the group, whose first rows Spark keeps before the shuffle (WindowGroupLimit)
    top = rows.select(group, "_m", part.alias("_part")).withColumn("_r", F.row_number().over(window)).filter(F.col("_r") <= first)
    some = top.groupBy(group).agg(F.slice(F.array_sort(F.collect_list("_m")), 1, first).alias("_some"))
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).join(some, group)


def community_report(membership: DataFrame, group: str, node: str, first: int = 10, edges: DataFrame | None = None) -> DataFrame:
    """(group, n_members, members) and, with edges (src, dst) inside groups, (n_relations, relations): sizes
    and the first members and relations of each group in order, as the text of a report.

    membership has one row per node. Relations are distinct edges, listed as lines `src -> dst` under the
    group of their source.
    """
    names = _first_names(membership.select(group, F.col(node).cast("string").alias("_m")), group, first)
    out = names.select(group, F.col("_n").alias("n_members"), F.array_join("_some", ", ").alias("members"))
    if edges is None:
        return out
    where = membership.select(F.col(node).alias("src"), group)
    lines = lookup_inner(edges.select("src", "dst").distinct(), where, ["src"]).select(group, F.concat("src", F.lit(" -> "), "dst").alias("_m"))
    told = _first_names(lines, group, first).select(group, F.col("_n").alias("n_relations"), F.array_join("_some", "\n").alias("relations"))
    return out.join(told, group, "left").fillna({"n_relations": 0, "relations": ""})


def connectivity_impact(nodes: DataFrame, kept: DataFrame, rejected: DataFrame) -> DataFrame:
    """One row: components with the kept edges and with the rejected ones as well, and the nodes that
    are isolated only because edges were rejected. nodes: id (strings, one row each); edges: src, dst.

    Both graphs are labelled in one run, side by side under ids of their own.
    """
    everything = kept.select("src", "dst").unionByName(rejected.select("src", "dst"))
    own = lambda side, c: F.concat(F.lit(side), c)
    sides = [(edges.select(own(side, F.col("src")).alias("src"), own(side, F.col("dst")).alias("dst"))) for side, edges in (("k", kept), ("a", everything))]
    vertices = nodes.select(F.explode(F.array(own("k", F.col("id")), own("a", F.col("id")))).alias("id"))
    labels = connected_components(vertices, sides[0].unionByName(sides[1])).select("component").distinct()
    ends = lambda edges: edges.filter("src <> dst").select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    isolated = ends(everything).join(ends(kept), "id", "left_anti").join(nodes, "id", "left_semi").select(F.lit("i").alias("component"))
    count = lambda side: F.count(F.when(F.left("component", F.lit(1)) == side, 1))
    return labels.unionByName(isolated).agg(count("k").alias("components_kept"), count("a").alias("components_all"), count("i").alias("newly_isolated"))


def relabel(rows: DataFrame, mapping: DataFrame, columns: list[str], old: str = "old", new: str = "new") -> DataFrame:
    """rows with names replaced by the mapping (one row per old name); other names, and nulls, stay."""
    for c in columns:
        m = mapping.select(F.col(old).alias(c), F.col(new).alias("_new"))
        hit = lookup_inner(rows, m, [c], known_hot(rows, [c])).withColumn(c, F.col("_new"))
        rows = hit.select(*rows.columns).unionByName(rows.join(m, c, "left_anti").select(*rows.columns))
    return rows
