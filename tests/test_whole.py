"""Queries over small tables, against brute force: every row of the tables counts."""

import pytest

from graphloom.plans import documents, knowledge

NODE = "record_id long, package_id string, run_id string, node_id string, node_name string, parent_outline_id string, summary string, aliases array<string>, created_at string, deleted_at string"
EDGE = "edge_id long, source string, target string, edge_type string, confidence double, status string"


def save(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def node(record_id, node_id, name="n", package="p", run="r1", at="2024-01-01", aliases=(), outline="o", summary="s", gone=None):
    return (record_id, package, run, node_id, name, outline, summary, list(aliases), at, gone)


@pytest.fixture(scope="module")
def graph(spark, tmp_path_factory):
    edges = [
        (1, "a", "b", "related", 0.9, "accepted"), (2, " B ", "c", "uses", 0.8, "accepted"), (3, "d", "e", "uses", None, "rejected"),
        (4, "x", "y", "uses", 0.1, "accepted"), (5, "a", None, "uses", 0.1, "accepted"), (6, "a", " ", "uses", 0.1, "accepted"),
    ]
    nodes = [node(i, n) for i, n in enumerate("abcdez")]
    return save(spark, tmp_path_factory.mktemp("graph"), course_edges=([*edges, edges[0]], EDGE), course_nodes=(nodes, NODE), concept_registry=([("x",), ("shared",)], "node_id string"))


def test_components_reports_and_communities_of_all_edges(spark, graph):
    expect = {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "x": "x", "y": "x", "z": "z", "shared": "shared"}
    assert {r.id: r.component for r in knowledge.graph_components(spark, graph).collect()} == expect
    assert {(r.component, r.n_members, r.members) for r in knowledge.graph_reports(spark, graph).collect()} == {("a", 3, "a, b, c"), ("d", 2, "d, e"), ("x", 2, "x, y"), ("z", 1, "z"), ("shared", 1, "shared")}
    assert {r.id for r in knowledge.graph_communities(spark, graph).collect()} == set("abcdexy")
    assert knowledge.graph_impact(spark, graph).first().components_all == 5


def test_notes_and_search_over_course_nodes_and_concepts(spark, tmp_path):
    nodes = [node(1, "kp-1", "Blood Culture"), node(2, " KP-1", "Later name", at="2024-02-01"), node(3, "kp-2", "Valve")]
    edges = [(1, "kp-1", "kp-2", "uses", 0.9, "accepted"), (2, "KP-2 ", "c-1", "needs", 0.9, "accepted"), (3, "kp-2", "lost", "uses", 0.9, "accepted")]
    shared = [("c-1", "Pump", "industry", "2023-01-01")]
    folder = save(spark, tmp_path, course_nodes=(nodes, NODE), course_edges=(edges, EDGE), concept_registry=(shared, "node_id string, node_name string, domain string, created_at string"))
    body = lambda i, domain, title, links: f"---\nnode_id: {i}\ndomain: {domain}\n---\n\n# {title}" + (f"\n\n## Relationships\n\n{links}" if links else "")
    got = {r.path: r.bytes for r in documents.vault_notes(spark, folder).collect()}
    assert set(got) == {"Blood Culture.md", "Valve.md", "Pump.md"}
    quoted = lambda x, quote: f"{quote}{x}{quote}"
    lengths = lambda i, domain, *rest: {len(body(quoted(i, q), domain if domain == "null" else quoted(domain, q), *rest)) for q in ("", '"')}
    assert got["Blood Culture.md"] in lengths("kp-1", "null", "Blood Culture", "- uses: [[Valve]]")
    assert got["Valve.md"] in lengths("kp-2", "null", "Valve", "- needs: [[Pump]]")
    assert got["Pump.md"] in lengths("c-1", "industry", "Pump", "")
    found = documents.set_search(spark, folder).collect()
    assert {r.node_id for r in found} == {"kp-1", "kp-2", "c-1"} and min(found, key=lambda r: r.distance).node_name == "Blood Culture"


def test_sets_and_evaluation_of_all_records(spark, tmp_path):
    gone = "2024-03-01"
    nodes = [node(1, "a", "Pump"), node(2, "b", "pump", gone=gone), node(3, "c", "Valve", gone=gone), node(9, "d", "Ёлка"), node(15, "e", "Tank", aliases=["Vessel", None, " "]), node(7, "f", "Vessel")]
    folder = save(spark, tmp_path, course_nodes=([*nodes, nodes[0]], NODE))
    names = lambda df: {r.node_name for r in df.collect()}
    assert names(knowledge.set_union(spark, folder)) == {"Pump", "Valve", "Ёлка", "Tank", "Vessel"}
    assert names(knowledge.set_intersection(spark, folder)) == {"Pump"}
    assert names(knowledge.set_difference(spark, folder)) == {"Ёлка", "Tank", "Vessel"}
    assert names(knowledge.set_symmetric_difference(spark, folder)) == {"Valve", "Ёлка", "Tank", "Vessel"}
    # required: 3 Valve, 9 Ёлка, 15 Tank; acceptable: 1 Pump, 7 Vessel, which is also an alias of 15, of smaller id 7
    r = knowledge.quality_evaluation(spark, folder).first()
    assert (r.recall, r.precision, r.placement, r.leakage, r.duplicates) == (1.0, 1.0, 1.0, 0.0, 0.166667)
