import pytest
from pyspark.sql import functions as F

from graphloom.operators import course, evaluation, flows, graphs, lists, sets

EDGES = "scope string, source_id string, target_id string, edge_type string"


def test_kinds_and_types(spark):
    df = spark.createDataFrame([(" Skill ", 0), ("方法", 2), ("odd", 7), (None, None)], "kind string, depth int")
    got = df.select(course.knowledge_kind(F.col("kind")).alias("k"), course.outline_type(F.col("depth")).alias("t")).collect()
    assert [tuple(r) for r in got] == [("method", "book"), ("method", "section"), ("odd", "subsection"), (None, None)]


def test_validation_of_good_bad_and_empty_graphs(spark):
    o = spark.createDataFrame([("s", "r", None), ("s", "c", "r"), ("s", "x", "gone")], "scope string, id string, parent_id string")
    n = spark.createDataFrame([("s", "k1", "c", None, "run"), ("s", "k2", "c", "k9", "run"), ("s", "r", "nowhere", None, "other"), ("t", "k3", None, None, "run")], "scope string, id string, parent_outline_id string, parent_knowledge_id string, run_id string")
    e = spark.createDataFrame([("s", "k1", "k2", "related"), ("s", "k2", "k1", "related"), ("s", "k1", "k1", "derivative"), ("s", "k1", None, "derivative"), ("s", "k1", "zz", "derivative")], EDGES)
    got = {(r.scope, r.subject, r.violation) for r in course.validate_graph(o, n, course.structural_edges(o, n), e).collect()}
    assert got == {
        ("s", "r", "duplicate node id"), ("s", "x", "unknown parent"), ("s", "r", "unknown outline"), ("t", "k3", "unknown outline"), ("s", "k2", "unknown parent knowledge"), ("s", "k1", "run mismatch"), ("s", "k2", "run mismatch"),
        ("s", "gone>x:contains", "structural edge with an unknown end"), ("s", "nowhere>r:contains", "structural edge with an unknown end"),
        ("s", "k1>k2:related", "duplicate semantic edge"), ("s", "k1>k1:derivative", "semantic loop"), ("s", "k1>:derivative", "semantic edge with an unknown end"), ("s", "k1>zz:derivative", "semantic edge with an unknown end"),
    } - {("s", "k1", "run mismatch"), ("s", "k2", "run mismatch")} | {("s", r, "run mismatch") for r in ("k1", "k2") if "other" < "run"}
    assert course.validate_graph(o.limit(0), n.limit(0), course.structural_edges(o.limit(0), n.limit(0)), e.limit(0)).count() == 0


def test_rejections_count_once_and_by_the_last_row(spark):
    schema = "rejection_id string, request_id string, stage string, chunk_id string, schema_path string, raw_item string, action string, source string, target string, seq int, measure string"
    rows = [("a", "q", "s", "c", "p", "x", "failed", "n1", "n2", 1, "m"), ("a", "q", "s", "c", "p", "x", "quarantined", "n1", "n2", 2, "m"), (None, "q", "s", "c", "p", "x", None, None, None, 1, "m"), (None, "q", "s", "c", "p", "x", None, None, None, 1, "m"), ("", "q", "s", "d", "p", "y", "quarantined", None, "n2", 5, "m")]
    got = {(r.measure, r.subject): r.n for r in course.rejection_summary(spark.createDataFrame(rows, schema)).collect()}
    assert got == {("total", None): 3, ("action", "quarantined"): 2, ("action", "failed"): 1, ("request", "q"): 2, ("chunk", "c"): 1, ("chunk", "d"): 1, ("endpoint", "n1"): 1, ("endpoint", "n2"): 2}
    assert course.rejection_summary(spark.createDataFrame([], schema)).count() == 0


@pytest.mark.parametrize(
    "status, text, name, category",
    [(401, None, None, "authentication"), (429, "your balance is low", None, "quota.exhausted"), (429, "", None, "rate_limit.requests"), (529, "x", None, "rate_limit.capacity"), (503, "x", None, "transient"), (400, "maximum context", None, "context_window"), (400, None, None, "protocol"), (None, "x", "ReadTimeoutError", "transient"), (None, None, None, "unknown"), (404, "x", None, "unknown")],
)
def test_failure_classes(spark, status, text, name, category):
    df = spark.createDataFrame([(status, text, name)], "s int, t string, n string")
    assert df.select(course.classify_failure(F.col("s"), F.lit(None).cast("string"), F.col("t"), F.col("n")).alias("f")).first().f.category == category


def test_evaluation_prefers_own_sections_and_leaves_unlabelled_pairs_unscored(spark):
    p = spark.createDataFrame([("1", "a", "o1", True), ("2", "b", "o2", True), ("3", "c", "o1", False), ("4", "zz", None, True), ("5", None, None, False)], "id string, key string, outline_id string, evidenced boolean")
    g = spark.createDataFrame([(1, "required", "o9"), (2, "acceptable", "o1"), (3, "required", "o2"), (4, "forbidden", "o1")], "gold_id int, label string, outline_id string")
    names = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "c"), (4, "c"), (4, "")], "gold_id int, key string")
    e = spark.createDataFrame([("2", "1", "related"), ("1", "2", "derivative"), ("1", "3", "related"), ("1", "4", "related"), (None, "1", "related")], "source_id string, target_id string, edge_type string")
    r = spark.createDataFrame([(7, "required", 2, 3, "related"), (8, "required", 1, 3, "related"), (9, "forbidden", 2, 3, "derivative")], "rel_id int, label string, source int, target int, edge_type string")
    labels = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "gold_id int, label string")
    m = evaluation.evaluate_graph(p, e, g, names, r, labels).first()
    assert (m.required_recall, m.effective_precision, m.forbidden_leakage_rate, m.outline_accuracy, m.evidence_coverage) == (0.5, 0.4, 1.0, 1.0, 0.6)
    assert (m.relation_precision, m.relation_recall, m.matched_relations, m.unmatched_relations, m.unscored_relations, m.predicted_relations) == (0.5, 0.5, 1, 4, 0, 5)
    assert m.annotator_agreement == 1.0 and m.annotation_pairs == 1 and m.ambiguous == 0 and not m.passed and "required_recall" in m.failed_gates
    empty = evaluation.evaluate_graph(*[x.limit(0) for x in (p, e, g, names, r, labels)]).first()
    assert (empty.required_recall, empty.forbidden_leakage_rate, empty.predicted_nodes) == (1.0, 0.0, 0)


def test_small_ones(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("c", "d", 1.0), ("a", "a", 5.0), ("a", "zz", 1.0)], "src string, dst string, weight double")
    m = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2), ("d", 2)], "id string, community int")
    assert tuple(graphs.modularity(e, m).first()) == (2, 2.0, 0.5) and graphs.modularity(e.limit(0), m).first().modularity == 0.0
    s = spark.createDataFrame([(1, 5), (2, 6)], "k int, at int")
    turned = spark.createDataFrame([(2, 1), (1, 2)], "k int, at int")
    assert sets.equal_in_order(s, s, ["k"], "at").first().equal and not sets.equal_in_order(s, turned, ["k"], "at").first().equal and sets.equal_in_order(s.limit(0), s.limit(0), ["k"], "at").first().equal
    assert {tuple(r) for r in sets.layers([s, spark.createDataFrame([(1, 0), (9, 9)], "k int, at int")], "k", "at").collect()} == {(1, 5), (2, 6), (9, 9)}
    assert lists.numbered(spark.createDataFrame([("g", 2, "b"), ("g", 1, "a"), ("g", 3, None)], "g string, o int, t string"), ["g"], "o", "t").first().list == "1. a\n2. b"


def test_flows_of_odd_texts(spark):
    texts = spark.createDataFrame([(1, "Pressure moves pistons. Pressure moves nothing!\nLonely."), (2, None), (3, ""), (4, "没有 词。")], "doc long, text string")
    kg = flows.run("kg_gen", texts, "doc", "text")
    assert {r._key for r in kg.edges.collect()} == {"pressure|related|pistons", "pressure|related|nothing"} and {r.name for r in kg.nodes.collect()} == {"pressure", "pistons", "nothing", "lonely"}
    atom = flows.run("atom", texts, "doc", "text", "2024-05-05", most=1)
    assert {tuple(r.t_obs) for r in atom.edges.collect()} == {("2024-05-05",)} and {r.name for r in atom.nodes.collect()} == {"pressure", "pistons", "nothing"}
    layers = flows.run("cog_rag", texts, "doc", "text")
    assert [r.members for r in layers.themes.edges.collect()] == [["lonely", "nothing", "pistons", "pressure"]] and layers.details.edges.count() == 2
    indexed = flows.Layers(layers.themes.build_index(["name"], ["description"]), layers.details.build_index(["name"], ["description"]))
    context = flows.two_layer_context(indexed, "pressure")
    assert context.startswith("=== THEMES ===\n- Pressure moves pistons.") and "- pressure" in context
    assert flows.graph_context(kg.build_index(["name"], ["description"]), "pistons", 1, 1).startswith('## Nodes\n{"name":"pistons"}\n## Edges\n{')
    assert flows.run("hyper_rag", texts.limit(0), "doc", "text").edges.count() == 0
    reports = spark.createDataFrame([(c, c, i) for i, c in enumerate("abcd")], "title string, summary string, rating int")
    assert [r.title for r in flows.global_context(reports, "rating", "title", "summary").collect()] == ["d", "c", "b"]
    near = flows.match_nodes(flows.run("kg_gen", spark.createDataFrame([(1, "regulator regulators valvehead. valvehead controls regulators.")], "doc long, text string"), "doc", "text"), 0.8)
    assert {r.name for r in near.nodes.collect()} == {"regulator", "valvehead", "controls"} and {r._key for r in near.edges.collect()} == {"regulator|related|valvehead", "valvehead|related|controls", "controls|related|regulator"}
