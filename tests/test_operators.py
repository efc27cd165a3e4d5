import math

import pytest
from pyspark.sql import functions as F

from graphloom.functions import dates, ids, text, vectors
from graphloom.operators import chunks, extract, graphs, lists, merge, quality, search, sets


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'int'}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(column.alias("r")).first()["r"]


def test_scalar_functions(spark):
    assert one(spark, text.normal_name(F.col("a")), a="Élan Vital-3 标准") == "lanvital3标准"
    assert one(spark, text.normal_name(F.col("a")), a=None) is None
    assert one(spark, text.title_key(F.col("a")), a="1.2.3 Big Title") == "bigtitle"
    assert one(spark, text.file_stem(F.col("a")), a=' a/b: "c"... ') == "a b c"
    assert one(spark, text.file_stem(F.col("a")), a="...") == "untitled"
    assert one(spark, text.common_suffix_length(F.col("a"), F.col("b")), a="flow chart", b="pie chart") == 6
    assert one(spark, text.common_suffix_length(F.col("a"), F.col("b")), a="ab", b="cd") == 0
    assert one(spark, text.ngrams(F.col("a"), (2,)), a="abab") == ["ab", "ba"]
    assert one(spark, text.yaml_scalar(F.col("a")), a="yes") == '"yes"'
    assert one(spark, text.yaml_scalar(F.col("a")), a="plain words") == "plain words"
    assert one(spark, text.strip_thinking(F.col("a")), a="<think>x</think> y") == "y"
    assert one(spark, text.redact_secrets(F.col("a")), a="Bearer abcdefghijk password=hunter2") == "Bearer [REDACTED] password=[REDACTED]"
    assert one(spark, ids.key_template("{a}|{b}"), a="x", b=None) == "x|"
    assert one(spark, ids.key_template("{a}|{b}", "None"), a="x", b=None) == "x|None"
    assert one(spark, ids.edge_key(F.col("a"), F.col("b")), a="r", b=None) == "r"
    assert str(one(spark, dates.relative_date(F.col("a"), F.lit("2024-03-15").cast("date")), a="last week")) == "2024-03-04"
    assert one(spark, dates.percent(F.lit(5), F.lit(0))) is None
    assert ids.fingerprint({"b": 1, "a": [2]}) == ids.fingerprint({"a": [2], "b": 1})


@pytest.mark.parametrize(
    "given, value, state",
    [('x {"a": "}"} y', '{"a": "}"}', "ok"), ("```json\n[1]\n```", "[1]", "ok"), ('{"a": [1', None, "truncated"), ("no", None, "none"), ("{a}", None, "invalid"), (None, None, "none"), ('{"a": tru', None, "truncated"), ('[1, "it', None, "truncated"), ('{"a" 1}', None, "invalid"), ('<think>{</think>[{"b": -1.5e3}] {', '[{"b": -1.5e3}]', "ok"), ("[" * 9, None, "truncated")],
)
def test_first_json(given, value, state):
    assert text.first_json(given) == (value, state)


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0])], "a array<double>, b array<double>")
    assert [r.c for r in df.select(vectors.cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [0.0, 0.0, 0.0]
    assert math.isclose(df.select(vectors.distance(F.col("a"), F.col("b")).alias("d")).first().d, math.sqrt(5))
    assert vectors.hash_vector("abc") == vectors.hash_vector("abc")


SCHEMA = "k string, seq int, name string, n int, tags array<string>"


def test_merge_strategies_with_nulls_and_ties(spark):
    df = spark.createDataFrame([("a", 1, "x", 1, ["p"]), ("a", 2, None, 4, ["q", "p"]), ("a", 3, "y", None, None), (None, 1, "z", 2, []), ("b", 1, None, None, None)], SCHEMA)
    get = lambda s: {r.k: r for r in merge.keyed_merge(df, ["k"], ["seq"], s).collect()}
    assert get("keep_existing")["a"].name == "x" and get("keep_incoming")["a"].name == "y"
    field = get("merge_field")
    assert (field["a"].name, field["a"].n, field["a"].tags) == ("y", 4, ["p", "q", "p"]) and field[None].name == "z" and field["b"].tags == []
    rule = get("rule")
    assert (rule["a"].name, rule["a"].n, rule["a"].tags) == ("x", 3, ["p", "q"]) or rule["a"].n == 2
    assert merge.keyed_merge(df.limit(0), ["k"], ["seq"], "merge_field").count() == 0
    with pytest.raises(ValueError):
        merge.keyed_merge(df, ["k"], ["seq"], "other")
    own = merge.merge_by(df.filter("k is not null"), ["k"], ["seq"], lambda g: g.tail(1))
    assert {r.k: r.seq for r in own.collect()} == {"a": 3, "b": 1}


def test_best_edges_orders_undirected_ends(spark):
    e = spark.createDataFrame([(1, "b", "a", "related", 0.4), (2, "a", "b", "related", 0.9), (3, "b", "a", "part_of", None), (4, "b", "a", "part_of", None)], "id int, source string, target string, edge_type string, confidence double")
    assert rows(merge.best_edges(e, "id"), "id", "source", "target") == [(2, "a", "b"), (3, "b", "a")]


def test_sets(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "k string, v int")
    b = spark.createDataFrame([("y", 3), ("z", 4)], "k string, v int")
    assert rows(sets.union(a, b, ["k"]), "k", "v") == [("x", 1), ("y", 2), ("z", 4)]
    assert rows(sets.union(a, b, ["k"], "keep_incoming"), "k", "v") == [("x", 1), ("y", 3), ("z", 4)]
    assert rows(sets.symmetric_difference(a, b, ["k"]), "k") == [("x",), ("z",)]
    assert sets.relation(a, a, ["k"]).first().asDict() == {"equal": True, "subset": True, "proper_subset": False, "superset": True, "proper_superset": False, "disjoint": False}
    assert sets.relation(a.limit(0), b, ["k"]).first().disjoint
    first, rest = sets.pop(a, "v")
    assert first.first().k == "x" and rest.count() == 1


@pytest.mark.parametrize("cut", [(None, None, 1), (2, -1, 2), (-2, None, -3), (9, 1, -1), (50, 60, 1), (-99, 99, 4)])
def test_list_slices_like_python(spark, cut):
    items = lists.renumber(spark.range(10).withColumnRenamed("id", "v").repartition(3), [F.col("v")])
    got = [r.v for r in lists.slice_(items, *cut).orderBy("pos").collect()]
    assert got == list(range(10))[slice(*cut)]


def test_list_edits(spark):
    make = lambda *v: lists.renumber(spark.createDataFrame([(x,) for x in v], "v int").withColumn("o", F.monotonically_increasing_id()), [F.col("o")]).drop("o")
    values = lambda df: [r.v for r in df.orderBy("pos").collect()]
    items = make(5, 6, 5)
    assert values(lists.insert(items, 1, make(1, 2))) == [5, 1, 2, 6, 5]
    assert values(lists.insert(items, -99, make(1))) == [1, 5, 6, 5]
    assert values(lists.delete(items, -1)) == [5, 6]
    assert values(lists.remove(items, {"v": 5})) == [6, 5]
    assert lists.find(items, {"v": 7}) is None and lists.count(items, {"v": 5}) == 2
    assert values(lists.reverse(lists.concat(items, make(9)))) == [9, 5, 6, 5]
    assert lists.length(make(1).limit(0)) == 0
    with pytest.raises(IndexError):
        lists.delete(items, 3)
    with pytest.raises(ValueError):
        lists.remove(items, {"v": 7})


def test_pruning(spark):
    keys = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "name string")
    e = spark.createDataFrame([(1, "a", "b"), (2, "a", "x"), (3, None, "b")], "id int, source string, target string")
    assert rows(graphs.prune_edges(e, keys, "name"), "id") == [(1,)]
    h = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "x"]), (3, []), (4, ["a", None]), (5, ["b", "b"])], "id int, members array<string>")
    assert rows(graphs.prune_hyperedges(h, keys, "name", "id", "members"), "id") == [(1,), (5,)]


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(100, 140)] + [(1, i) for i in range(2, 40)] + [(7, 7), (None, 3)]
    e = spark.createDataFrame(chain, "src long, dst long")
    v = spark.createDataFrame([(i,) for i in [*range(1, 40), *range(100, 141), 999]], "id long")
    got = {r.id: r.component for r in graphs.connected_components(v, e).collect()}
    assert all(got[i] == 1 for i in range(1, 40)) and all(got[i] == 100 for i in range(100, 141)) and got[999] == 999
    assert {r.component for r in graphs.connected_components(v, e.limit(0)).collect()} == {r.id for r in v.collect()}


def test_communities_and_report(spark):
    two = [(a, b) for g in (0, 10) for a in range(g, g + 5) for b in range(a + 1, g + 5)] + [(4, 10)]
    e = spark.createDataFrame([(a, b, 1.0) for a, b in two], "src long, dst long, weight double")
    top = graphs.communities(e, levels=1).collect()
    assert {r.id: r.community for r in top} == {i: "LEVEL_0_CID_0" if i < 5 else "LEVEL_0_CID_10" for i in [*range(5), *range(10, 15)]}
    deeper = graphs.communities(e, levels=2, max_size=3).collect()
    assert {r.level for r in deeper} == {0, 1} and len(deeper) == 20
    report = graphs.community_report(spark.createDataFrame([(r.community, str(r.id)) for r in top], "c string, n string"), "c", "n", 2)
    assert rows(report, "c", "n_members", "members") == [("LEVEL_0_CID_0", 5, "0, 1"), ("LEVEL_0_CID_10", 5, "10, 11")]


def test_connectivity_impact(spark):
    v = spark.createDataFrame([(i,) for i in range(5)], "id long")
    kept = spark.createDataFrame([(0, 1)], "src long, dst long")
    cut = spark.createDataFrame([(1, 2), (3, 0)], "src long, dst long")
    assert tuple(graphs.connectivity_impact(v, kept, cut).first()) == (4, 2, 2)


def test_search_matches_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    data = [(i, rng.normal(size=6).tolist()) for i in range(60)] + [(60, None), (61, [1.0]), (62, [0.0] * 6)]
    df = spark.createDataFrame(data, "vid long, v array<double>").repartition(4)
    own = [(i, np.array(v)) for i, v in data if v and len(v) == 6]
    queries = df.filter("vid % 20 = 0 and vid < 60")
    got = search.search_many(queries, df, "vid", "v", 4, per_block=2).collect()
    for q in (0, 20, 40):
        expect = sorted((float(np.linalg.norm(own[q][1] - x)), i) for i, x in own if i != q)[:4]
        assert [r.vid for r in sorted(got, key=lambda r: r["rank"]) if r.query == q] == [i for _, i in expect]
    near = search.similar_many(queries, df, "vid", "v", 0.5, per_block=2).collect()
    cos = lambda a, b: float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)))
    assert {(r.query, r.vid) for r in near} == {(q, i) for q in (0, 20, 40) for i, x in own if i not in (q, 62) and cos(own[q][1], x) >= 0.5}
    assert search.search_many(queries.limit(0), df, "vid", "v", 4).count() == 0
    with pytest.raises(ValueError):
        search.search(df, "vid", "v", [0.0] * 6, 0)


def test_search_keeps_the_smallest_keys_of_many_equal_vectors(spark):
    data = [(0, [0.0, 0.0])] + [(i, [1.0, 0.5] if i % 3 else [2.0, 0.1 * i]) for i in range(3000, 0, -1)]
    df = spark.createDataFrame(data, "vid long, v array<double>").coalesce(1)
    got = search.search_many(df.filter("vid = 0"), df, "vid", "v", 5).collect()
    assert [r.vid for r in sorted(got, key=lambda r: r["rank"])] == [1, 2, 4, 5, 7]


@pytest.mark.parametrize("size, overlap", [(20, 5), (50, 0), (7, 3)])
def test_recursive_split_keeps_all_words_within_size(size, overlap):
    body = "One two three. Four five!\n\nSix seven eight nine ten.\nEleven。十二十三！ " * 5
    parts = chunks.recursive_split(body, size, overlap)
    assert all(0 < len(p) <= size for p in parts)
    at = 0
    for p in parts:
        at = body.find(p[:3], max(0, at - overlap - 1))
        assert at >= 0
    assert chunks.recursive_split("", 5) == [] and chunks.recursive_split("abc", 5) == ["abc"]


def test_split_oversized_keeps_text_within_limit():
    body = "甲乙丙丁。" * 30 + "\n\n" + "word " * 200
    parts = chunks.split_oversized(body, 40)
    assert all(chunks.estimate(p) <= 40 for p in parts)
    assert "".join("".join(parts).split()) == "".join(body.split())


def test_packing_respects_chapters_sections_and_limits(spark):
    b = [("d", f"c{i // 6}", i, f"b{i}", f"o{i // 2}", "x" * 40) for i in range(12)] + [("d", "c9", 99, "b99", "o9", "y" * 1000), ("d", "c9", 100, "b100", "o9", None)]
    df = spark.createDataFrame(b, "doc string, chapter string, block_no int, block_id string, outline_id string, text string").repartition(3)
    got = sorted(chunks.pack_blocks(df, 20, 35).collect(), key=lambda r: r.first_block_no)
    assert all(r.token_count <= 35 for r in got)
    assert [r.block_ids for r in got][:2] == [["b0", "b1"], ["b2", "b3"]] and [x for r in got[:6] for x in r.block_ids] == [f"b{i}" for i in range(12)]
    assert "".join(r.text for r in got if r.chapter == "c9") == "y" * 1000
    with pytest.raises(ValueError):
        chunks.pack_blocks(df, 5, 2)


def test_batches_facts_and_halves(spark):
    df = spark.createDataFrame([("d", i, n) for i, n in enumerate([5, 5, 5, 50, 1, None])], "doc string, i int, size int").repartition(3)
    got = {r.i: r.batch_no for r in chunks.batch_numbers(df, ["doc"], ["i"], "size", 2, 12).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 2, 4: 3, 5: 3}
    facts = spark.createDataFrame([("d", 1, "aa"), ("d", 2, "bb"), ("d", 3, None)], "doc string, i int, t string")
    assert [r.pack_text for r in chunks.pack_facts(facts, ["doc"], ["i"], "t").collect()] == ["[Fact 1]: aa\n[Fact 2]: bb"]
    halves = chunks.halve(spark.createDataFrame([("c", "a\n\nb\n\nc"), ("e", "one"), ("n", None)], "id string, t string"), "id", "t")
    assert rows(halves, "id", "t") == [("c-a", "a"), ("c-b", "b\n\nc"), ("e", "one"), ("n", None)]


def test_gates(spark):
    o = spark.createDataFrame([("s", "o1", "1 Heading"), ("s", "o2", "Other")], "scope string, outline_id string, title string")
    n = spark.createDataFrame(
        [(1, "s", "A", "evidence", "sum", "o1"), (2, "s", "a!", "evidence", "sum", "o1"), (3, "s", "B", " ", "sum", "o1"), (4, "s", "C", "e", "sum", None), (5, "s", "D", "e", "sum", "zz"), (6, "s", "E" * 99, "e", "s", "o1"), (7, "s", "F", "e", " ", "o2")],
        "id int, scope string, name string, evidence string, summary string, parent_outline_id string",
    )
    assert [r.reason for r in quality.gate_nodes(n, o, "id").orderBy("id").collect()] == [None, "duplicate_node", "missing_evidence", "missing_parent_outline", "unknown_outline", "name_too_long", "missing_summary"]
    assert quality.repair_parents(n.withColumn("name", F.when(F.col("id") == 7, "heading").otherwise(F.col("name"))), o).filter("id = 7").first().parent_outline_id == "o1"
    e = spark.createDataFrame(
        [(1, "s", "b", "a", "related", "d", 0.5), (2, "s", "a", "b", "related", "d", 0.7), (3, "s", "a", "b", "part_of", "d", None), (4, "s", "a", "a", "part_of", "d", 1.0), (5, "s", "a", "x", "part_of", "d", 1.0), (6, "s", "b", "c", "part_of", None, 1.0), (7, "s", "b", "c", "related", "d", 1.0), (8, "s", None, "c", "related", "d", 1.0)],
        "id int, scope string, source string, target string, edge_type string, description string, confidence double",
    )
    names = spark.createDataFrame([("s", x) for x in "abc"], "scope string, name string")
    assert {r.id: r.reason for r in quality.gate_edges(e, names, "id").collect()} == {
        1: "duplicate_edge", 2: "weaker_relation_conflict", 3: None, 4: "self_loop", 5: "unknown_endpoint", 6: "missing_relation_evidence", 7: None, 8: "unknown_endpoint"
    }


def test_evaluation_and_agreement(spark):
    gold = spark.createDataFrame([(1, "required", ["A", "alias a"], "o1"), (2, "required", ["B"], "o1"), (3, "forbidden", ["C"], "o1"), (4, "acceptable", ["D"], "o2")], "gold_id int, label string, names array<string>, outline_id string")
    seen = spark.createDataFrame([("Alias-A", "o1"), ("c", "o1"), ("d", "o1"), ("zz", "o1"), ("D", "o2")], "name string, outline_id string")
    r = quality.evaluate(seen, gold).first()
    assert (r.recall, r.precision, r.leakage, r.placement, r.duplicates) == (0.5, 0.6, 0.2, 1.0, 0.2)
    labels = spark.createDataFrame([("i", "x"), ("i", "x"), ("i", "y"), ("j", "x")], "item string, label string")
    assert tuple(quality.agreement(labels, "item", "label").first()) == (1, 3, 0.333333)
    assert tuple(quality.agreement(labels.limit(0), "item", "label").first()) == (0, 0, 0.0)


def test_quarantine_and_rollup_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (2, None, 3.0), (None, "a", None)], "value int, dimension string, x double")
    good, bad, summary = quality.quarantine(df, {"value": F.col("value") > 0, "x": F.col("x") < 3})
    assert good.count() == 1 and {tuple(r.violations) for r in bad.collect()} == {("x",), ("value", "x")}
    assert tuple(summary.first()) == (1, 2, 0.666667)
    out = quality.rollup(df, ["dimension"], {"n": F.count(F.lit(1)), "total": F.sum("x")})
    assert {(r.dimension, r.value): r.n for r in out.collect()} == {("dimension", "a"): 2, ("dimension", None): 1, ("total", None): 3}


def test_extraction_quarantines_failures(spark):
    def fails(text, context):
        if "bad" in text:
            raise ValueError("bad")
        return [{"name": text, "type": "t"}] if text else None

    df = spark.createDataFrame([(1, "x"), (2, "bad"), (3, ""), (4, None)], "doc int, text string")
    got = extract.extract(df, ["doc"], "text", fails, extract.NODE)
    assert rows(got, "doc", "name", "item_no") == [(1, "x", 0), (2, None, -1)]
    assert got.filter("doc = 2").first().error.startswith("ValueError")
    nodes, edges = extract.extract_graph(spark.createDataFrame([(1, "The Blue Whale meets the Red Fox. `krill` too.")], "doc int, text string"), ["doc"], "text", extract.TERMS)
    assert {r.name for r in nodes.collect()} == {"The Blue Whale", "Red Fox", "krill"} and edges.count() == 1
    assert {r.name for r in extract.nodes_of_edges(edges, ["doc"]).collect()} == {"The Blue Whale", "Red Fox"}


def test_parse_records(spark):
    df = spark.createDataFrame([('{"a": 1}',), ("[",), ("-",), ('{"z": 1}',), (None,)], "t string")
    assert [r.state for r in extract.parse_records(df, "t", "a int").collect()] == ["ok", "truncated", "none", "mismatch", "none"]
