import itertools
import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from graphloom.operators import candidates, prompts


def ratio(a, b):
    return max(SequenceMatcher(None, a, b).ratio(), SequenceMatcher(None, b, a).ratio())


def test_similar_names_lose_no_link(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(3, 12))) for _ in range(25)]
    names = {("s", n) for n in base} | {("s", n[:i] + rng.choice("abxyz") + n[i + 1 :]) for n in base for i in (0, len(n) // 2)} | {("t", n) for n in base[:5]}
    df = spark.createDataFrame([*names, ("s", None), ("s", ""), ("s", base[0])], "scope string, name string")
    got = {(r.scope, r.name): r for r in candidates.similar_names(df).collect()}
    assert set(got) == names
    links = {(a, b) for a, b in itertools.permutations(names, 2) if a[0] == b[0] and ratio(a[1], b[1]) >= 0.82}
    for n in names:
        assert got[n].n_links == sum(a == n for a, _ in links), n
    label = {n: n for n in names}
    for _ in names:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    assert {n: got[n].class_name for n in names} == {n: label[n][1] for n in names}
    assert candidates.similar_names(df.limit(0)).count() == 0


def test_merge_similar(spark):
    n = spark.createDataFrame([("s", "Flow Meter"), ("s", "Flow Meters"), ("s", "Valve")], "scope string, name string")
    e = spark.createDataFrame([("s", "Flow Meters", "Valve"), ("s", "Flow Meter", "Valve"), ("s", "Flow Meter", "Flow Meters")], "scope string, source string, target string")
    nodes, edges = candidates.merge_similar(n, e)
    assert {r.name for r in nodes.collect()} == {"Flow Meter", "Valve"}
    assert [(r.source, r.target) for r in edges.collect()] == [("Flow Meter", "Valve")]


def test_partners_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), i, "".join(rng.choice("xyz") for _ in range(6))) for i in range(60)] + [("a", 99, None)]
    df = spark.createDataFrame(rows, "scope string, id long, name string").repartition(4)
    got = candidates.partners(df.filter("id % 20 = 0"), df, ["name"], candidates.contrast, 2, per_block=2).collect()
    for scope, q, name in rows:
        if q % 20 == 0:
            all_ = sorted((-s, i) for sc, i, n in rows if sc == scope and i != q and (s := candidates.contrast((name,), (n,))) is not None)[:2]
            assert [r.partner for r in sorted(got, key=lambda r: r["rank"]) if r.query == q] == [i for _, i in all_]
    near = candidates.closeness(0.9)
    assert near(([1.0, 0.0], "s", "", ""), ([1.0, 0.0], "t", "", "")) == 1.0 and near(([1.0, 0.0], "s", "ab", ""), ([0.0, 1.0], "t", "", "x")) is None
    assert near((None, "s", "ab", ""), (None, "s", "", "")) == 0.0 and candidates.mentions("阀门管理", "关于阀门") and not candidates.mentions("管理", "管理")


def test_contexts(spark):
    df = spark.createDataFrame([("x" * 40, ["a"] * 3, "short", "long " * 50), ("x" * 4000, [], "short", "long")], "text string, terms array<string>, compact_outline string, full_outline string")
    got = prompts.fit_context(df, 100, 20).collect()
    assert [r.context_level for r in got] == ["terms", "none"] and got[1].context is None and "a\n" in got[0].context
    many = spark.createDataFrame([([str(i) for i in range(40)] + ["3"],)], "t array<string>").select(prompts.last_terms(F.col("t")).alias("l")).first().l
    assert many == [str(i) for i in range(16, 40)]


def test_outline_contexts_by_section(spark):
    from graphloom.operators.hierarchy import hierarchy

    o = [("s", "r", None, "Root", 0), ("s", "a", "r", "A", 1), ("s", "a1", "a", "A1", 2), ("s", "b", "r", "B", 3), ("s", "b1", "b", "B1", 4), ("s", "b2", "b1", None, 5), ("s", "lost", "gone", "L", 6), ("t", "x", None, "X", 0)]
    rows = spark.createDataFrame(o, "scope string, id string, parent string, title string, sort_order int")
    tree = hierarchy(rows.select("scope", "id", "parent"), "scope", "id", "parent").join(rows.drop("parent"), ["scope", "id"])
    got = {(r.scope, r.id): r for r in prompts.outline_contexts(prompts.outline_entries(tree)).collect()}
    assert len(got) == 8
    assert got["s", "b1"].compact_outline == "- [a] A\n- [b] B\n  - [b1] B1 <CURRENT>\n    - [b2] \n- [lost] L"
    assert got["s", "b2"].full_outline == "- [a] A\n  - [a1] A1\n- [b] B\n  - [b1] B1\n    - [b2]  <CURRENT>\n- [lost] L"
    assert got["s", "lost"].compact_outline == "- [a] A\n- [b] B\n- [lost] L <CURRENT>" and got["t", "x"].full_outline is None
    short = {(r.scope, r.id): r for r in prompts.outline_contexts(prompts.outline_entries(tree), 30).collect()}
    assert short["s", "a1"].full_outline is None and short["s", "a1"].compact_outline is not None
    row = spark.createDataFrame([("text", ["t"], None, None, "doc", [3, None, 2], "- [a] x")], "text string, terms array<string>, compact_outline string, full_outline string, document string, pages array<int>, scope_text string")
    assert prompts.fit_context(row, 100, 10).first().context_level == "none"
    context = prompts.fit_context(row.fillna({"compact_outline": ""}), 100, 10).first().context
    assert context.startswith("# Document\nDocument: doc\nSections of the text:\n- [a] x\nPages: 2, 3\n\n# Outline\n")


def test_merge_by_vectors_and_names_without_a_key(spark):
    text = "measures the flow of a liquid through a closed pipe, in litres a minute, by the pressure on both sides of a plate " * 3
    n = [("s", "Orifice", text), ("s", "Gauge", text), ("s", "Valve", "shuts"), ("s", "Ｖａｌｖｅ", None), ("s", "Ёлка", None), ("s", "  ", None), ("s", None, None), ("t", "Gauge", text)]
    nodes = spark.createDataFrame(n, "scope string, name string, summary string")
    none = spark.createDataFrame([], "scope string, source string, target string")
    got = candidates.merge_similar(nodes, none)[0].collect()
    assert sorted((r.scope, str(r.name)) for r in got) == [("s", "  "), ("s", "Gauge"), ("s", "None"), ("s", "Valve"), ("s", "Ёлка"), ("t", "Gauge")]


def test_close_vectors_connect_what_brute_force_does(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), f"n{i}", [rng.gauss(0, 1) for _ in range(3)]) for i in range(80)] + [("a", "zero", [0.0] * 3), ("a", "null", None)]
    got = candidates.close_vectors(spark.createDataFrame(rows, "scope string, name string, vector array<double>"), per_block=7).collect()
    label = {n: n for _, n, _ in rows}
    expect = dict(label)
    cos = candidates.cosine_of
    pairs = [(a, b) for s, a, x in rows for t, b, y in rows if s == t and a < b and cos(x, y) >= 0.94]
    for _ in rows:
        for a, b in pairs:
            expect[a] = expect[b] = min(expect[a], expect[b])
        for r in got:
            label[r.name] = label[r.other] = min(label[r.name], label[r.other])
    assert pairs and label == expect


def test_global_candidates(spark):
    rows = [(1, "c", "s1", "alpha", "x", [1.0, 0.0]), (2, "c", "s2", "beta", "y", [0.99, 0.01]), (3, "d", "s3", "gamma", "z", [1.0, 0.0]), (4, "d", "s3", "gammb", "q", [0.0, 1.0]), (5, "d", "s3", "zzzz", "w", [0.0, 1.0]), (6, None, None, "null", None, None), (7, "e", "s7", "lone", "alone", None)]
    nodes = spark.createDataFrame(rows, "id int, scope string, section string, name string, body string, vector array<double>")
    edges = spark.createDataFrame([(5, 4), (None, 1)], "source int, target int")
    got = {(r.left, r.right): (round(r.score, 3), r.reasons) for r in candidates.global_candidates(nodes, nodes, edges, 1, 0.8).collect()}
    assert got == {(1, 2): (1.0, "semantic_similarity"), (3, 4): (0.0, "same_section_contrast,same_section_gap"), (3, 5): (0.0, "same_section_gap")}
    assert {tuple(r)[:2] for r in candidates.global_candidates(nodes.filter("id = 1"), nodes, edges, 1, 0.8).collect()} == {(1, 2)}
    assert candidates.global_candidates(nodes, nodes, spark.createDataFrame([(1, 2)], "source int, target int"), 1, 0.8).filter("left = 1").count() == 0
    assert candidates.global_candidates(nodes.limit(0), nodes.limit(0), edges).count() == 0
