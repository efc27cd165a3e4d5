import datetime as dt

import pytest

from graphloom.llm import survivors as s

D = [dt.datetime(2024, 1, d) for d in range(1, 29)]
SCHEMA = "record_id long, pkg string, name string, aliases array<string>, confidence double, summary string, evidence string, refs array<string>, kind string, at timestamp"


def points(df):
    groups = {}
    for r in s.duplicate_groups(df, "record_id", "pkg", "name", "aliases").collect():
        groups.setdefault(r.point, set()).add(r.record_id)
    return {frozenset(g) for g in groups.values()}


def rows(spark, names):
    return spark.createDataFrame([(i, p, n, a, None, None, None, None, None, None) for i, (p, n, a) in enumerate(names)], SCHEMA)


def test_groups_by_spelling_order_slips_remarks_and_aliases(spark):
    names = [
        ("p", "Final Settlement Offer Criterion", ["FSOC-A"]), ("p", "criterion, final settlement offer", []), ("p", "Final Settlemnt Offer Criterion", None), ("p", "The Ｆｉｎａｌ Settlement-Offer Criterions (see below)", []),
        ("p", "FSOC-A", []), ("p", "FSOC-B", []), ("q", "Final Settlement Offer Criterion", []), ("p", "Final Settlement Offer Test Type II", []), ("p", "Final Settlement Offer Test Type III", ["FSOC-B"]),
        ("p", "持续 的申报义务框架", []), ("p", "《持续申报义务框架》（见本章）", []), ("p", "持续申报义务规则", []), ("p", None, []), ("p", " ", [None, ""]), ("p", "...", []), ("p", "Cache Protocol A", []), ("p", "A, Cache Protocol", []), ("p", "A Cache Protocol", []),
    ]
    expect = {frozenset(g) for g in ({0, 1, 2, 3, 4}, {5, 8}, {6}, {7}, {9, 10}, {11}, {12}, {13}, {14}, {15, 16}, {17})}
    assert points(rows(spark, names)) == expect
    assert points(rows(spark, [])) == set()


def test_best_values_ties_and_fillers(spark):
    data = [
        (1, "p", "Valve Seat Rule", [], 0.9, "short text", "N/A", ["r1", " ", "r1"], "x", D[1]),
        (2, "p", "valve seat rule", [], 1.7, "  longer text here ", None, ["r1", "r2"], "x", D[2]),
        (3, "p", "rule, seat valve", [], 0.9, "No summary was available at the time of extraction; it is a very long filler.", "见证据一", [], "x", D[3]),
        (4, "p", "D", [], float("nan"), "todo", "-", [" "], "x", D[3]),
        (5, "p", "d", [], None, "", None, None, "x", D[4]),
        (6, "p", "alone", [], 0.5, "x", "y", ["z"], "x", D[4]),
    ]
    df = spark.createDataFrame(data, SCHEMA)
    groups = s.duplicate_groups(df, "record_id", "pkg", "name", "aliases")
    fields = ("confidence", ["summary", "evidence"], "refs")
    best = s.survivors(s.with_currency(s.measured(groups, *fields), "point", "at", ["kind"]), "point", "record_id", *fields)
    best = s.surviving_values(best, df, "record_id", *fields).collect()
    by = {r.group_id: r for r in best}
    assert set(by) == {1, 4}
    a, d = by[1], by[4]
    assert (a.confidence, a.confidence_record) == (0.9, 3)
    assert (a.summary, a.summary_record, a.evidence_record, a.refs, a.refs_record) == ("longer text here", 2, 3, ["r1", "r2"], 2)
    assert (d.confidence_record, d.summary_record, d.evidence_record, d.refs_record) == (None,) * 4


def test_currency_orders_rows_without_time(spark):
    seen = [(i * 10 + j, f"g{i}", k, D[j]) for i in range(3) for j, k in enumerate(["draft", "review", "final"])]
    lost = [(91, "g0", "final", None), (92, "g0", "draft", None), (93, "g9", "review", None)]
    df = spark.createDataFrame(seen + lost, "record_id long, point string, kind string, at timestamp")
    rank = {r.value: r["rank"] for r in s.learn_precedence(df, "point", "kind", "at").collect()}
    assert rank["draft"] < rank["review"] < rank["final"]
    got = {r.record_id: r._current for r in s.with_currency(df, "point", "at", ["kind"]).collect()}
    assert got[91].t == D[2] and got[92].t == D[0] and got[93].t is None
    assert s.with_currency(df.limit(0), "point", "at", ["kind"]).count() == 0
    # with the order turned round the rows without a time fall elsewhere
    turned = {"kind": spark.createDataFrame([(v, 2 - r) for v, r in rank.items()], "value string, rank int")}
    other = {r.record_id: r._current for r in s.with_currency(df, "point", "at", ["kind"], turned).collect()}
    assert (other[91].t, other[92].t) == (D[2], D[2]) and other[91].r < other[92].r


def test_precedence_is_transitive_crosses_months_and_breaks_cycles(spark):
    jan, feb = dt.datetime(2024, 1, 30), dt.datetime(2024, 2, 2)
    seen = [("g", "a", D[0]), ("g", "b", D[1]), ("h", "b", D[0]), ("h", "c", D[1]), ("m", "c", jan), ("m", "d", feb), ("n", "c", jan), ("n", "d", feb), ("o", "d", D[0]), ("o", "a", D[1]), ("p", None, D[0]), ("q", "alone", D[0])]
    seen += [("g2", "a", D[0]), ("g2", "b", D[1]), ("h2", "b", D[0]), ("h2", "c", D[1])]
    df = spark.createDataFrame(seen, "point string, kind string, at timestamp")
    rank = {r.value: r["rank"] for r in s.learn_precedence(df, "point", "kind", "at").collect()}
    # d before a, the weakest majority, would close a cycle
    assert rank == {"a": 0, "b": 1, "c": 2, "d": 3}
    with pytest.raises(ValueError):
        s.learn_precedence(df, "point", "kind", "at", most_values=2)


def test_slips_go_by_ratio_and_by_join_as_by_broadcast(spark):
    names = [("p", f"Pressure Valve Rule {i}", []) for i in "ABCDEFGH"] + [("p", "Presure Valve Rule A", []), ("p", "Pressure Valve Rule A", ["Presure Rule Valve B"])]
    found = points(rows(spark, names))
    assert {8, 9, 0} <= next(g for g in found if 8 in g) and 1 in next(g for g in found if 9 in g)
    tenfold = [(f"{p}{k}", n, a) for k in range(10) for p, n, a in names]
    assert len(points(rows(spark, tenfold))) == 10 * len(found)
    by_join = {}
    for r in s.duplicate_groups(rows(spark, names), "record_id", "pkg", "name", "aliases", most_broadcast=0).collect():
        by_join.setdefault(r.point, set()).add(r.record_id)
    assert {frozenset(g) for g in by_join.values()} == found
