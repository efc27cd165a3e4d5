import datetime as dt

import pytest

from graphloom.operators import references
from graphloom.operators.lookup import hot_keys, known_hot, lookup_inner
from graphloom.operators.references import orphan_references, orphan_report

T = [dt.datetime(2024, m, 1) for m in range(1, 13)]
REFS = "ref_id long, ref_field string, ref_time timestamp, a string, b string, live string"
GOAL = "a string, b string, live boolean, created_at timestamp, ref_time string"


def found(df):
    return {(r.ref_id, r.orphan_kind) for r in df.collect()}


@pytest.fixture
def tables(spark):
    goal = spark.createDataFrame(
        [("x", "1", True, T[0], ""), ("x", "1", False, T[5], ""), ("x", "2", False, T[0], ""), ("y", "3", True, T[6], ""), (None, "9", True, T[0], "")], GOAL
    )
    refs = spark.createDataFrame(
        [
            (1, "f", T[3], "x", "1", ""),
            (2, "f", T[3], "x", "2", ""),
            (3, "f", T[3], "y", "3", ""),
            (4, "f", T[8], "y", "3", ""),
            (5, "f", T[3], "z", "1", ""),
            (5, "f", T[3], "z", "1", ""),
            (6, "f", T[3], None, "1", ""),
            (7, "f", T[3], None, "7", ""),
            (8, "f", T[3], None, None, ""),
            (9, "f", None, "y", "3", ""),
        ],
        REFS,
    )
    return refs, goal


def test_simple_partial_and_full_match(tables):
    refs, goal = tables
    simple = {(2, "deleted"), (3, "late"), (5, "missing")}
    assert found(orphan_references(refs, goal, ["a", "b"])) == simple
    # b = 9 has a target with a null a: partial references match on their own non-null columns
    assert found(orphan_references(refs, goal, ["a", "b"], "partial")) == simple | {(7, "missing")}
    assert found(orphan_references(refs, goal, ["a", "b"], "full")) == simple | {(6, "malformed"), (7, "malformed")}
    with pytest.raises(ValueError):
        orphan_references(refs, goal, ["a"], "other")


def test_hot_failing_key_and_empty_tables(spark, tables, monkeypatch):
    refs, goal = tables
    monkeypatch.setattr(references, "HOT_ROWS", 1)
    monkeypatch.setattr(references, "HOT_KEYS", 1)
    assert found(orphan_references(refs, goal, ["a", "b"])) == {(2, "deleted"), (3, "late"), (5, "missing")}
    none = goal.limit(0)
    assert found(orphan_references(refs, none, ["a", "b"])) == {(i, "missing") for i in (1, 2, 3, 4, 5, 9)}
    assert orphan_references(refs.limit(0), goal, ["a", "b"]).count() == 0
    assert {(r.orphan_kind, r.n_references) for r in orphan_report(orphan_references(refs, goal, ["a", "b"]), ["ref_field"]).collect()} == {("deleted", 1), ("late", 1), ("missing", 1)}


def test_lookup_keeps_every_match_with_hot_keys(spark):
    rows = spark.createDataFrame([("h" if i % 3 else f"k{i % 7}", i) for i in range(300)] + [(None, -1)], "k string, i int")
    by = spark.createDataFrame([("h", 1), ("k0", 2), ("k3", 3)], "k string, v int")
    hot = hot_keys(rows, ["k"], 2, 50)
    assert [r.k for r in hot.collect()] == ["h"]
    plain = {tuple(r) for r in rows.join(by, "k").collect()}
    assert sorted(tuple(r) for r in lookup_inner(rows, by, ["k"], hot, 4).collect()) == sorted(plain)
    assert known_hot(rows, ["k"], 2, 1000) is None and known_hot(rows, ["k"], 2, 50).count() == 1
