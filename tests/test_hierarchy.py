import random

from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.operators.hierarchy import components, descendants, hierarchy, subtree_sizes, walk

SCHEMA = "pkg string, nid string, parent string, title string, status string"


def brute(rows):
    """Status and steps of each node by walking up."""
    parent = {(p, n): q for p, n, q, *_ in rows}
    out = {}
    for key in parent:
        seen, at, steps = [key], key, 0
        while True:
            q = parent[at]
            if q is None:
                out[key] = ("ok", steps)
                break
            up = (at[0], q)
            if up not in parent:
                out[key] = ("detached", -1)
                break
            if up in seen:
                out[key] = ("cycle" if up == key else "below_cycle", -1)
                break
            seen.append(up)
            at, steps = up, steps + 1
    return out


def made(rng, packages, size):
    rows = []
    for p in range(packages):
        names = [f"n{i}" for i in range(size)]
        for i, n in enumerate(names):
            q = None if i == 0 else rng.choice([names[rng.randrange(i)], names[rng.randrange(size)], "lost", names[i - 1], names[i - 1], names[i - 1]])
            rows.append((f"p{p}", n, q, "t", "x"))
    return rows


def test_statuses_of_small_and_large_scopes_agree_with_brute_force(spark):
    rows = made(random.Random(4), 5, 40) + [("q", f"s{i}", None if i == 0 else "s0", "t", "x") for i in range(90)]
    df = spark.createDataFrame(rows, SCHEMA)
    expected = brute(rows)
    results = []
    for limit in (10_000, 45, 1):
        tree = hierarchy(df, "pkg", "nid", "parent", True, co_locate=limit).collect()
        assert {(r.pkg, r.nid): (r.status, r.steps) for r in tree} == expected, limit
        by = {(r.pkg, r.nid): r for r in tree}
        for r in tree:
            if r.status == "ok":
                assert len(r.path) == r.steps + 1 and r.path[-1] == r.nid and r.path[0] == r.root == r.component
                assert r.n_descendants == sum(1 for x in tree if x.pkg == r.pkg and x.status == "ok" and r.nid in x.path[:-1])
            else:
                assert r.path is None and r.root is None and r.n_descendants == 0
        results.append(sorted(tuple(str(r[c]) for c in sorted(r.asDict())) for r in tree))
        cyclic = [r for r in tree if r.status == "cycle"]
        for r in cyclic:
            assert by[(r.pkg, r.component)].status == "cycle" and r.component <= r.nid
    assert results[0] == results[1] == results[2]


def test_latest_rows_and_carried_columns_for_scopes_of_any_size(spark):
    rows = [("p", "a", None, 1, "x"), ("p", "b", "z", 1, "old"), ("p", "b", "a", 2, "new"), ("p", "b", "a", 2, "new"), ("p", "c", "b", None, None), (None, "a", None, 1, "n")]
    df = spark.createDataFrame(rows, "pkg string, nid string, parent string, at int, note string")
    for limit in (100, 0):
        got = {(r.pkg, r.nid): (r.status, r.steps, r.note) for r in hierarchy(df, "pkg", "nid", "parent", False, limit, latest=["at"], carry=["note"]).collect()}
        assert got == {("p", "a"): ("ok", 0, "x"), ("p", "b"): ("ok", 1, "new"), ("p", "c"): ("ok", 2, None), ("", "a"): ("ok", 0, "n")}


def test_descendants_are_all_pairs_on_a_path(spark):
    df = spark.createDataFrame([("p", "a", None), ("p", "b", "a"), ("p", "c", "b"), ("p", "x", "x")], "pkg string, nid string, parent string")
    pairs = descendants(hierarchy(df, "pkg", "nid", "parent"), "pkg", "nid").collect()
    assert {(r.ancestor, r.descendant, r.distance) for r in pairs} == {("a", "b", 1), ("b", "c", 1), ("a", "c", 2)}


def test_empty_table_null_ids_and_null_scopes(spark):
    none = spark.createDataFrame([], "pkg string, nid string, parent string")
    assert hierarchy(none, "pkg", "nid", "parent").count() == 0
    odd = spark.createDataFrame([(None, "a", None), (None, None, "a"), (None, "b", "a")], "pkg string, nid string, parent string")
    assert {r.nid: r.steps for r in hierarchy(odd, "pkg", "nid", "parent").collect()} == {"a": 0, "b": 1}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-2, 11), min_size=1, max_size=12))
def test_walk_and_subtree_sizes(raw):
    n = len(raw)
    parent = [p if 0 <= p < n else -1 for p in raw]
    lost = [p == -2 for p in raw]
    status, steps, root = walk(parent, lost)
    rows = [("s", str(i), None if raw[i] == -1 or raw[i] >= n else "lost" if lost[i] else str(parent[i])) for i in range(n)]
    expected = brute(rows)
    assert {("s", str(i)): (status[i], steps[i]) for i in range(n)} == expected
    below = subtree_sizes(parent, status, steps)
    for i in range(n):
        held = 0
        for j in range(n):
            at, ok = j, status[j] == "ok" and j != i
            while ok and at != i and parent[at] >= 0:
                at = parent[at]
            held += ok and at == i
        assert held == below[i]
    label = components(parent)
    assert all(label[i] == label[p] for i, p in enumerate(parent) if p >= 0)
