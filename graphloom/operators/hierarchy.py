"""Parent-child rows to full hierarchies: components, coloured depth-first walks, cycles.

A scope (say a package) with up to `co_locate` rows is brought together in one task, split there into
its connected components, and each component is walked by an iterative depth-first search that
colours nodes. Scopes beyond that size are cut into components by pointer doubling over DataFrames,
whose rounds double the distance walked; no component is ever gathered in one task then. Both give
the same columns and rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.lookup import lookup_inner
from graphloom.session import cut_lineage

#: Nodes of one scope that a task takes at once: some 100 bytes each, so about 20 MB.
CO_LOCATE = 200_000

OK, CYCLE, BELOW, DETACHED = "ok", "cycle", "below_cycle", "detached"
_WHITE, _GREY, _BLACK = 0, 1, 2


def components(parent: list[int]) -> list[int]:
    """The smallest member index of each node's component; parent[i] is an index or -1."""
    label = list(range(len(parent)))

    def top(i: int) -> int:
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for i, p in enumerate(parent):
        if p >= 0:
            a, b = top(i), top(p)
            if a != b:
                label[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(parent))]


def walk(parent: list[int], lost: list[bool]) -> tuple[list[str], list[int], list[int]]:
    """Status, steps to the root and root of each node.

    parent[i] is an index or -1; lost[i]: i names a parent that is not there. Nodes are coloured grey
    while on the current path and black when done; a step onto a grey node is a back edge, and the
    path from there on is a cycle. A root's steps are 0; nodes of or below cycles and detached ones
    have steps -1 and root -1.
    """
    n = len(parent)
    colour, status, steps, root = [_WHITE] * n, [OK] * n, [0] * n, [-1] * n
    for first in range(n):
        if colour[first] != _WHITE:
            continue
        path, at = [], first
        while at >= 0 and colour[at] == _WHITE:
            colour[at] = _GREY
            path.append(at)
            at = parent[at]
        if at >= 0 and colour[at] == _GREY:
            start = path.index(at)
            for i in path[start:]:
                status[i], steps[i], colour[i] = CYCLE, -1, _BLACK
            path, above = path[:start], (BELOW, -1, -1)
        elif at >= 0:
            above = (BELOW if status[at] == CYCLE else status[at], steps[at], root[at])
        else:
            top = path.pop()
            colour[top] = _BLACK
            if lost[top]:
                status[top], steps[top] = DETACHED, -1
            else:
                root[top] = top
            above = (status[top], steps[top], root[top])
        kind, depth, r = above
        for i in reversed(path):
            depth = depth + 1 if kind == OK else -1
            status[i], steps[i], root[i], colour[i] = kind, depth, r, _BLACK
    return status, steps, root


def subtree_sizes(parent: list[int], status: list[str], steps: list[int]) -> list[int]:
    """Number of descendants of each node that reaches a root, summed from the deepest up; others have 0."""
    below = [0] * len(parent)
    for i in sorted(range(len(parent)), key=steps.__getitem__, reverse=True):
        if status[i] == OK and parent[i] >= 0:
            below[parent[i]] += below[i] + 1
    return below


def _walk_scope(scope: pd.DataFrame, paths: bool, carry: list[str], branches: bool = False) -> pd.DataFrame:
    ids, parents = scope["_id"].tolist(), [None if p != p else p for p in scope["_parent"].tolist()]
    index = {x: i for i, x in enumerate(ids)}
    parent = [-1 if p is None else index.get(p, -1) for p in parents]
    lost = [p is not None and p not in index for p in parents]
    status, steps, root = walk(parent, lost)
    label = components(parent)
    name: dict[int, str] = {}
    for i, c in enumerate(label):
        if parent[i] < 0:
            name[c] = ids[i]
        elif status[i] == CYCLE:
            name[c] = min(name.get(c, ids[i]), ids[i])
    out = pd.DataFrame(
        {
            "_scope": scope["_scope"].tolist(),
            "_id": ids,
            "component": [name[c] for c in label],
            "root": [ids[r] if r >= 0 else None for r in root],
            "steps": steps,
            "status": status,
            **{c: scope[c].tolist() for c in carry},
        }
    )
    if paths:
        made: list[list[str] | None] = [None] * len(ids)
        for i in sorted(range(len(ids)), key=lambda i: steps[i]):
            if status[i] == OK:
                p = parent[i]
                made[i] = [ids[i]] if p < 0 else [*made[p], ids[i]]  # type: ignore[misc]
        out["path"], out["n_descendants"] = made, subtree_sizes(parent, status, steps)
    if branches:
        branch: list[str | None] = [None] * len(ids)
        for i in sorted(range(len(ids)), key=steps.__getitem__):
            if steps[i] > 0:
                branch[i] = ids[i] if steps[i] == 1 else branch[parent[i]]
        out["branch"] = branch
    return out


def _walk_partition(paths: bool, carry: list[str], branches: bool = False):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Batches sorted by scope; a scope is walked when its last row has come."""
        rest: list[pd.DataFrame] = []
        for batch in batches:
            if batch.empty:
                continue
            last = batch["_scope"].iloc[-1]
            ended = batch[batch["_scope"] != last]
            if len(ended) or (rest and rest[-1]["_scope"].iloc[-1] != last):
                ready = pd.concat([*rest, ended])
                rest = [batch[batch["_scope"] == last]]
                yield from (_walk_scope(g, paths, carry, branches) for _, g in ready.groupby("_scope", sort=False))
            else:
                rest.append(batch)
        if rest:
            yield from (_walk_scope(g, paths, carry, branches) for _, g in pd.concat(rest).groupby("_scope", sort=False))

    return run


_COLUMNS = "_scope string, _id string, component string, root string, steps long, status string"
_PATHS, _BRANCH = ", path array<string>, n_descendants long", ", branch string"


def _doubling(nodes: DataFrame) -> DataFrame:
    """The columns of _COLUMNS for scopes of any size, by pointer doubling.

    jump is the 2^k-th ancestor. A node is done when its jump is a root or a detached top. After more
    rounds than any path needs, only nodes on and below cycles are left; the nodes on cycles are the
    images of jump, and a cycle's label is the smallest node met on the way round.
    """
    known = nodes.select("_scope", F.col("_id").alias("_parent"), F.lit(True).alias("_known"))
    has = F.col("_known")
    state = cut_lineage(
        nodes.join(known, ["_scope", "_parent"], "left").select(
            "_scope",
            "_id",
            F.when(has, F.col("_parent")).alias("_jump"),
            F.when(has, 1).otherwise(0).cast("long").alias("steps"),
            F.when(F.col("_parent").isNull(), OK).when(has.isNull(), DETACHED).alias("status"),
            F.when(has.isNull(), F.col("_id")).alias("_top"),
            F.least("_id", F.when(has, F.col("_parent"))).alias("_least"),
        )
    )
    longest = nodes.groupBy("_scope").count().agg(F.max("count")).first()[0] or 0
    reach = 1
    while reach <= longest and state.filter("status is null").take(1):
        ahead = state.select("_scope", F.col("_id").alias("_jump"), *[F.col(c).alias(f"{c}2") for c in ("_jump", "steps", "status", "_top", "_least")])
        going = lookup_inner(state.filter("status is null"), ahead, ["_scope", "_jump"]).select(
            "_scope",
            "_id",
            F.col("_jump2").alias("_jump"),
            (F.col("steps") + F.col("steps2")).alias("steps"),
            F.col("status2").alias("status"),
            F.col("_top2").alias("_top"),
            F.least("_least", "_least2").alias("_least"),
        )
        state = cut_lineage(state.filter("status is not null").unionByName(going))
        reach *= 2
    left = state.filter("status is null")
    rings = left.select("_scope", F.col("_jump").alias("_id")).distinct().withColumn("_ring", F.lit(True))
    labels = left.join(rings, ["_scope", "_id"], "left_semi").select("_scope", F.col("_id").alias("_jump"), F.col("_least").alias("_label"))
    cyclic = lookup_inner(left.join(rings, ["_scope", "_id"], "left"), labels, ["_scope", "_jump"]).select(
        "_scope",
        "_id",
        F.col("_label").alias("component"),
        F.lit(None).cast("string").alias("root"),
        F.lit(-1).cast("long").alias("steps"),
        F.when(F.col("_ring"), CYCLE).otherwise(BELOW).alias("status"),
    )
    ok = F.col("status") == OK
    return (
        state.filter("status is not null")
        .select(
            "_scope",
            "_id",
            F.col("_top").alias("component"),
            F.when(ok, F.col("_top")).alias("root"),
            F.when(ok, F.col("steps")).otherwise(F.lit(-1)).alias("steps"),
            "status",
        )
        .unionByName(cyclic)
    )


def _paths(nodes: DataFrame, tree: DataFrame) -> DataFrame:
    """tree with path and n_descendants, by doubling over the nodes that reach a root."""
    ok = tree.filter(F.col("status") == OK).select("_scope", "_id")
    state = nodes.join(ok, ["_scope", "_id"], "left_semi").select(
        "_scope", "_id", F.col("_parent").alias("_jump"), F.array("_id").alias("path")
    )
    state = cut_lineage(state)
    while state.filter("_jump is not null").take(1):
        ahead = state.select("_scope", F.col("_id").alias("_jump"), F.col("_jump").alias("_jump2"), F.col("path").alias("_above"))
        going = lookup_inner(state.filter("_jump is not null"), ahead, ["_scope", "_jump"]).select(
            "_scope", "_id", F.col("_jump2").alias("_jump"), F.concat("_above", "path").alias("path")
        )
        state = cut_lineage(state.filter("_jump is null").unionByName(going))
    sizes = (
        state.filter(F.size("path") > 1)
        .select("_scope", F.explode(F.slice("path", 1, F.size("path") - 1)).alias("_id"))
        .groupBy("_scope", "_id")
        .agg(F.count(F.lit(1)).alias("n_descendants"))
    )
    return (
        tree.join(state.drop("_jump"), ["_scope", "_id"], "left")
        .join(sizes, ["_scope", "_id"], "left")
        .withColumn("n_descendants", F.coalesce("n_descendants", F.lit(0)))
    )


def _branches(nodes: DataFrame, tree: DataFrame) -> DataFrame:
    """tree with branch: without the roots, their children are the roots of what is left."""
    roots = nodes.filter("_parent is null").select("_scope", F.col("_id").alias("_parent"), F.lit(True).alias("_top"))
    below = nodes.filter("_parent is not null").join(roots, ["_scope", "_parent"], "left")
    below = below.select("_scope", "_id", F.when(F.col("_top").isNull(), F.col("_parent")).alias("_parent"))
    tops = _doubling(cut_lineage(below)).select("_scope", "_id", F.col("root").alias("branch"))
    return tree.join(tops, ["_scope", "_id"], "left")


def hierarchy(
    nodes: DataFrame,
    scope: str,
    node_id: str,
    parent_id: str,
    paths: bool = True,
    co_locate: int = CO_LOCATE,
    latest: list[str] | None = None,
    carry: list[str] | None = None,
    branches: bool = False,
) -> DataFrame:
    """For each node of each scope: component, root, steps, status, the columns of carry and, with paths,
    its path from the root and number of descendants; with branches, the node one step below the root
    that it is or is under (null for a root and for a node that reaches none), which needs no paths.

    Keys are cleaned already; a null parent makes a root, a parent that is not in the scope makes the
    node and all below it detached, a node that is its own ancestor (its own parent included) is on a
    cycle. Without latest, nodes has one row per (scope, node_id); with it, of several rows of a node
    the one with the greatest (latest, parent, carry) counts. Rows with a null scope form one scope of
    their own; rows with a null node_id are left out. An empty table gives an empty result; extra
    columns are ignored. The result doesn't depend on co_locate, which only chooses who computes it.

    Scopes of up to co_locate rows are shuffled once, by scope: their latest rows are found and their
    components walked behind the same exchange.
    """
    carry, latest = carry or [], latest or []
    held = [F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)]
    rows = nodes.select(
        F.coalesce(F.col(scope).cast("string"), F.lit("")).alias("_scope"),
        F.col(node_id).cast("string").alias("_id"),
        F.struct(*[F.col(c).alias(f"_l{i}") for i, c in enumerate(latest)], F.col(parent_id).cast("string").alias("_parent"), *held).alias("_now"),
    ).filter(F.col("_id").isNotNull())
    kept = [f"_c{i}" for i in range(len(carry))]

    def current(some: DataFrame) -> DataFrame:
        one = some.groupBy("_scope", "_id").agg(F.max("_now").alias("_now")) if latest else some
        return one.select("_scope", "_id", "_now._parent", *[f"_now.{c}" for c in kept])

    large = rows.groupBy("_scope").count().filter(F.col("count") > co_locate).select("_scope")
    has_large = bool(large.take(1))
    small = rows.join(large, "_scope", "left_anti") if has_large else rows
    small = current(small.repartition("_scope")).sortWithinPartitions("_scope")
    carried = "".join(f", {c} {small.schema[c].dataType.simpleString()}" for c in kept)
    out = small.mapInPandas(_walk_partition(paths, kept, branches), _COLUMNS + carried + (_PATHS if paths else "") + (_BRANCH if branches else ""))
    if has_large:
        rows = cut_lineage(current(rows.join(large, "_scope", "left_semi")))
        bare = rows.select("_scope", "_id", "_parent")
        tree = _doubling(bare)
        tree = _paths(bare, cut_lineage(tree)) if paths else tree
        tree = _branches(bare, tree) if branches else tree
        out = out.unionByName(tree.join(rows.select("_scope", "_id", *kept), ["_scope", "_id"]) if kept else tree)
    return out.withColumnsRenamed({"_scope": scope, "_id": node_id, **dict(zip(kept, carry))})


def descendants(tree: DataFrame, scope: str, node_id: str) -> DataFrame:
    """(scope, ancestor, descendant, distance) of every pair on a path of hierarchy(paths=True)."""
    return tree.filter(F.col("path").isNotNull()).select(
        scope,
        F.posexplode(F.reverse("path")).alias("distance", "ancestor"),
        F.col(node_id).alias("descendant"),
    ).filter("distance > 0")
