"""Pairs of nodes that may belong together: similar names, close vectors, mentions, contrasts."""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Callable
from difflib import SequenceMatcher
from heapq import nsmallest

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.text import normal_name, sequence_ratio
from graphloom.functions.vectors import cosine, embed
from graphloom.operators.graphs import connected_components
from graphloom.session import cut_lineage

#: Least name similarity of duplicates.
SIMILAR = 0.82
#: Least cosine of duplicates.
CLOSE = 0.94
# --- fixed values: terms too general to count as a mention
GENERAL = ("项目", "管理", "团队", "职能", "流程", "知识", "系统", "方式", "能力", "相关", "提供")


def similar_names(names: DataFrame, least: float = SIMILAR) -> DataFrame:
    """(scope, name, class_name, n_links) of each distinct name of a scope: the names linked to it by a
    matching-block ratio of at least `least`, and the smallest name of its class (chains count).

    names: scope, name; repeated rows are one, nulls and empty names are left out. No link is lost: the
    ratio of names of n and m letters is at most 2 c / (n + m), c being their common letters, so both
    must share one of their rarest letters (a letter's second occurrence is a letter of its own) among
    the first n - ceil(n t / (2 - t)) + 1 in one global order. Only such names, of fitting lengths, meet.
    """
    rows = names.select("scope", "name").filter("name <> ''").distinct()
    letters = F.transform(
        F.sequence(F.lit(1), F.length("name")),
        lambda i: F.concat(F.substring(F.col("name"), i, F.lit(1)), (F.length(F.substring(F.col("name"), F.lit(1), i)) - F.length(F.replace(F.substring(F.col("name"), F.lit(1), i), F.substring(F.col("name"), i, F.lit(1)), F.lit("")))).cast("string")),
    )
    rows = cut_lineage(rows.withColumns({"_n": F.length("name"), "_letters": letters}))
    counts = rows.select(F.explode("_letters").alias("_t")).groupBy("_t").agg(F.count(F.lit(1)).alias("_c"))
    spread = rows.select("scope", "name", "_n", F.explode("_letters").alias("_t")).join(counts, "_t")
    keep = F.col("_n") - F.ceil(F.col("_n") * least / (2 - least) - 1e-9) + 1
    rare = spread.groupBy("scope", "name", "_n").agg(F.array_sort(F.collect_list(F.struct("_c", "_t"))).alias("_s"))
    own = F.transform("_s", lambda x: x["_t"])
    prefix = cut_lineage(rare.select("scope", "name", "_n", own.alias("_all"), F.explode(F.slice("_s", F.lit(1), keep.cast("int"))).alias("_x")).select("scope", "name", "_n", "_all", "_x._t"))
    other = prefix.select("scope", F.col("name").alias("other"), F.col("_n").alias("_m"), F.col("_all").alias("_all2"), "_t")
    fits = (F.col("_m") * (2 - least) >= F.col("_n") * least) & (F.col("_n") * (2 - least) >= F.col("_m") * least)
    common = F.array_intersect("_all", "_all2")
    # a pair that meets on several letters is judged once, on the first of its common ones; and the ratio,
    # which needs Python, only where the common letters allow it
    first = F.element_at(common, 1) == F.col("_t")
    enough = 2 * F.size(common) >= least * (F.col("_n") + F.col("_m")) - 1e-9
    met = prefix.join(other, ["scope", "_t"]).filter((F.col("name") < F.col("other")) & fits)
    pairs = met.filter(enough & first).select("scope", "name", "other")
    # either order may match more letters
    ratio = F.greatest(sequence_ratio(F.col("name"), F.col("other")), sequence_ratio(F.col("other"), F.col("name")))
    links = cut_lineage(pairs.filter(ratio >= least))
    vertex = lambda c: F.concat_ws("\u0001", F.col("scope").cast("string"), F.col(c))
    classes = connected_components(rows.select(vertex("name").alias("id")), links.select(vertex("name").alias("src"), vertex("other").alias("dst")))
    ends = links.select("scope", F.explode(F.array("name", "other")).alias("name")).groupBy("scope", "name").agg(F.count(F.lit(1)).alias("n_links"))
    out = rows.select("scope", "name", vertex("name").alias("id")).join(classes, "id").join(ends, ["scope", "name"], "left")
    return out.select("scope", "name", F.substring_index("component", "\u0001", -1).alias("class_name"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


@F.pandas_udf(T.StringType())
def _folded(names: pd.Series) -> pd.Series:
    return pd.Series([unicodedata.normalize("NFKC", n) if isinstance(n, str) else None for n in names])


def name_key(name: Column) -> Column:
    """normal_name; where that is empty, that of the name in compatibility form (full-width letters and
    the like), else the name itself in lower case. Empty for a blank name, null for null."""
    key = normal_name(name)
    folded = F.when(key == "", _folded(name))
    return F.when(key != "", key).when(normal_name(folded) != "", normal_name(folded)).otherwise(F.lower(F.trim(name)))


def close_vectors(rows: DataFrame, least: float = CLOSE, per_block: int = 2_000) -> DataFrame:
    """(scope, name, other): links between names of a scope that connect all whose vectors have a cosine
    of at least `least`, directly or by chains.

    rows: scope, name, vector; one row per scope and name. Exact: a scope is cut into blocks of about
    per_block rows, and every two blocks of it meet in one task, which gives a forest of their links, so
    that many equal vectors are no square of rows. Vectors that are null or of no length are close to none.
    """
    rows = rows.select("scope", "name", "vector").filter(F.col("vector").isNotNull())
    sizes = rows.groupBy("scope").agg(F.ceil(F.count(F.lit(1)) / per_block).cast("int").alias("_blocks"))
    rows = rows.join(sizes, "scope").withColumn("_own", F.pmod(F.xxhash64("name"), F.col("_blocks")).cast("int"))
    rows = rows.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    rows = rows.withColumns({"_i": F.least("_own", "_with"), "_j": F.greatest("_own", "_with")}).drop("_blocks", "_with")

    def linked(group: pd.DataFrame) -> pd.DataFrame:
        names, v = group["name"].to_numpy(), np.asarray(group["vector"].tolist(), dtype="float64")
        lengths = np.linalg.norm(v, axis=1, keepdims=True)
        v = v / np.where(lengths > 0, lengths, np.inf)
        label = list(range(len(names)))

        def top(i: int) -> int:
            while label[i] != i:
                label[i] = label[label[i]]
                i = label[i]
            return i

        found = []
        for at in range(0, len(names), 256):
            for i, j in zip(*np.nonzero(v[at : at + 256] @ v.T >= least)):
                a, b = top(int(i) + at), top(int(j))
                if a != b:
                    label[max(a, b)] = min(a, b)
                    found.append((int(i) + at, int(j)))
        return pd.DataFrame({"scope": [group["scope"].iloc[0]] * len(found), "name": [names[i] for i, _ in found], "other": [names[j] for _, j in found]}, dtype=object)

    kinds = ", ".join(f"{c} {rows.schema[f].dataType.simpleString()}" for c, f in (("scope", "scope"), ("name", "name"), ("other", "name")))
    return rows.groupBy("scope", "_i", "_j").applyInPandas(linked, kinds)


def merge_similar(nodes: DataFrame, edges: DataFrame, least: float = SIMILAR, least_cosine: float = CLOSE) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) with names replaced by the smallest of their class, duplicates merged away.

    nodes: scope, name and others; edges: scope, source, target and others. Names are compared by
    name_key; two are linked by their ratio, or by the cosine of the vectors of name and longest
    summary (a column `summary`, if there is one), and chains count. A name without a key stays as it
    is. Loops that the renaming makes are dropped.
    """
    spelt = cut_lineage(nodes.withColumn("_key", name_key(F.col("name"))))
    summary = F.max_by("summary", F.struct(F.length("summary"), "summary")) if "summary" in nodes.columns else F.lit(None).cast("string")
    keyed = cut_lineage(spelt.filter("_key <> ''").groupBy("scope", "_key").agg(F.min("name").alias("_new"), summary.alias("_summary")))
    by_name = similar_names(keyed.select("scope", F.col("_key").alias("name")), least).select("scope", "name", F.col("class_name").alias("other"))
    vectors = keyed.select("scope", F.col("_key").alias("name"), embed(F.concat_ws("\n", "_new", "_summary")).alias("vector"))
    vertex = lambda c: F.concat_ws("\u0001", F.col("scope").cast("string"), F.col(c))
    links = by_name.unionByName(close_vectors(vectors, least_cosine)).select(vertex("name").alias("src"), vertex("other").alias("dst"))
    classes = connected_components(keyed.select(vertex("_key").alias("id")), links)
    shown = keyed.select(vertex("_key").alias("component"), "_new")
    mapping = cut_lineage(keyed.select("scope", "_key", vertex("_key").alias("id")).join(classes, "id").join(shown, "component").select("scope", "_key", "_new"))
    named = spelt.join(mapping, ["scope", "_key"], "left").withColumn("name", F.coalesce("_new", "name")).select(*nodes.columns).dropDuplicates(["scope", "name"])
    for end in ("source", "target"):
        edges = edges.withColumn("_key", name_key(F.col(end))).join(mapping, ["scope", "_key"], "left").withColumn(end, F.coalesce("_new", end)).drop("_key", "_new")
    return named, edges.filter("source <> target").dropDuplicates()


def _met(rows: DataFrame, own: str, other: str, sizes: DataFrame) -> DataFrame:
    """rows of a scope in hash blocks `own`, repeated for every block `other` of the other side."""
    return rows.join(sizes, "scope").withColumns({own: F.pmod(F.xxhash64("id"), F.col(f"_n{own}")).cast("int"), other: F.explode(F.sequence(F.lit(0), F.col(f"_n{other}") - 1))}).drop("_n_i", "_n_j")


def partners(queries: DataFrame, rows: DataFrame, columns: list[str], score: Callable[[tuple, tuple], float | tuple[float, str] | None], k: int, per_block: int = 2_000) -> DataFrame:
    """(query, rank, partner, score, reason): for each query its k best rows of its own scope.

    queries and rows: scope, id and the columns that score gets as tuples; a score of None is no partner,
    and a score may come with a reason. Ties go to the smaller id; a row is no partner of its own id.
    Rows with a null scope are in none. Both sides of a scope are cut into hash blocks of about
    per_block rows, and each pair of blocks meets in one task, which keeps k rows a query: nothing
    passes through the driver, and a scope of any size is spread.
    """
    kind = rows.schema["id"].dataType.simpleString()
    wanted = ["scope", "id", *columns]
    asked, all_rows = (side.select(*wanted).filter(F.col("scope").isNotNull()) for side in (queries, rows))
    blocks = lambda side, name: side.groupBy("scope").agg(F.ceil(F.count(F.lit(1)) / per_block).cast("int").alias(name))
    sizes = blocks(asked, "_n_i").join(blocks(all_rows, "_n_j"), "scope")

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        own = list(right[[f"r_{c}" for c in wanted[1:]]].itertuples(index=False, name=None))
        for q in left[wanted[1:]].itertuples(index=False, name=None):
            held = []
            for row in own:
                if q[0] != row[0] and (value := score(q[1:], row[1:])) is not None:
                    value, reason = value if isinstance(value, tuple) else (value, None)
                    held.append((-value, row[0], reason))
            out += [(q[0], i, -v, reason) for v, i, reason in nsmallest(k, held, key=lambda h: h[:2])]
        return pd.DataFrame(out, columns=["query", "partner", "score", "reason"])

    # other names on the right, as both sides may come from one table
    right = _met(all_rows, "_j", "_i", sizes)
    right = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    met = _met(asked, "_i", "_j", sizes).groupBy("scope", "_i", "_j").cogroup(right.groupBy("r_scope", "r__i", "r__j"))
    made = met.applyInPandas(best, f"query {kind}, partner {kind}, score double, reason string")
    found = made.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("partner").alias("p"), "reason"))), 1, k).alias("_b"))
    return found.select("query", F.posexplode("_b").alias("rank", "_x")).select("query", (F.col("rank") + 1).alias("rank"), F.col("_x.p").alias("partner"), (-F.col("_x.s")).alias("score"), "_x.reason")


def reasons_for(least: float) -> Callable[[tuple, tuple], tuple[float, str] | None]:
    """The cosine of two nodes with the reasons to ask about their relation, None for no reason. For
    partners() over (own, vector, section, name, body, related); related ids are no partners."""

    def score(a: tuple, b: tuple) -> tuple[float, str] | None:
        if a[5] is not None and b[0] in set(a[5]):
            return None
        value = cosine_of(a[1], b[1])
        told = []
        if mentions(a[3] or "", b[4] or "") or mentions(b[3] or "", a[4] or ""):
            told.append("explicit_term_mention")
        if a[2] is not None and a[2] == b[2]:
            told.append("same_section_gap")
        if value >= least:
            told.append("semantic_similarity")
        return (value, ",".join(told)) if told else None

    return score


def global_candidates(queries: DataFrame, nodes: DataFrame, edges: DataFrame, top_k: int = 1, least: float = 0.78) -> DataFrame:
    """(left, right, score, reasons): pairs of nodes worth asking about, the smaller id left, each once.

    nodes: scope (a chapter), section, id, name (normalised), body, vector; queries: those of them that
    are asked for. edges: source, target (ids); pairs that have one are left out. A query's top_k closest
    of its chapter count if they are close, in one section, or one mentions the other; besides, of each
    section that has a query the pair with the most contrast (see contrast; ties to the smaller ids).
    """
    both = edges.select(F.col("source").alias("id"), F.col("target").alias("_o")).unionByName(edges.select(F.col("target").alias("id"), F.col("source").alias("_o")))
    place = nodes.select("id", "scope")
    near = both.filter("id is not null and _o is not null").distinct().join(place, "id").join(place.withColumnsRenamed({"id": "_o", "scope": "_s"}), "_o").filter("scope = _s")
    related = near.groupBy("id").agg(F.collect_set("_o").alias("related"))
    full = nodes.join(related, "id", "left").withColumn("own", F.col("id"))
    columns = ["own", "vector", "section", "name", "body", "related"]
    asked = full.join(queries.select("id"), "id", "left_semi")
    close = partners(asked, full, columns, reasons_for(least), top_k).select("query", "partner", "score", F.split("reason", ",").alias("reasons"))

    def apart(a: tuple, b: tuple) -> float | None:
        return None if a[2] is not None and b[0] in set(a[2]) or a[0] > b[0] else contrast((a[1],), (b[1],))

    inside = full.join(asked.select("section").distinct(), "section", "left_semi").select(F.col("section").alias("scope"), "id", "own", "name", "related")
    each = partners(inside, inside, ["own", "name", "related"], apart, 1).join(inside.select(F.col("id").alias("query"), F.col("scope").alias("section")), "query")
    best = each.groupBy("section").agg(F.min_by(F.struct("query", "partner"), F.struct(-F.col("score"), "query", "partner")).alias("_p")).select("_p.*")
    vectors = full.select("id", "vector")
    cosines = best.join(vectors.withColumnsRenamed({"id": "query", "vector": "_v"}), "query").join(vectors.withColumnsRenamed({"id": "partner", "vector": "_w"}), "partner")
    contrasts = cosines.select("query", "partner", cosine(F.col("_v"), F.col("_w")).alias("score"), F.array(F.lit("same_section_contrast")).alias("reasons"))
    rows = close.unionByName(contrasts).select(F.least("query", "partner").alias("left"), F.greatest("query", "partner").alias("right"), "score", "reasons")
    return rows.groupBy("left", "right").agg(F.max("score").alias("score"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("reasons")))), ",").alias("reasons"))


def cosine_of(a: list[float] | None, b: list[float] | None) -> float:
    if a is None or b is None or len(a) != len(b):
        return 0.0
    lengths = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b)) / lengths if lengths else 0.0


def mentions(name: str, text: str) -> bool:
    """Whether a run of two to four letters of the name, general terms aside, occurs in the text."""
    plain = "".join(c for c in name if c.isalnum() or c == "_")
    return any(plain[i : i + n] in text for n in (2, 3, 4) for i in range(len(plain) - n + 1) if plain[i : i + n] not in GENERAL)


def contrast(a: tuple, b: tuple) -> float | None:
    """Name similarity with up to 0.6 for a common ending; none below 0.45. For partners() over (name,)."""
    x, y = a[0] or "", b[0] or ""
    ratio = SequenceMatcher(None, x, y).ratio()
    if ratio < 0.45:
        return None
    shared = 0
    while shared < min(len(x), len(y)) and x[-1 - shared] == y[-1 - shared]:
        shared += 1
    return ratio + min(0.6, 0.2 * shared)


def closeness(least: float) -> Callable[[tuple, tuple], float | None]:
    """Cosine of close vectors, or of any that share a section or mention each other. For partners()
    over (vector, section, name, text)."""

    def score(a: tuple, b: tuple) -> float | None:
        value = cosine_of(a[0], b[0])
        same = a[1] is not None and a[1] == b[1]
        if value >= least or same or mentions(a[2] or "", b[3] or "") or mentions(b[2] or "", a[3] or ""):
            return value
        return None

    return score
