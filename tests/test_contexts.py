"""Contexts of source blocks: what is moved for them, and that they are whole."""

import random
import string

from pyspark.sql import functions as F

from graphloom.operators import prompts
from graphloom.operators.hierarchy import hierarchy


def _shuffled(spark) -> int:
    """Bytes that this session's stages have written to shuffles so far."""
    context = spark.sparkContext
    jvm = context._jvm
    context._jsc.sc().listenerBus().waitUntilEmpty()
    stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_chunk_contexts_moves_an_outline_once_and_not_for_every_entry(spark, tmp_path):
    from graphloom.plans.documents import chunk_contexts

    rng = random.Random(3)
    word = lambda n: "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(n))
    rows = [("p", "root", "Root", None, 0)] + [("p", f"n{i}", word(25), "root" if i < 5 else f"n{i % 5}", i + 1) for i in range(140)]
    outlines = spark.createDataFrame(rows, "package_id string, id string, title string, parent_id string, sort_order int")
    outlines.withColumns({"depth": F.lit(None).cast("int"), **{c: F.lit(None).cast("timestamp") for c in ("created_at", "updated_at", "deleted_at")}}).write.parquet(f"{tmp_path}/outlines.parquet")
    blocks = [(i, "p", "text", f"n{i}", ["x"]) for i in range(3)] * 2 + [(9, "p", "text", " ROOT ", None), (10, "p", "text", "unknown", None)]
    spark.createDataFrame(blocks, "block_id long, package_id string, text string, outline_id string, outline_path array<string>").write.parquet(f"{tmp_path}/source_blocks.parquet")
    before = _shuffled(spark)
    # else joins as small as these are broadcasts
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    got = {r.block_id: r for r in chunk_contexts(spark, str(tmp_path)).collect()}
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved = _shuffled(spark) - before
    assert {k: r.context_level for k, r in got.items()} == {0: "terms", 1: "terms", 2: "terms", 9: "full", 10: "terms"}
    # 51 KB when this was written; texts for each of 141 entries took 313 KB
    assert moved < 150_000, moved


def test_contexts_told_from_counts_are_those_of_the_texts(spark):
    rng = random.Random(5)
    titles = ["Flow", "阀门管理", "a\n", None, "x - [n1] Flow", "", "管 b" * 9]
    rows = [("s", "n0", None, "Root", 0)] + [("s", f"n{i}", f"n{rng.randrange(max(0, i - 6), i)}" if i != 7 else "gone", rng.choice(titles), rng.randrange(12)) for i in range(1, 25)]
    rows += [("t", "n0", None, "Only", 0), ("u", "c1", "c2", "C", 1), ("u", "c2", "c1", "D", 2)]
    tree_rows = spark.createDataFrame(rows, "scope string, id string, parent string, title string, sort_order int")
    tree = hierarchy(tree_rows, "scope", "id", "parent", paths=False, carry=["title", "sort_order"], branches=True)
    entries = prompts.outline_entries(tree).cache()
    chunks = [(i, sc, rng.choice([f"n{rng.randrange(26)}", "n0", "c1", None]), rng.choice([None, "", "short", "长" * 30, "long " * 40]), rng.choice([None, [], ["t1", "术语"], [f"term {i}" for i in range(40)]])) for i, sc in enumerate(rng.choice(["s", "s", "s", "t", "u", None]) for _ in range(150))]
    chunks = spark.createDataFrame(chunks, "n int, scope string, id string, text string, terms array<string>").withColumn("document", F.col("scope"))
    outlines = prompts.outline_contexts(entries).withColumn("_known", F.lit(True))
    seen = set()
    for window in (60, 290, 5000):
        joined = chunks.join(outlines, ["scope", "id"], "left")
        for c in ("full_outline", "compact_outline"):
            joined = joined.withColumn(c, F.when(F.col("_known").isNull(), "").otherwise(F.col(c)))
        want = {r.n: (r.context_level, r.context) for r in prompts.fit_context(joined, window, 20).collect()}
        got = {r.n: (r.context_level, r.context) for r in prompts.fit_outlines(chunks, entries, window, 20).collect()}
        assert got == want and len(got) == 150
        seen |= {level for level, _ in got.values()}
    assert seen == {"terms", "compact", "full", "none"}
    entries.unpersist()


def test_a_long_chapter_is_never_left_out_of_a_context(spark):
    rows = [("s", "r", None, "R", 0), ("s", "a", "r", "A", 1), ("s", "b", "r", "B", 2)] + [("s", f"a{i}", "a", "long title " * 5, 3 + i) for i in range(20)]
    tree_rows = spark.createDataFrame(rows, "scope string, id string, parent string, title string, sort_order int")
    entries = prompts.outline_entries(hierarchy(tree_rows, "scope", "id", "parent", paths=False, carry=["title", "sort_order"], branches=True))
    # level 1 alone would fit, but not the chapter that holds a3
    assert {r.id: r.compact_outline for r in prompts.outline_contexts(entries, 400).filter("id in ('a3', 'b')").collect()} == {"a3": None, "b": "- [a] A\n- [b] B <CURRENT>"}
    chunks = spark.createDataFrame([("s", "a3", "x", ["t"]), ("s", "b", "x", ["t"])], "scope string, id string, text string, terms array<string>")
    assert {r.id: r.context_level for r in prompts.fit_outlines(chunks, entries, 120, 20).collect()} == {"a3": "none", "b": "terms"}


def test_branches_without_paths(spark):
    rng = random.Random(7)
    rows = [(f"s{i % 3}", str(i), rng.choice([None, "gone", *map(str, range(i % 3, i, 3))]) if i > 40 else (str(i - 3) if i > 2 else None)) for i in range(120)]
    rows += [("s0", "x", "y"), ("s0", "y", "x"), ("s0", "z", "x")]
    nodes = spark.createDataFrame(rows, "scope string, id string, parent string")
    want = {(r.scope, r.id): r.branch for r in hierarchy(nodes, "scope", "id", "parent").select("scope", "id", F.get("path", F.lit(1)).alias("branch")).collect()}
    for co_locate in (1000, 0):
        assert {(r.scope, r.id): r.branch for r in hierarchy(nodes, "scope", "id", "parent", paths=False, branches=True, co_locate=co_locate).collect()} == want
