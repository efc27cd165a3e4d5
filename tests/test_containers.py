import json

import pytest
from pyspark.sql import functions as F

from graphloom.containers import Graph, KeyedSet, OrderedList, Record, graph_of_text
from graphloom.methods import METHODS
from graphloom.operators import extract
from graphloom.sources import docling, files, packages, vault
from graphloom.streaming import incremental
from graphloom.templates import catalogue, compile_template


def test_keyed_set(spark):
    make = lambda *r: spark.createDataFrame(list(r), "seq int, name string, note string")
    a = KeyedSet.of(make((1, "x", "one"), (2, "x", "two"), (3, "y", None), (4, None, "z")), "name")
    b = KeyedSet.of(make((1, "y", "b"), (2, "w", "b")), "name")
    assert {r.note for r in (a | b).items.collect()} == {"one", None, "b"} and "w" in (a | b) and "w" not in a
    assert (a & b).items.count() == 1 and (a - b).items.count() == 1 and (a ^ b).items.count() == 2
    assert a.add(make((9, "q", "n"))).items.count() == 3 and a.discard("x", "none").items.count() == 1
    assert a.relation(a)["equal"] and a.clear().items.count() == 0
    with pytest.raises(ValueError):
        a.search("x")
    found = a.build_index(["name", "note"]).search('{"name":"x","note":"one"}', 1)
    assert found.first().name == "x"
    assert "one" in a.build_index(["name"]).context("x", 1).first().context


def test_list_and_record(spark):
    items = OrderedList.of(spark.createDataFrame([(3,), (1,), (2,)], "v int"), F.col("v"))
    assert len(items) == 3 and [r.v for r in items.reverse().items.orderBy("pos").collect()] == [3, 2, 1]
    assert len(items + items) == 6 and items.position({"v": 2}) == 1 and len(items.pop()) == 2
    with pytest.raises(TypeError):
        items + OrderedList.of(spark.createDataFrame([("a",)], "w string"), F.col("w"))
    r = Record.of(spark.createDataFrame([("d", 1, "a", None), ("d", 2, None, ["t"]), ("e", 1, " ", [])], "doc string, seq int, name string, tags array<string>"), "doc")
    assert {x.doc: x.empty for x in r.is_empty().collect()} == {"d": False, "e": True}
    assert r.update(spark.createDataFrame([("d", 1, "new", None)], "doc string, seq int, name string, tags array<string>")).rows.filter("doc = 'd'").first().name == "new"


def test_graphs_prune_after_merging_and_key_by_time(spark):
    n = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "seq int, name string")
    e = spark.createDataFrame([(1, "a", "b", "r", "2020"), (2, "a", "b", "r", None), (3, "a", "x", "r", "2020"), (4, "a", "b", "r", "2020")], "seq int, source string, target string, edge_type string, time string")
    assert Graph.of(n, e).counts() == {"nodes": 2, "edges": 1, "indexed": 0}
    timed = Graph.of(n, e, time="time")
    assert {r._key for r in timed.edges.collect()} == {"a|r|b @ 2020", "a|r|b"}
    h = spark.createDataFrame([(1, ["b", "a"]), (2, ["a", "b"]), (3, ["a", "z"])], "seq int, members array<string>")
    assert METHODS["hyper_rag"].build(n, h).edges.count() == 1
    both = Graph.of(n, e) + Graph.of(spark.createDataFrame([(1, "x")], "seq int, name string"), e.limit(0))
    assert both.counts()["nodes"] == 3
    nodes, edges = Graph.of(n, e).build_index(["name"], ["source", "target"]).search("a", 1, 1)
    assert nodes.count() == 1 and edges.count() == 1
    with pytest.raises(ValueError):
        both.search("a", 0, 0)


def test_graph_of_text(spark):
    df = spark.createDataFrame([(1, "The Blue Whale meets the Red Fox."), (2, "The Blue Whale sings to the Red Fox.")], "doc int, text string")
    g = graph_of_text(spark, df, ["doc"], "text", extract.TERMS)
    assert g.counts()["nodes"] == 2 and g.counts()["edges"] == 1
    assert g.edges.first().description.startswith("The Blue Whale meets")


def test_templates(spark):
    cfg = {
        "name": {"en": "Course", "zh": "课程"},
        "type": "graph",
        "output": {"entities": {"fields": [{"name": "name", "type": "str"}, {"name": "n", "type": "int", "required": False}]}, "relations": {"fields": [{"name": "source"}, {"name": "target"}]}},
        "identifiers": {"entity_id": "name", "relation_id": "{source}|{target}", "relation_members": {"source": "source", "target": "target"}},
        "options": {"merge_strategy": "merge_field"},
    }
    t = compile_template(cfg, "zh")
    assert t.name == "课程" and t.schemas["nodes"].simpleString() == "struct<name:string,n:bigint>" and t.strategy == "merge_field" and t.members == ("source", "target")
    for bad in ({"type": "heap"}, {"identifiers": {"entity_id": "{nope}"}}, {"output": {"entities": {"fields": [{"name": "x", "type": "date"}]}}}):
        with pytest.raises(ValueError):
            compile_template(cfg | bad)
    rows = spark.createDataFrame([("a", "Finance facts", "set", ["x"], ["en"])], "name string, description string, kind string, tags array<string>, languages array<string>")
    assert catalogue(rows, "finance", "set", "x", "en").count() == 1 and catalogue(rows, tag="y").count() == 0


def _document():
    texts = [
        {"self_ref": "#/texts/0", "label": "section_header", "text": "1. Start", "level": 1},
        {"self_ref": "#/texts/1", "label": "text", "text": "Body one", "prov": [{"page_no": 2}]},
        {"self_ref": "#/texts/2", "label": "page_footer", "text": "page 2"},
        {"self_ref": "#/texts/3", "label": "section_header", "text": "Detail", "level": 2},
        {"self_ref": "#/texts/4", "label": "text", "text": "Body two"},
    ]
    table = {"label": "table", "data": {"table_cells": [{"start_row_offset_idx": 1, "start_col_offset_idx": 0, "text": "c"}, {"start_row_offset_idx": 0, "start_col_offset_idx": 1, "text": "b"}, {"start_row_offset_idx": 0, "start_col_offset_idx": 0, "text": "a"}]}}
    return {"name": "doc", "body": {"children": [{"$ref": f"#/texts/{i}"} for i in range(5)] + [{"$ref": "#/tables/0"}, {"$ref": "#/texts/77"}]}, "texts": texts, "tables": [table]}


def test_structured_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(_document()))
    (tmp_path / "b.json").write_text("[1]")
    got = docling.read_documents(spark, str(tmp_path)).cache()
    assert {r.path[-6:]: r.error for r in got.collect()} == {"a.json": None, "b.json": "it has no body"}
    outline = docling.outline_of(got).orderBy("sort_order").collect()
    assert [(r.title, r.level) for r in outline] == [("doc", 0), ("1. Start", 1), ("Detail", 2)] and outline[2].parent_id == outline[1].id
    blocks = docling.blocks_of(got).orderBy("block_no").collect()
    assert [b.text for b in blocks] == ["Body one", "Body two", "a | b\nc"] and blocks[0].page_no == 2 and blocks[1].outline_path == ["1. Start", "Detail"]
    assert blocks[0].bbox is None and docling.levels([docling.Item(f"#{i}", "title", x, 1, None, None) for i, x in enumerate(["第一章 甲", "1.1 a", "b", "1.2.1 c", "2 d", "e", "f", "g", "h", "i", "Figure 3 x", "ends:"])]) == [1, 2, 3, 3, 1, 2, 2, 2, 2, 2, 0, 0]
    tree = {"body": {"children": [{"$ref": "#/tables/0"}, {"$ref": "own"}]}, "texts": [{"text": "Caption", "label": "caption"}, {"self_ref": "own", "text": "by self_ref", "prov": [{"page_no": 1, "bbox": {"l": 1, "t": 2.5}}]}], "tables": [{"label": "table", "captions": [{"$ref": "#/texts/0"}], "data": {"table_cells": [{"text": "a"}]}}]}
    assert [(b["text"], b["bbox"]) for b in docling.parse(tree)[1]] == [("Caption", None), ("a", None), ("by self_ref", {"l": 1.0, "t": 2.5})]
    assert docling.pointer({"a/b": [1, {"~": 2}]}, "#/a~1b/1/~0") == 2 and docling.pointer({}, "x") is None


def test_files_and_containers(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "b.md").write_text("two")
    (tmp_path / "in" / "a.txt").write_text("one")
    (tmp_path / "in" / "c.csv").write_text("no")
    assert files.read_directory(spark, str(tmp_path / "in")).first().text == "one\n\ntwo"
    assert files.read_texts(spark, str(tmp_path / "in" / "a.txt")).first().text == "one"
    files.dump({"nodes": spark.range(3)}, str(tmp_path / "box"), {"kind": "set"})
    tables, meta = files.load(spark, str(tmp_path / "box"), ["nodes"])
    assert tables["nodes"].count() == 3 and meta == {"kind": "set"}


def test_package_reader_and_validation(spark, tmp_path):
    folder = tmp_path / "p"
    folder.mkdir()
    (folder / "manifest.json").write_text(json.dumps({"document": {"id": "d"}, "contents": [{"id": "c1", "path": "content/1.md", "order": 1, "outline_id": "s", "extract": True, "sha256": "0" * 64, "bytes": 1}, {"id": "c2", "path": "../x", "order": 1, "outline_id": "zz", "extract": True, "sha256": "bad", "bytes": 1}]}))
    (folder / "outline.json").write_text(json.dumps({"nodes": [{"id": "r", "title": "R", "depth": 0, "parent_id": None, "order": 0}, {"id": "s", "title": "S", "depth": 3, "parent_id": "r", "order": 1}]}))
    (folder / "provenance.jsonl").write_text(json.dumps({"content_id": "c1", "source_refs": [{"ref": "content/1.md#L1-L2"}]}))
    got = packages.read_package(spark, str(folder))
    blocks = {r.content_id: r for r in packages.package_blocks(got["contents"], got["outlines"], got["provenance"]).collect()}
    assert blocks["c1"].outline_path == ["R", "S"] and blocks["c1"].top_level_id == "s" and blocks["c1"].source_refs == ["content/1.md#L1-L2"] and blocks["c2"].outline_path is None
    found = {(r.subject, r.violation) for r in packages.validate(got["contents"], got["outlines"]).collect()}
    assert found == {("1", "duplicate order"), ("c2", "unsafe path"), ("c2", "bad digest"), ("c2", "unknown outline entry"), ("s", "wrong depth")}


def test_vault(spark, tmp_path):
    n = spark.createDataFrame([(1, "Index", "a"), (2, "index", "a"), (3, "x/y", None), (4, "x y", "b"), (5, "X Y (2)", "b"), (6, None, "b")], "id int, name string, kind string")
    stems = {r.id: r.stem for r in vault.note_stems(n, "id", "name").collect()}
    assert len({s.lower() for s in stems.values()}) == 6 and "index" not in {s.lower() for s in stems.values()} and stems[3] == "x y"
    e = spark.createDataFrame([(3, 4, "uses"), (3, 99, "uses")], "source int, target int, edge_type string")
    made = vault.notes(n, e, "id", "name", ["kind"])
    note = {r.path: r.content for r in made.collect()}["x y.md"]
    assert note.startswith("---\nkind: null\n---\n\n# x/y\n\n## Relationships\n\n- uses: [[")
    assert "## a" in vault.index_page(n, "id", "name", "kind").first().content
    vault.publish(made, str(tmp_path / "v"))
    assert {r.state for r in vault.verify(spark, str(tmp_path / "v")).collect()} == {"ok"}
    vault.write_files(made, str(tmp_path / "notes"))
    assert len(list((tmp_path / "notes").iterdir())) == 6


def test_streaming_upsert_counts_each_row_once(spark, tmp_path):
    inbox, table = tmp_path / "in", str(tmp_path / "table")
    inbox.mkdir()
    put = lambda name, *r: (inbox / name).write_text("\n".join(json.dumps(dict(zip(("k", "at", "v"), x))) for x in r))
    run = lambda: incremental.upsert_stream(incremental.event_log(spark, str(inbox), "k string, at int, v string"), table, str(tmp_path / "cp"), ["k"], ["at"]).awaitTermination()
    put("1.json", ("a", 1, "x"), ("b", 1, "y"))
    run()
    put("2.json", ("a", 2, "z"), ("c", 1, "w"))
    run()
    run()
    assert {(r.k, r.v) for r in incremental.current(spark, table).collect()} == {("a", "z"), ("b", "y"), ("c", "w")}
    assert incremental.current(spark, str(tmp_path / "none")) is None


def test_windows(spark):
    df = spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:50:00", "a"), ("2024-01-01 01:10:00", "a")], "t string, k string").withColumn("t", F.to_timestamp("t"))
    assert sorted(r.n for r in incremental.windowed_counts(df, "t", "1 minute", "1 hour", ["k"]).collect()) == [1, 2]
