import pytest
from pyspark.sql import functions as F

from graphloom import stages
from graphloom.operators import embedding, quality


def test_stages_resume_by_fingerprint(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(len(made))

    folder = str(tmp_path)
    assert stages.stage(spark, folder, "s", {"a": 1, "b": 2}, make).count() == 1
    assert stages.stage(spark, folder, "s", {"b": 2, "a": 1}, make).count() == 1 and len(made) == 1
    assert stages.stage(spark, folder, "s", {"a": 2}, make).count() == 2
    (tmp_path / "s" / stages.fingerprint({"a": 2}) / "_SUCCESS").unlink()
    assert stages.stage(spark, folder, "s", {"a": 2}, make).count() == 3


def test_formats(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "manifest.json").write_text("{}")
    (tmp_path / "d.JSON").write_text("{}")
    assert stages.document_format(spark, str(tmp_path / "p")) == "document-package" and stages.document_format(spark, str(tmp_path / "d.JSON")) == "docling-json"
    with pytest.raises(ValueError):
        stages.document_format(spark, str(tmp_path / "none.json"))


def test_embedding_isolates_bad_texts_and_averages_parts(spark):
    def model(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("no")
        return [[1.0] if "short" in t else [float(len(t)), 0.0] for t in texts]

    assert [e for _, e in embedding.embed_batch(["a", "bad", "b", "short"], model, 2)] == [None, "RuntimeError: no", None, "1 dimensions in place of 2"]
    df = spark.createDataFrame([(1, "aaaa"), (2, " "), (3, None), (4, "it is bad"), (5, "x" * 40 + "\n\n" + "y" * 20)], "id int, t string")
    good, bad = embedding.embed_texts(df, "id", "t", model, 2, most_tokens=10, per_batch=3)
    assert {r.id: list(r.vector) for r in good.collect()} == {1: [4.0, 0.0], 5: [30.0, 0.0]} and {r.id: r.error for r in bad.collect()} == {2: "blank text", 3: "blank text", 4: "RuntimeError: no"}
    zero, _ = embedding.embed_texts(df.filter("id = 2"), "id", "t", model, 2, blank="zero_vector")
    assert list(zero.first().vector) == [0.0, 0.0] and embedding.embed_texts(df.limit(0), "id", "t")[0].count() == 0
    with pytest.raises(ValueError):
        embedding.embed_texts(df, "id", "t", blank="drop")


def test_quarantine_policy(spark):
    df = spark.createDataFrame([("q", i, None if i == 3 else "n") for i in range(10)] + [("r", 0, None), ("r", 1, "n")], "request string, i int, name string")
    _, bad, _ = quality.quarantine(df, {"name": F.col("name").isNotNull()})
    rows, summary = quality.quarantine_report(bad, df, "nodes", ["name"], "request", "i")
    assert {(r.request, r.schema_path) for r in rows.collect()} == {("q", "nodes[3].name"), ("r", "nodes[0].name")}
    assert {tuple(r) for r in summary.collect()} == {("q", 9, 1, 0.1, "completed_with_rejections", False), ("r", 1, 1, 0.5, "failed", True)}
    assert quality.quarantine_report(bad, df, "nodes", ["name"], "request", "i", fail=True)[1].filter("failed").count() == 2
