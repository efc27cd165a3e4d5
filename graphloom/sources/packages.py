"""Document packages as tables: joins of manifest, outline and provenance, and their validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.keys import clean_key
from graphloom.operators.hierarchy import hierarchy


def read_package(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """manifest (contents), outline and provenance rows of one package folder."""
    manifest = spark.read.json(f"{folder}/manifest.json", multiLine=True)
    package = F.col("document.id").alias("package_id")
    contents = manifest.select(package, F.explode("contents").alias("_c")).select("package_id", "_c.*")
    contents = contents.withColumnsRenamed({"id": "content_id", "path": "content_path", "order": "sort_order", "extract": "extract_flag"})
    outline = spark.read.json(f"{folder}/outline.json", multiLine=True).select(F.explode("nodes").alias("_n")).select("_n.*")
    name = manifest.select(package).first()["package_id"]
    provenance = spark.read.json(f"{folder}/provenance.jsonl")
    return {
        "contents": contents,
        "outlines": outline.withColumnRenamed("order", "sort_order").withColumn("package_id", F.lit(name)),
        "provenance": provenance.withColumn("package_id", F.lit(name)),
    }


def package_blocks(contents: DataFrame, outlines: DataFrame, provenance: DataFrame) -> DataFrame:
    """Contents to extract, each with its outline's path and top level and its references.

    contents: package_id, content_id, content_path, sort_order, outline_id, extract_flag. outlines: one
    current row per (package_id, id) with parent_id and title. provenance: package_id, content_id and
    source_refs. Contents without an outline entry have null paths; those without provenance no refs.
    """
    keys = outlines.select(clean_key(F.col("package_id")).alias("p"), clean_key(F.col("id")).alias("n"), clean_key(F.col("parent_id")).alias("q"), "title")
    tree = hierarchy(keys, "p", "n", "q")
    # titles of the path, in order
    steps = tree.select("p", "n", F.posexplode("path").alias("_at", "_on")).join(keys.select("p", F.col("n").alias("_on"), "title"), ["p", "_on"])
    titles = steps.groupBy("p", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "title"))), lambda s: s["title"]).alias("outline_path"))
    top = tree.select("p", "n", F.coalesce(F.get("path", F.lit(1)), F.col("root")).alias("top_level_id"))
    refs = provenance.select(clean_key(F.col("package_id")).alias("p"), clean_key(F.col("content_id")).alias("c"), F.explode("source_refs").alias("_r"))
    refs = refs.groupBy("p", "c").agg(F.array_sort(F.collect_set("_r.ref")).alias("source_refs"))
    rows = contents.filter("extract_flag").withColumns({"p": clean_key(F.col("package_id")), "c": clean_key(F.col("content_id")), "n": clean_key(F.col("outline_id"))})
    out = rows.join(titles, ["p", "n"], "left").join(top, ["p", "n"], "left").join(refs, ["p", "c"], "left")
    return out.select("package_id", "content_id", "content_path", "sort_order", "outline_id", "outline_path", "top_level_id", F.coalesce("source_refs", F.array().cast("array<string>")).alias("source_refs"))


def validate(contents: DataFrame, outlines: DataFrame) -> DataFrame:
    """(package_id, subject, violation) of packages: duplicate ids and orders, unsafe paths, unknown
    outline entries, parents that are missing or circular, several roots, wrong depths."""
    p = clean_key(F.col("package_id"))
    c = contents.select(p.alias("package_id"), clean_key(F.col("content_id")).alias("content_id"), "content_path", "sort_order", clean_key(F.col("outline_id")).alias("outline_id"), "sha256", "bytes")
    o = outlines.select(p.alias("package_id"), clean_key(F.col("id")).alias("id"), clean_key(F.col("parent_id")).alias("parent_id"), "depth")

    def twice(rows: DataFrame, key: str, violation: str) -> DataFrame:
        many = rows.groupBy("package_id", key).count().filter("count > 1")
        return many.select("package_id", F.col(key).cast("string").alias("subject"), F.lit(violation).alias("violation"))

    path = F.col("content_path")
    unsafe = path.isNull() | (F.trim(path) == "") | path.rlike(r"^[/\\]|^[A-Za-z]:|(^|[/\\])\.\.([/\\]|$)|\\")
    tree = hierarchy(o, "package_id", "id", "parent_id", paths=False)
    judged = o.join(tree, ["package_id", "id"])
    roots = tree.filter("steps = 0").groupBy("package_id").count().filter("count > 1")
    found = [
        twice(c, "content_id", "duplicate content id"),
        twice(c, "sort_order", "duplicate order"),
        twice(c, "content_path", "duplicate path"),
        twice(o, "id", "duplicate outline id"),
        c.filter(unsafe).select("package_id", F.col("content_id").alias("subject"), F.lit("unsafe path").alias("violation")),
        c.filter(~F.coalesce(F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False))).select("package_id", F.col("content_id").alias("subject"), F.lit("bad digest").alias("violation")),
        c.filter("outline_id is not null").join(o.select("package_id", F.col("id").alias("outline_id")), ["package_id", "outline_id"], "left_anti").select("package_id", F.col("content_id").alias("subject"), F.lit("unknown outline entry").alias("violation")),
        judged.filter("status <> 'ok'").select("package_id", F.col("id").alias("subject"), F.concat(F.lit("outline "), F.col("status")).alias("violation")),
        judged.filter("status = 'ok' and depth <> steps").select("package_id", F.col("id").alias("subject"), F.lit("wrong depth").alias("violation")),
        roots.select("package_id", F.col("count").cast("string").alias("subject"), F.lit("several roots").alias("violation")),
    ]
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def verify_files(files: DataFrame, contents: DataFrame) -> DataFrame:
    """(content_path, state): ok, missing, wrong size or wrong digest, of each content against the files
    (content_path, content as binary)."""
    seen = files.select("content_path", F.sha2("content", 256).alias("_d"), F.length("content").alias("_n"))
    state = F.when(F.col("_d").isNull(), "missing").when(F.col("_n") != F.col("bytes"), "wrong size").when(F.col("_d") != F.col("sha256"), "wrong digest").otherwise("ok")
    return contents.join(seen, "content_path", "left").select("content_path", state.alias("state"))
