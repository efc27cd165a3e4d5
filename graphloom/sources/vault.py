"""Sinks: Markdown notes of a graph, and published artifacts with a manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import file_stem, wikilink, yaml_scalar
from graphloom.session import cut_lineage


def note_stems(nodes: DataFrame, key: str, title: str, reserved: tuple[str, ...] = ("index",)) -> DataFrame:
    """(key, title, stem): a file name per node, no two alike in any letter case.

    Of nodes with one stem the first by key keeps it; the others get ` (2)`, ` (3)` and so on. Where
    such a name is itself taken, numbers go on in further rounds. Reserved names are taken from the start.
    """
    base = nodes.select(key, F.coalesce(F.col(title), F.col(key).cast("string")).alias("title"))
    base = base.withColumns({"_base": file_stem(F.col("title"), "node"), "_try": F.lit(1)})
    taken = nodes.sparkSession.createDataFrame([(r.lower(),) for r in reserved], "_low string")
    settled = None
    todo = cut_lineage(base)
    while todo.take(1):
        stem = F.when(F.col("_try") == 1, F.col("_base")).otherwise(F.concat("_base", F.lit(" ("), F.col("_try").cast("string"), F.lit(")")))
        named = todo.withColumn("stem", stem).withColumn("_low", F.lower("stem"))
        free = named.join(taken, "_low", "left_anti")
        first = free.groupBy("_low").agg(F.min(F.struct("_try", key)).alias("_f"))
        won = cut_lineage(free.join(first, "_low").filter(F.struct("_try", key) == F.col("_f")).select(key, "title", "stem", "_low"))
        settled = won if settled is None else cut_lineage(settled.unionByName(won))
        taken = cut_lineage(taken.unionByName(won.select("_low")))
        left = todo.join(won.select(key), key, "left_anti")
        # the next numbers, by rank among those of one stem that are still without a name
        ranked = left.withColumn("_r", F.row_number().over(Window.partitionBy(F.lower("_base")).orderBy("_try", key)))
        todo = cut_lineage(ranked.withColumn("_try", F.col("_try") + F.col("_r")).drop("_r"))
    return (settled if settled is not None else base.limit(0).withColumn("stem", F.col("_base"))).select(key, "title", "stem")


def notes(nodes: DataFrame, edges: DataFrame, key: str, title: str, properties: list[str], label: str = "edge_type") -> DataFrame:
    """(path, content): a Markdown note per node with its properties and its links to others.

    edges: source and target are keys. Edges with an unknown end are left out.
    """
    stems = cut_lineage(note_stems(nodes, key, title))
    a = stems.select(F.col(key).alias("source"), F.col("stem").alias("_a"))
    b = stems.select(F.col(key).alias("target"), F.col("stem").alias("_b"), F.col("title").alias("_t"))
    lines = edges.join(a, "source").join(b, "target")
    line = F.concat(F.lit("- "), F.coalesce(F.col(label), F.lit("related")), F.lit(": "), wikilink(F.col("_b"), F.col("_t")))
    linked = lines.select(F.col("source").alias(key), line.alias("_l")).groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("_l")), "\n").alias("_links"))
    front = F.concat_ws("\n", F.lit("---"), *[F.concat(F.lit(f"{p}: "), yaml_scalar(F.col(p).cast("string"))) for p in properties], F.lit("---"))
    rows = nodes.withColumn("_front", front).select(key, "_front").join(stems, key).join(linked, key, "left")
    body = F.concat_ws("\n\n", "_front", F.concat(F.lit("# "), F.col("title")), F.when(F.col("_links").isNotNull(), F.concat(F.lit("## Relationships\n\n"), F.col("_links"))))
    return rows.select(F.concat("stem", F.lit(".md")).alias("path"), body.alias("content"))


def index_page(nodes: DataFrame, key: str, title: str, group: str) -> DataFrame:
    """(path, content) of index.md: links by group, groups and titles in order. Built per group first."""
    stems = note_stems(nodes, key, title)
    rows = stems.join(nodes.select(key, F.coalesce(F.col(group), F.lit("Notes")).alias("_g")), key)
    entry = F.struct(F.lower("title").alias("o"), F.concat(F.lit("- "), wikilink(F.col("stem"), F.col("title"))).alias("l"))
    parts = rows.groupBy("_g").agg(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["l"]), "\n").alias("_p"))
    whole = parts.agg(F.array_sort(F.collect_list(F.struct("_g", "_p"))).alias("_all"))
    text = F.array_join(F.transform("_all", lambda g: F.concat(F.lit("## "), g["_g"], F.lit("\n\n"), g["_p"])), "\n\n")
    return whole.select(F.lit("index.md").alias("path"), F.concat(F.lit("# Index\n\n"), text).alias("content"))


def manifest(files: DataFrame) -> DataFrame:
    """(path, bytes, sha256) of files given as path and content."""
    raw = F.encode(F.col("content"), "UTF-8")
    return files.select("path", F.length(raw).cast("bigint").alias("bytes"), F.sha2(raw, 256).alias("sha256"))


def publish(files: DataFrame, folder: str) -> None:
    """Files as a table, then their manifest; Spark's commit writes _SUCCESS last."""
    files.write.mode("overwrite").parquet(f"{folder}/files")
    manifest(files).write.mode("overwrite").parquet(f"{folder}/manifest")


def verify(spark, folder: str) -> DataFrame:
    """(path, state) of every published file against the manifest: ok, missing, changed or extra."""
    kept = spark.read.parquet(f"{folder}/manifest")
    now = manifest(spark.read.parquet(f"{folder}/files")).withColumnsRenamed({"bytes": "_n", "sha256": "_d"})
    state = F.when(F.col("_d").isNull(), "missing").when(F.col("sha256").isNull(), "extra").when(F.col("sha256") != F.col("_d"), "changed").otherwise("ok")
    return kept.join(now, "path", "full").select("path", state.alias("state"))


def write_files(files: DataFrame, folder: str) -> None:
    """Each row as a file of its own under a folder that all executors share."""

    def write(rows) -> None:
        import os

        for row in rows:
            target = os.path.join(folder, row["path"])
            os.makedirs(os.path.dirname(target), exist_ok=True)
            part = f"{target}.part"
            with open(part, "w", encoding="utf-8") as out:
                out.write(row["content"])
            os.replace(part, target)

    files.select("path", "content").foreachPartition(write)
