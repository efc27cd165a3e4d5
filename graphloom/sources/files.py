"""Texts and stored containers from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_texts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, text): each file whole."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_directory(spark: SparkSession, path: str, endings: tuple[str, ...] = (".txt", ".md")) -> DataFrame:
    """(directory, text): the texts of each directory under path as one document, joined in order of
    their names by blank lines. Files with other endings are left out."""
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    wanted = files.filter(F.lower(F.substring_index("path", "/", -1)).rlike("(" + "|".join(e.replace(".", "\\.") for e in endings) + ")$"))
    parts = wanted.withColumn("directory", F.regexp_replace("path", r"/[^/]*$", ""))
    joined = parts.groupBy("directory").agg(F.array_sort(F.collect_list(F.struct("path", "text"))).alias("_f"))
    return joined.select("directory", F.array_join(F.transform("_f", lambda f: f["text"]), "\n\n").alias("text"))


def dump(tables: dict[str, DataFrame], folder: str, metadata: dict[str, str], index: dict[str, DataFrame] | None = None) -> None:
    """Tables of a container as Parquet, its metadata as one JSON row, and its index tables."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{folder}/data/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([metadata]).coalesce(1).write.mode("overwrite").json(f"{folder}/metadata")
    for name, table in (index or {}).items():
        table.write.mode("overwrite").parquet(f"{folder}/index/{name}")


def load(spark: SparkSession, folder: str, names: list[str], index: bool = False) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """(tables, metadata) that dump wrote; index tables are named <name>.index."""
    tables = {n: spark.read.parquet(f"{folder}/data/{n}") for n in names}
    if index:
        tables |= {f"{n}.index": spark.read.parquet(f"{folder}/index/{n}") for n in names}
    return tables, spark.read.json(f"{folder}/metadata").first().asDict()
