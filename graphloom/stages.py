"""Stages of a long run as tables that a later run takes up where their inputs are the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.functions.ids import fingerprint


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on whatever file system the path names."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def folders(spark: SparkSession, path: str) -> list[str]:
    """The names of the folders in a folder; none if it isn't there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in system.listStatus(place) if s.isDirectory()) if system.exists(place) else []


def stage(spark: SparkSession, folder: str, name: str, config: object, make: Callable[[], DataFrame]) -> DataFrame:
    """The table `name` of a run: read where an earlier run with an equal config finished it, else made
    and written. config is whatever the result depends on (options, the fingerprints of the stages
    before); its own fingerprint names the folder, so another config never reads another's table. A
    table counts as finished only with its _SUCCESS mark, so a run that was lost makes it again.
    """
    path = f"{folder}/{name}/{fingerprint(config)}"
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def document_format(spark: SparkSession, path: str) -> str:
    """What a path holds: `document-package` (a folder with a manifest), `docling-json` (a .json file) or
    a ValueError."""
    if exists(spark, f"{path}/manifest.json"):
        return "document-package"
    if path.lower().endswith(".json") and exists(spark, path):
        return "docling-json"
    raise ValueError(f"{path} is neither a document package nor a JSON document")
