"""Incremental merging: streams of rows into a keyed table, and an event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.operators.merge import keyed_merge
from graphloom.stages import exists, folders


def _versions(spark: SparkSession, folder: str) -> dict[int, int]:
    """The latest finished version of each bucket."""
    found: dict[int, int] = {}
    for bucket in folders(spark, folder):
        if bucket.startswith("b="):
            done = [int(v[2:]) for v in folders(spark, f"{folder}/{bucket}") if v.startswith("v=") and exists(spark, f"{folder}/{bucket}/{v}/_SUCCESS")]
            if done:
                found[int(bucket[2:])] = max(done)
    return found


def current(spark: SparkSession, folder: str) -> DataFrame | None:
    """The latest finished state of a table written by upsert_stream, or None."""
    found = _versions(spark, folder)
    return spark.read.parquet(*[f"{folder}/b={b}/v={v}" for b, v in sorted(found.items())]) if found else None


def upsert_stream(stream: DataFrame, folder: str, checkpoint: str, key: list[str], seq: list[str], strategy: str = "keep_incoming", buckets: int = 64) -> StreamingQuery:
    """Merges every micro-batch of the stream into a table in a shared folder on any file system.

    The table is cut into buckets by a hash of the key; a batch rewrites only the buckets that it has
    keys of, one new version each, and the version before the last is removed. A batch that is run again
    after a failure writes the same versions from those before it, so each row counts once. Runs until
    the available input is used up. buckets must stay the same for a table.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        mine = batch.withColumn("_b", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")).persist()
        touched = [r[0] for r in mine.select("_b").distinct().collect()]
        for bucket in touched:
            base = f"{folder}/b={bucket}"
            earlier = sorted(int(v[2:]) for v in folders(spark, base) if v.startswith("v=") and int(v[2:]) < number and exists(spark, f"{base}/{v}/_SUCCESS"))
            both = mine.filter(F.col("_b") == bucket).drop("_b")
            if earlier:
                both = spark.read.parquet(f"{base}/v={earlier[-1]}").unionByName(both)
            keyed_merge(both, key, seq, strategy).write.mode("overwrite").parquet(f"{base}/v={number}")
            for old in earlier[:-1]:
                place = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/v={old}")
                place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        mine.unpersist()

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_log(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A stream of an append-only log of JSON lines."""
    return spark.readStream.schema(schema).json(folder)


def windowed_counts(events: DataFrame, time: str, late: str, size: str, by: list[str]) -> DataFrame:
    """Counts per window and group; rows later than the watermark are left out. Also for batches."""
    return events.withWatermark(time, late).groupBy(F.window(time, size), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *by, "n")


def running_latest(events: DataFrame, key: str, time: str, fields: list[str]) -> DataFrame:
    """The latest fields per key as a stream in update mode, by a combining aggregate (no own state code)."""
    return events.groupBy(key).agg(F.max_by(F.struct(*fields), F.col(time)).alias("_x"), F.max(time).alias(time)).select(key, time, "_x.*")
