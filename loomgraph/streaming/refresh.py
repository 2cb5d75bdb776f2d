"""Keeping a fingerprint table of sources up to date from a stream of files. An addition of this engine: the
batch form is plans.session; nothing here has event time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def watch(spark: SparkSession, root: str, pattern: str = "*.java") -> DataFrame:
    """(path, modified, hash) of files as they come."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return files.select("path", F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("hash"))


def refresh(stream: DataFrame, path: str, checkpoint: str, changed: Callable[[DataFrame], None] | None = None):
    """Folds the stream into generations of a table (path, hash) and tells `changed` which paths differ. A batch
    that is run again writes the same generation, so restarts change nothing."""

    def fold(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        latest = batch.groupBy("path").agg(F.max_by("hash", "modified").alias("hash"))
        before = spark.read.parquet(f"{path}/generation={epoch - 1}") if epoch else latest.limit(0)
        news = latest.join(before.withColumnRenamed("hash", "was"), "path", "left").where("was is null or was <> hash").select("path", "hash")
        kept = before.join(latest.select("path"), "path", "left_anti").select("path", "hash")
        kept.unionByName(latest).write.mode("overwrite").parquet(f"{path}/generation={epoch}")
        if changed is not None:
            changed(news)

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
