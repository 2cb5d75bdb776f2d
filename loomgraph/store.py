"""Where intermediate tables are kept."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); a temporary one only where none is set, as in tests."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


def cut(df: DataFrame, label: str, by: tuple[str, ...] = ()) -> DataFrame:
    """df as a written table, read back: iterations don't pile up lineage, and what a lost executor held is
    read again rather than computed again. by: columns of few values; who asks for one value reads its rows only."""
    path = f"{shared_dir(df.sparkSession)}/loomgraph-{label}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path) if by else df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def is_empty(df: DataFrame) -> bool:
    return not df.limit(1).count()
