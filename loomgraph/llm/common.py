"""Helpers shared by the corpus operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: A word, by contract: a run of anything but space and the C0 white space.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: The same class for Java's regular expressions.
WORD_SQL = r"[^\x20\x09-\x0D]+"
#: White space by contract, for trimming.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: str.translate table that lower-cases A-Z only.
FOLD = {ord(u): low for u, low in zip(UPPER, LOWER, strict=True)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one is set only where none is configured (tests)."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


#: Spark's own setting by which a query's shuffle files go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, label: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: the lineage ends there and a lost
    executor costs no more than a re-read. The shuffle files of the write, which nothing needs once the table is
    there, go with it."""
    path, conf = f"{shared_dir(df.sparkSession)}/loomgraph-{label}-{uuid.uuid4().hex}", df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEANUP, before) if before is not None else conf.unset(CLEANUP)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.__dict__["_cut_path"] = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes the table of cut(): only for one that nothing lazy reads any more."""
    path = df.__dict__.pop("_cut_path", None)
    if path is None:
        return
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).delete(where, True)


def crc_bucket(column: str, modulus: int) -> str:
    """SQL: crc32 of the id as text, modulo."""
    return f"crc32(cast(cast({column} as string) as binary)) % {modulus}"


def pieces(batch, text_col: str, most_bytes: int = 4 << 20):
    """An Arrow batch in slices of about most_bytes of text (one row at least), so that what a Python
    worker holds at once depends on neither the batch nor the number of long texts in it."""
    import numpy as np
    import pyarrow.compute as pc

    n = batch.num_rows
    if n == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    start = 0
    while start < n:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most_bytes, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def mix64(x):
    """Splitmix64 over a numpy uint64 array."""
    import numpy as np

    with np.errstate(over="ignore"):
        x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def words_of(texts: list[str | None]):
    """(flat list of words, number of words of each text)."""
    import numpy as np

    found = [WORD.findall(t) if t else [] for t in texts]
    counts = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    return [w for ws in found for w in ws], counts


def word_codes(words: list[str]):
    """(codes of the words within this list, the distinct words in order of appearance). No hash is
    trusted: equal codes are equal words."""
    import numpy as np
    import pandas as pd

    if not words:
        return np.zeros(0, dtype=np.int64), []
    codes, distinct = pd.factorize(np.array(words, dtype=object))
    return codes, list(distinct)
