"""Line dedup: explode normalised lines, hash them, count the documents of each hash, drop the lines over
the threshold and put the rest together by position. DataFrame functions only.

Nothing is collected and no text leaves its row before the last join: the counting shuffles carry 128-bit
hashes, by line and document first and then with map-side sums by line, the hits carry positions, and
the text is shuffled once, against the positions of its own document. Rows are told apart by (doc_id, hash
of the text): equal rows lose equal lines, so repeated rows need no id of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import BLANKS, LOWER, UPPER, cut, table


def line_key(line: Column) -> Column:
    """The line without white space at its ends, with A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """docs with its columns as they were, text_col without the frequent lines, and n_lines (before dropping)
    and n_dropped, all within struct columns `row` (as given), `kept_text`, `n_lines`, `n_dropped`.

    A line goes if its key has min_chars code points or more and is in min_docs documents or more. Rows of one id
    are one document, and so are the rows without an id, for counting only: each row keeps its own text, and a
    line repeated within a document counts once. A null text is one empty line, whose kept text is empty. An
    empty table gives an empty table. Further columns, whatever their names, stay inside `row`."""
    base = docs.select(F.struct("*").alias("row")).select(
        "row", F.col("row")[id_col].alias("id"), F.coalesce(F.col("row")[text_col], F.lit("")).alias("t")
    )
    slim = base.select("id", F.xxhash64("t").alias("th"), F.split("t", "\n").alias("lines"))
    hashes = lambda key: F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key).alias("h2"))
    keyed = slim.select("id", "th", F.transform("lines", line_key).alias("keys"))
    counts = (
        keyed.select("id", F.explode(F.array_distinct(F.filter("keys", lambda k: F.length(k) >= min_chars))).alias("k"))
        .select("id", hashes(F.col("k")).alias("h"))
        .select("id", "h.h1", "h.h2")
        .distinct()  # dealt by line and document, so that a line that all have is no hot key
        .groupBy("h1", "h2")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= min_docs)
        .select("h1", "h2")
    )
    # As a table of its own it is broadcast if it is small by its size; else both sides of the join are plain
    # shuffles, and the part of a line that every document has can be split.
    counts = cut(counts, "line-counts")
    lines = (
        keyed.select("id", "th", F.posexplode("keys").alias("pos", "k"))
        .where(F.length("k") >= min_chars)
        .select("id", "th", "pos", hashes(F.col("k")).alias("h"))
        .select("id", "th", "pos", "h.h1", "h.h2")
    )
    hits = (
        lines.join(counts, ["h1", "h2"], "left_semi")
        .groupBy("id", "th")
        .agg(F.array_sort(F.collect_set("pos")).alias("gone"))
        .select(F.col("id").alias("hit_id"), F.col("th").alias("hit_th"), "gone")
    )
    left = base.withColumn("th", F.xxhash64("t"))
    joined = left.join(hits, left["id"].eqNullSafe(hits["hit_id"]) & (left["th"] == hits["hit_th"]), "left")
    out = joined.select("row", "t", F.split("t", "\n").alias("lines"), F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    # Lines between two dropped positions stay as one slice, so the work is linear in the lines.
    n, k = F.size("lines"), F.size("gone")
    start = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.element_at("gone", F.greatest(i, F.lit(1))) + 1)
    end = lambda i: F.when(i == k, n).otherwise(F.element_at("gone", F.least(i + 1, F.greatest(k, F.lit(1)))))
    pieces = F.flatten(F.transform(F.sequence(F.lit(0), k), lambda i: F.slice("lines", start(i) + 1, end(i) - start(i))))
    return out.select(
        "row",
        F.when(k == 0, F.col("t")).otherwise(F.array_join(pieces, "\n")).alias("kept_text"),
        n.cast("long").alias("n_lines"),
        k.cast("long").alias("n_dropped"),
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: n_lines, n_dropped and the SHA-256 of the kept text."""
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP10_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
frequent AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(f.k) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN frequent f ON keyed.k = f.k GROUP BY doc_id
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their frequent lines gone; n_chars follows the text. A null text stays null."""
    cols = docs.columns
    out = dedup_lines(docs)
    text = F.when(F.col("row.text").isNull(), F.lit(None).cast("string")).otherwise(F.col("kept_text"))
    pick = {"text": text, "n_chars": F.when(F.col("n_dropped") > 0, F.length("kept_text").cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in cols else None}
    return out.select(*[(pick[c] if pick.get(c) is not None else F.col(f"row.`{c}`")).alias(c) for c in cols])
