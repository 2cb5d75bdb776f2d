"""Evaluation: recall, ranks, medians."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.model import owner


def upper_median(column: str, kind: str = "bigint") -> Column:
    """The upper of the two middle values of an even number: exact, from counts a value that are summed on the map
    side."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {column} DESC)").cast(kind)


def recall(questions: DataFrame, expected: DataFrame, got: DataFrame) -> DataFrame:
    """(qid, expected, found, recall); nothing expected is recall 1."""
    hit = expected.distinct().join(got.distinct().withColumn("hit", F.lit(1)), ["qid", "id"], "left")
    per = hit.groupBy("qid").agg(F.count(F.lit(1)).alias("expected"), F.sum(F.coalesce("hit", F.lit(0))).alias("found"))
    zero = F.lit(0).cast("long")
    r = questions.join(per, "qid", "left").select("qid", F.coalesce("expected", zero).alias("expected"), F.coalesce("found", zero).alias("found"))
    return r.withColumn("recall", F.when(F.col("expected") == 0, 1.0).otherwise(F.col("found") / F.col("expected")))


def precision(questions: DataFrame, expected: DataFrame, got: DataFrame) -> DataFrame:
    """(qid, returned, right, precision) of exhaustive questions; an empty answer is precision 1."""
    hit = got.distinct().join(expected.distinct().withColumn("hit", F.lit(1)), ["qid", "id"], "left")
    per = hit.groupBy("qid").agg(F.count(F.lit(1)).alias("returned"), F.sum(F.coalesce("hit", F.lit(0))).alias("right"))
    zero = F.lit(0).cast("long")
    r = questions.join(per, "qid", "left").select("qid", F.coalesce("returned", zero).alias("returned"), F.coalesce("right", zero).alias("right"))
    return r.withColumn("precision", F.when(F.col("returned") == 0, 1.0).otherwise(F.col("right") / F.col("returned")))


def locations(expected: DataFrame, evidence: DataFrame) -> DataFrame:
    """(qid, recall): expected files (qid, file) that some evidence (qid, file) ends with. Files are exploded to
    their trailing parts, so it is an equi-join."""
    parts = F.split("file", "/")
    tails = evidence.select("qid", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("file")).distinct()
    return recall(expected.select("qid").distinct(), expected.withColumnRenamed("file", "id"), tails.withColumnRenamed("file", "id")).select("qid", "recall")


def groundedness(expected: DataFrame, evidence: DataFrame, floor: str = "min_confidence") -> DataFrame:
    """(qid, groundedness): the share of evidence that has a place and reaches the question's confidence."""
    ok = (F.col("file") != "") & (F.col("line") > 0) & (F.col("confidence") >= F.col(floor))
    return evidence.join(expected.select("qid", floor), "qid").groupBy("qid").agg(F.avg(ok.cast("double")).alias("groundedness"))


def rank_metrics(ranks: DataFrame) -> DataFrame:
    """One row from (qid, rank), rank null for a miss: questions, recall, mrr, recall_at_1."""
    return ranks.agg(
        F.count(F.lit(1)).alias("questions"),
        F.round(F.avg(F.col("rank").isNotNull().cast("double")), 6).alias("recall"),
        F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"),
        F.round(F.avg(F.coalesce((F.col("rank") == 1).cast("double"), F.lit(0.0))), 6).alias("recall_at_1"),
    )


def reaching_ranks(anchors: DataFrame, subjects: DataFrame, edges: DataFrame) -> DataFrame:
    """(qid, rank): the position of the first anchor (qid, id, position) that reaches the question's subject (qid,
    subject): it is the subject, its owner or one of its members, or something that the graph says holds the
    subject or its owner. Null for a miss; questions without a subject in the graph aren't in subjects."""
    held = edges.where("kind in ('CONTAINS', 'PARTICIPATES_IN')").select(F.col("dst").alias("inner"), F.col("src").alias("id")).distinct()
    own = subjects.select("qid", F.explode(F.array_distinct(F.array("subject", owner("subject")))).alias("inner"))
    good = own.join(held, "inner").select("qid", "id").union(own.select("qid", "inner")).distinct()
    near = anchors.join(subjects, "qid").where((F.col("id") == F.col("subject")) | (owner("id") == F.col("subject")) | (F.col("id") == owner("subject")))
    hits = near.select("qid", "position").union(anchors.join(good, ["qid", "id"], "left_semi").select("qid", "position"))
    return subjects.select("qid").distinct().join(hits.groupBy("qid").agg(F.min("position").alias("rank")), "qid", "left")


def covered(anchors: DataFrame, expected: DataFrame) -> DataFrame:
    """(qid, coverage): of questions with several expected names (qid, name), the share that anchors (qid, id) match."""
    said = F.array("id", F.element_at(F.split("id", ":"), -1), F.substring_index("id", ".", -1), F.substring_index(owner("id"), ".", -1), F.substring_index("id", "#", -1))
    got = anchors.select("qid", F.explode(F.array_distinct(said)).alias("id")).distinct()
    plural = expected.groupBy("qid").agg(F.countDistinct("name").alias("n")).where("n > 1").select("qid")
    return recall(plural, expected.join(plural, "qid", "left_semi").select("qid", F.col("name").alias("id")), got).select("qid", F.col("recall").alias("coverage"))


def baseline_report(graph: DataFrame, search: DataFrame) -> DataFrame:
    """One row that compares the graph's answers with a text search's, both (qid, recall, evidence, size)."""
    both = graph.select("qid", *[F.col(c).alias(f"graph_{c}") for c in ("recall", "evidence", "size")]).join(search.select("qid", *[F.col(c).alias(f"search_{c}") for c in ("recall", "evidence", "size")]), "qid")
    return both.agg(F.count(F.lit(1)).alias("questions"), *[F.round(F.avg(f"{side}_{c}"), 6).alias(f"{side}_{c}") for side in ("graph", "search") for c in ("recall", "evidence", "size")])


def targets(nodes: DataFrame, questions: DataFrame) -> DataFrame:
    """(qid, graph_id): what a perfect chooser heads for: the resolved subject and expected names of each question
    (qid, subject, expected array)."""
    from loomgraph.operators.answers import resolve_symbols

    names = questions.select("qid", F.explode(F.array_union(F.array("subject"), "expected")).alias("query")).where("query <> ''")
    return names.join(resolve_symbols(nodes, names.select("query")), "query").select("qid", F.col("id").alias("graph_id")).distinct()


def passes(results: DataFrame, fail_under: float) -> bool:
    """Whether the mean of `recall` reaches the threshold (one number on the driver)."""
    mean = results.agg(F.avg("recall")).first()[0]
    return mean is None or mean >= fail_under
