"""The search by vectors: matrix products give the rows that sums pair by pair give, ties, copies and odd vectors included."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from loomgraph.functions import text as X
from loomgraph.functions import vectors as V
from loomgraph.operators import retrieval


def by_pairs(vectors, queries, k, test):
    score = X.demote(V.dot(F.col("u"), F.col("q")), test)
    both = vectors.withColumn("u", V.unit(F.col("v"))).crossJoin(queries.select("qid", V.unit(F.col("q")).alias("q")))
    w = Window.partitionBy("qid").orderBy(F.col("similarity").desc(), "id")
    return both.select("qid", "id", score.alias("similarity")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def rows(df):
    return sorted(str(r) for r in df.select("qid", "id", "similarity", "rank").collect())


@pytest.mark.parametrize("kind", ["long", "string"])
@pytest.mark.parametrize("odd", [False, True])
def test_products_give_what_pairs_give(spark, monkeypatch, kind, odd):
    for name, size in (("QUERIES", 7), ("ROWS", 16), ("ASKED", 4)):
        monkeypatch.setattr(retrieval, name, size)
    r = np.random.default_rng(3)
    base = r.normal(size=(40, 5)).astype("float32").tolist() + [[0.0] * 5, [2.0, 0.0, 0.0, 0.0, 0.0]]
    data = [(i, base[i % len(base)] if i % 3 else base[7], i % 4 == 0) for i in range(150)]  # a third are copies of one
    if odd:
        data += [(150, None, False), (151, [1.0, 2.0], False), (152, [1.0, None, 0.0, 0.0, 0.0], True), (153, [float("nan")] * 5, False), (None, base[1], False)]
    v = spark.createDataFrame(data, "id long, v array<float>, test boolean").withColumn("id", F.col("id").cast(kind))
    q = v.where("id % 9 = 0 or id > 149").select(F.col("id").alias("qid"), F.col("v").alias("q"))
    assert rows(retrieval.nearest(v, q, 6, F.col("test"))) == rows(by_pairs(v, q, 6, F.col("test")))


def test_no_pair_by_pair_sums_and_no_copies_kept(spark):
    v = spark.createDataFrame([(i, [1.0, float(i % 2)], False) for i in range(50)], "id long, v array<float>, test boolean")
    q = v.where("id < 2").select(F.col("id").alias("qid"), F.col("v").alias("q"))
    assert "CartesianProduct" not in (plan := retrieval.nearest(v, q, 3)._jdf.queryExecution().toString()) and "NestedLoop" not in plan
    best = retrieval.BestPairs(np.eye(2), 3)
    best.add(np.arange(1000), np.tile(np.eye(2)[0], (1000, 1)), np.zeros(1000, bool))
    best.add(np.arange(1000) - 1000, np.tile(np.eye(2)[0], (1000, 1)), np.zeros(1000, bool))
    assert best.of.tolist() == [0, 0, 0, 1, 1, 1] and best.ids.tolist() == [-1000, -999, -998] * 2 and best.scores.tolist() == [1.0] * 3 + [0.0] * 3


def test_empty_tables(spark):
    v = spark.createDataFrame([], "id long, v array<float>")
    q = spark.createDataFrame([], "qid long, q array<float>")
    some = spark.createDataFrame([(1, [1.0])], "id long, v array<float>")
    assert retrieval.nearest(v, q, 2).count() == retrieval.nearest(some, q, 2).count() == 0
    assert retrieval.nearest(some, some.select(F.col("id").alias("qid"), F.lit(None).cast("array<float>").alias("q")), 2).first()["similarity"] is None
    assert retrieval.nearest(v, some.select(F.col("id").alias("qid"), F.col("v").alias("q")), 2).count() == 0
