"""Iterative graph analytics on edge tables (src, dst): PageRank, components, k-core, degrees."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.store import cut, is_empty


def degrees(edges: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree), parallel edges counted; one shuffle of a row an end."""
    ends = edges.select(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(edges.select("dst", F.lit(1), F.lit(0)))
    return ends.groupBy("id").agg(F.sum("i").cast("long").alias("in_degree"), F.sum("o").cast("long").alias("out_degree"))


def pagerank(ids: DataFrame, edges: DataFrame, iterations: int = 40, damping: float = 0.85) -> DataFrame:
    """(id, rank): a fixed number of rounds from 1/N; parallel edges weigh as often as they stand; the rank of
    nodes without out-edges is spread over all. Only nodes that give matter to the next round: rounds go over edges
    between those, what the others hold is known from the share that each giver sends out to them, and their ranks are
    made once, in the last round. Without edges between givers a round is arithmetic. Edges are collapsed to weights
    and shares in one shuffle by source."""
    every = cut(ids.select("id").distinct(), "rank-ids")
    n = every.count()
    if n == 0 or iterations == 0:
        return every.select("id", F.lit(1.0 / max(n, 1)).alias("rank"))
    weights = edges.select("src", "dst").repartition("src").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w"))
    shares = cut(weights.select("src", "dst", (F.col("w") / F.sum("w").over(Window.partitionBy("src"))).alias("share")), "rank-edges")
    givers = cut(shares.select(F.col("src").alias("id")).distinct().join(every, "id", "left_semi"), "rank-givers")
    inner = cut(shares.join(givers.select(F.col("id").alias("dst")), "dst", "left_semi").join(givers.select(F.col("id").alias("src")), "src", "left_semi").select("src", "dst", "share"), "rank-inner")
    # What a giver sends to nodes that keep it: to all that are known, less to those that give.
    to = cut(shares.join(every.select(F.col("id").alias("dst")), "dst", "left_semi").groupBy(F.col("src").alias("id")).agg(F.sum("share").alias("all")), "rank-out")
    back = inner.groupBy(F.col("src").alias("id")).agg(F.sum("share").alias("back"))
    out = givers.join(to, "id", "left").join(back, "id", "left").select("id", (F.coalesce("all", F.lit(0.0)) - F.coalesce("back", F.lit(0.0))).alias("out"))
    ranks = cut(out.select("id", "out", F.lit(1.0 / n).alias("rank")), "rank")
    giving = ranks.count()
    sink, alone = (n - giving) / n, is_empty(inner)
    sent = ranks.agg(F.sum("out")).first()[0] or 0.0 if alone else None
    rank = 1.0 / n
    for _ in range(iterations - 1):
        level = (1 - damping + damping * sink) / n
        flow = rank * sent if alone else ranks.agg(F.sum(F.col("rank") * F.col("out"))).first()[0] or 0.0
        sink = (n - giving) * level + damping * flow
        if alone:
            rank = level
            continue
        got = inner.join(ranks.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        ranks = cut(ranks.select("id", "out").join(got, "id", "left").select("id", "out", (level + damping * F.coalesce("got", F.lit(0.0))).alias("rank")), "rank")
    if alone:
        ranks = ranks.select("id", F.lit(rank).alias("rank"))
    level = (1 - damping + damping * sink) / n
    got = shares.join(ranks.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
    return every.join(got, "id", "left").select("id", (level + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))


def components(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, root): root is the least id that edges lead to, in either direction. Labels go to the least
    neighbour's and then to their label's label; sums on the map side keep hubs from being hot groups."""
    both = cut(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select("dst", "src")).where("a <> b").distinct(), "cc-edges")
    labels = cut(ids.select("id").distinct().withColumn("root", F.col("id")), "cc")
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("root").alias("m"))
        step = labels.join(near, labels["id"] == near["a"], "left").select("id", F.col("root").alias("was"), F.least("root", F.coalesce("m", "root")).alias("root"))
        over = labels.select(F.col("id").alias("root"), F.col("root").alias("further"))
        new = cut(step.join(over, "root", "left").select("id", "was", F.least("root", F.coalesce("further", "root")).alias("root")), "cc")
        labels = new.select("id", "root")
        if is_empty(new.where("was <> root")):
            return labels


def communities(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """(community, size, cohesion): components with the distinct undirected edges inside."""
    roots = cut(components(ids, edges), "cc-roots")
    pairs = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("a <> b").distinct()
    inside = pairs.join(roots.withColumnRenamed("id", "a"), "a").groupBy("root").agg(F.count(F.lit(1)).alias("cohesion"))
    sizes = roots.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    return sizes.join(inside, "root", "left").select(F.concat(F.lit("community:"), "root").alias("community"), "size", F.coalesce("cohesion", F.lit(0)).cast("long").alias("cohesion"))


def k_core(edges: DataFrame, k: int) -> DataFrame:
    """The distinct undirected edges (a, b) that are left when nodes of fewer than k neighbours are taken away
    until there are none."""
    pairs = cut(edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("a <> b").distinct(), "core")
    while True:
        ends = pairs.select(F.col("a").alias("id")).union(pairs.select("b"))
        weak = cut(ends.groupBy("id").count().where(F.col("count") < k).select("id"), "core-weak")
        if is_empty(weak):
            return pairs
        pairs = cut(pairs.join(weak.withColumnRenamed("id", "a"), "a", "left_anti").join(weak.withColumnRenamed("id", "b"), "b", "left_anti").select("a", "b"), "core")
