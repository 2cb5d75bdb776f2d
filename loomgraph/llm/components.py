"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import cut, discard


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of links (a, b): root is the least node of its component. Labels go to the
    least neighbour's, then to their label's label, until none changes; the least label of a neighbourhood is
    summed up on the map side, so a node with many links is no hot group, and each round is cut off its
    lineage."""
    both = cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "cc-links")
    held = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root"), F.lit(True).alias("changed")), "cc-labels")
    while True:
        labels = held.select("node", "root")
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("root").alias("m")).select(F.col("a").alias("node"), "m")
        step = labels.join(near, "node", "left").select("node", F.col("root").alias("was"), F.least("root", F.coalesce("m", "root")).alias("root"))
        over = labels.select(F.col("node").alias("root"), F.col("root").alias("further"))
        new = step.join(over, "root", "left").select("node", "was", F.least("root", F.coalesce("further", "root")).alias("root"))
        new = cut(new.select("node", "root", (F.col("was") != F.col("root")).alias("changed")), "cc-labels")
        discard(held)
        held = new
        if not new.where("changed").limit(1).count():
            discard(both)
            return held
