"""Traversals: breadth-first reach with paths, closures, impact and context.

One kernel serves all of them. The edges it may use are cut down to keys and written when a second hop needs
them, so later hops read neither the tables behind them nor the nodes that may be entered; a hop joins the
frontier, which is broadcast while it is small by its size, and drops what was reached before; only the new rows
of a hop are written, so neither the plan nor a task grows with the depth. Many seeds go in one run, told apart
by `seed`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.model import IMPACT_RELATIONS, Graph
from loomgraph.store import cut, is_empty


def reach(start: DataFrame, links: DataFrame, depth: int | None = None, known: DataFrame | None = None, order: str | None = None) -> DataFrame:
    """Rows (seed, id, depth, via, link) first reached from start (seed, id) over links (at, to[, order]), at most
    `depth` hops off; start has depth 0. Of several ways into a node on the same hop the one whose parent comes
    first, then whose link does, is kept. known (id): nodes that may be entered."""
    first = start.select("seed", "id").distinct()
    out = [cut(first.select("seed", "id", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("via"), F.lit(None).cast("long").alias("link")), "reach")]
    seen, frontier, hop = out[0].select("seed", "id"), out[0], 0
    key = F.col(order).cast("long") if order else F.lit(0).cast("long")
    slim = links.select("at", "to", key.alias("link"))
    if known is not None:
        slim = slim.join(known.select(F.col("id").alias("to")), "to", "left_semi").select("at", "to", "link")
    while depth is None or hop < depth:
        hop += 1
        if hop == 2:
            slim = cut(slim if order else slim.distinct(), "reach-links")
        near = frontier.select("seed", F.col("id").alias("at")).join(slim, "at").select("seed", F.col("to").alias("id"), F.lit(hop).alias("depth"), F.col("at").alias("via"), "link")
        best = near.groupBy("seed", "id").agg(F.min(F.struct("via", "link")).alias("b")).select("seed", "id", F.lit(hop).alias("depth"), "b.via", "b.link")
        new = cut(best.join(seen, ["seed", "id"], "left_anti"), "reach")
        if is_empty(new):
            break
        out.append(new)
        frontier, seen = new, seen.unionByName(new.select("seed", "id"))
    found = out[0]
    for x in out[1:]:
        found = found.unionByName(x)
    return found


def members(g: Graph, subjects: DataFrame) -> DataFrame:
    """(seed, id): subjects (seed, id) with all they declare, directly or not."""
    links = g.edges.where("kind = 'DECLARES'").select(F.col("src").alias("at"), F.col("dst").alias("to"))
    return reach(subjects, links).select("seed", "id")


def impact(g: Graph, subjects: DataFrame, depth: int = 4) -> DataFrame:
    """What is affected if the subjects (seed, id) change: rows (seed, id, depth, via, link) of nodes that reach a
    subject or its members by impact relations; depth 1 is direct. Members themselves aren't reported. A column
    `most` of subjects is a seed's own depth, within `depth`."""
    back = g.edges.where(F.col("kind").isin(*IMPACT_RELATIONS)).select(F.col("dst").alias("at"), F.col("src").alias("to"), *[c for c in ("seq",) if c in g.edges.columns])
    found = reach(members(g, subjects), back, depth, known=g.nodes, order="seq" if "seq" in g.edges.columns else None)
    if "most" in subjects.columns:
        found = found.join(subjects.select("seed", "most").distinct(), "seed").where("depth <= most").drop("most")
    return found.where("depth > 0")


class Packet(dict):
    """The parts of a context by name, each made when it is asked for."""

    def __getitem__(self, name: str) -> DataFrame:
        if callable(super().__getitem__(name)):
            self[name] = super().__getitem__(name)()
        return super().__getitem__(name)

    def items(self):
        return [(name, self[name]) for name in self]


def impact_paths(g: Graph, found: DataFrame, depth: int) -> DataFrame:
    """(seed, id, depth, path): the chain of nodes from each impacted node's seed side, by its `via` links."""
    paths = found.where("depth = 1").select("seed", "id", "depth", F.array("via", "id").alias("path"))
    out = paths
    for d in range(2, depth + 1):
        step = found.where(F.col("depth") == d).select("seed", "id", "depth", "via")
        paths = step.join(paths.select("seed", F.col("id").alias("via"), "path"), ["seed", "via"]).select("seed", "id", "depth", F.concat("path", F.array("id")).alias("path"))
        out = out.unionByName(paths)
    return out


def path_edges(g: Graph, found: DataFrame) -> DataFrame:
    """The edges (with seed) that impact paths use: each reached node's link to the node it came by."""
    steps = found.select("seed", F.col("id").alias("src"), F.col("via").alias("dst"), F.col("link").alias("seq"))
    keys = ["src", "dst", "seq"] if "seq" in g.edges.columns else ["src", "dst"]
    e = g.edges.where(F.col("kind").isin(*IMPACT_RELATIONS))
    return e.join(steps.select("seed", *keys), keys)


def downstream(g: Graph, subjects: DataFrame) -> DataFrame:
    """Out-edges of subjects and their members, without containment; calls of the subject itself only."""
    own = members(g, subjects).select("seed", F.col("id").alias("src"))
    heads = subjects.select("seed", F.col("id").alias("head")).distinct()
    e = g.edges.where(~F.col("kind").isin("DECLARES", "CONTAINS"))
    return e.join(own, "src").join(heads, "seed").where("kind <> 'CALLS' OR src = head").drop("head")


def context(g: Graph, subjects: DataFrame, depth: int = 3) -> Packet:
    """The packet around subjects (seed, id): callers (methods and plain types that are affected), endpoints,
    dependencies, and evidence edges, each with its seed."""
    found = cut(impact(g, subjects, depth), "impact")
    kinds = g.nodes.select("id", "kind", "name")
    heads = subjects.select("seed", F.col("id").alias("head")).distinct()
    shared: dict[str, DataFrame] = {}

    def down() -> DataFrame:
        if not shared:
            shared["down"] = cut(downstream(g, subjects), "downstream")
        return shared["down"]

    def hit(*wanted: str) -> DataFrame:
        own = found.select("seed", "id").distinct()
        return own.join(kinds.where(F.col("kind").isin(*wanted)).distinct(), "id").select("seed", "id", "kind", "name")

    def dependencies() -> DataFrame:
        deps = down().select("seed", F.col("dst").alias("id")).distinct().join(kinds, "id").join(heads, "seed").where("id <> head")
        return deps.select("seed", "id", "kind", "name").distinct()

    def evidence() -> DataFrame:
        held = g.edges.where("kind = 'CONTAINS'").join(heads.withColumnRenamed("head", "dst"), "dst")
        columns = [*g.edges.columns, "seed"]
        every = path_edges(g, found).select(*columns).unionByName(down().select(*columns)).unionByName(held.select(*columns))
        w = Window.partitionBy("seed", "src", "dst", "kind", "line", "col").orderBy(F.col("confidence").desc(), "resolver", "file")
        return every.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")

    return Packet(callers=lambda: hit("METHOD", "TYPE"), endpoints=lambda: hit("ENDPOINT"), dependencies=dependencies, evidence=evidence)
