"""Descent through the table of contents, the ways to choose a branch, and what a mode of retrieval combines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import vectors as V
from loomgraph.store import cut, is_empty

#: Levels of a descent, and the share of a parent's score that a child starts with.
DEEPEST, INHERITED, BEAM = 12, 0.5, 4
# What kind of entry (and of entity behind it) answers what kind of question; any other entry has `else`.
AFFINITY = {
    "ENDPOINT": {"ENDPOINT": 1.8, "CAPABILITY": 1.5, "TYPE:CONTROLLER": 1.4, "MEMBER": 0.8, "else": 0.9},
    "PERSISTENCE": {"TABLE": 1.8, "TYPE:ENTITY": 1.5, "TYPE:REPOSITORY_COMPONENT": 1.5, "CAPABILITY": 1.1, "else": 0.9},
    "SECURITY": {"ENDPOINT": 1.3, "CAPABILITY": 1.3, "TYPE": 1.1, "else": 0.9},
    "STRUCTURE": {"MODULE": 1.8, "PACKAGE": 1.5, "CAPABILITY": 1.2, "MEMBER": 0.5, "else": 0.9},
    "IMPACT": {"TYPE": 1.4, "MEMBER": 1.1, "CAPABILITY": 0.8, "else": 1.0},
    "LOOKUP": {"TYPE": 1.3, "MEMBER": 1.1, "else": 1.0},
}
# What each mode draws on: the tree, named symbols and text hits, vectors.
MODES = {
    "BM25": ("flat",), "TREE": ("tree",), "HYBRID": ("flat", "tree"), "DENSE": ("dense",), "DENSE_HYBRID": ("flat", "dense"),
}
# The kinds of nodes that have a vector.
EMBEDDED = ("TYPE", "INTERFACE", "CONTROLLER", "SERVICE", "REPOSITORY_COMPONENT", "ENTITY", "CONFIGURATION", "MODULE", "BUSINESS_CAPABILITY", "WORKFLOW")

Chooser = Callable[[DataFrame, int], DataFrame]


def affinity(question: Column, entry: Column, entity: Column) -> Column:
    """The weight of an entry for a kind of question: by entry and entity, else by entry, else the question's own."""
    weights = F.create_map(*[F.lit(x) for kind, of in AFFINITY.items() for key, w in of.items() for x in (f"{kind}/{key}", w)])
    key = lambda *parts: weights[F.concat(question, F.lit("/"), *parts)]
    return F.coalesce(key(entry, F.lit(":"), F.coalesce(entity, F.lit(""))), key(entry), key(F.lit("else")))


def _best(*keys: str):
    return Window.partitionBy(*keys).orderBy(F.col("holds").desc(), F.col("score").desc(), "id")


def best_first(ranked: DataFrame, keep: int) -> DataFrame:
    """The first `keep` children of each card: those that hold the subject, then by score, then by id."""
    return ranked.withColumn("_r", F.row_number().over(_best("qid", "parent"))).where(F.col("_r") <= keep).drop("_r")


def by_similarity(similarities: DataFrame) -> Chooser:
    """Chooses by (qid, id, similarity) instead; an entry without a vector has 0."""

    def choose(ranked: DataFrame, keep: int) -> DataFrame:
        near = ranked.join(similarities, ["qid", "id"], "left").withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))
        w = Window.partitionBy("qid", "parent").orderBy(F.col("similarity").desc(), "id")
        return near.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= keep).select(*ranked.columns)

    return choose


def on_path(paths: DataFrame) -> Chooser:
    """Chooses the children on a path (qid, id) to the answer, as far as a card has some; best_first() otherwise. It
    tells how good any chooser could be."""

    def choose(ranked: DataFrame, keep: int) -> DataFrame:
        marked = ranked.join(paths.select("qid", "id", F.lit(True).alias("_on")).distinct(), ["qid", "id"], "left")
        some = F.max(F.coalesce("_on", F.lit(False))).over(Window.partitionBy("qid", "parent"))
        return best_first(marked.withColumn("_some", some).where("_on or not _some").select(*ranked.columns), keep)

    return choose


def paths_to(closure: DataFrame, graph_ids: DataFrame, targets: DataFrame) -> DataFrame:
    """(qid, id): entries over or at those that stand for a target. closure (id, anc), graph_ids (id, graph_id),
    targets (qid, graph_id)."""
    return graph_ids.join(targets, "graph_id").join(closure, "id").select("qid", F.col("anc").alias("id")).distinct()


def descend(plan: DataFrame, links: DataFrame, nodes: DataFrame, scores: DataFrame, named: DataFrame, holds: DataFrame, root: str, beam: int = BEAM, most: int = 10, choose: Chooser = best_first) -> dict[str, DataFrame]:
    """Where all questions of a plan (qid, kind) land, in one run: `anchors` (qid, id, score, holds, position) and
    `trace` (qid, depth, parent, id): what each level chose.

    A child scores half its parent's score and its own text score (scores: qid, id, score) times its affinity. A
    card is an anchor if it has no children, if it is a module or package and the question is about structure, if
    it is the type or member that the question names (named: qid, id), or if none of its children beats it and
    the best one doesn't hold the subject (holds: qid, id). The frontier keeps `beam` entries a question. nodes:
    (id, kind, entity)."""
    text = scores.select("qid", "id", F.col("score").alias("text"))
    subject = named.select("qid", "id", F.lit(True).alias("named")).distinct()
    holding = holds.select("qid", "id", F.lit(True).alias("h")).distinct()
    inner = links.select(F.col("parent").alias("id"), F.lit(True).alias("inner")).distinct()
    kinds = nodes.select("id", F.col("kind").alias("entry"), "entity")
    frontier = cut(plan.select("qid", F.col("kind").alias("asked"), F.lit(root).alias("id"), F.lit(0.0).alias("score"), F.lit(False).alias("holds")), "descent")
    seen = frontier.select("qid", "id")
    anchors, trace = [], []
    for depth in range(DEEPEST):
        at = frontier.join(kinds, "id", "left").join(inner, "id", "left").join(subject, ["qid", "id"], "left")
        stops = F.col("inner").isNull() | ((F.col("asked") == "STRUCTURE") & F.col("entry").isin("MODULE", "PACKAGE")) | (F.col("named").isNotNull() & F.col("entry").isin("TYPE", "MEMBER"))
        at = cut(at.withColumn("stops", F.coalesce(stops, F.lit(False))).select("qid", "asked", "id", "score", "holds", "stops"), "descent")
        anchors.append(at.where("stops").select("qid", "id", "score", "holds"))
        over = at.where("not stops").select("qid", "asked", F.col("id").alias("parent"), F.col("score").alias("above"), F.col("holds").alias("above_holds"))
        ranked = over.join(links.select("parent", F.col("child").alias("id")).distinct(), "parent").join(kinds, "id", "left").join(text, ["qid", "id"], "left").join(holding, ["qid", "id"], "left").join(subject, ["qid", "id"], "left")
        score = INHERITED * F.col("above") + F.coalesce("text", F.lit(0.0)) * affinity(F.col("asked"), F.coalesce("entry", F.lit("")), F.col("entity"))
        ranked = cut(ranked.select("qid", "asked", "parent", "above", "above_holds", "id", score.alias("score"), (F.coalesce("h", F.lit(False)) | F.coalesce("named", F.lit(False))).alias("holds")), "descent")
        if is_empty(ranked):
            break
        top = ranked.groupBy("qid", "parent", "above", "above_holds").agg(F.max(F.struct("holds", "score")).alias("b"))
        anchors.append(top.where("not b.holds and above >= b.score").select("qid", F.col("parent").alias("id"), F.col("above").alias("score"), F.col("above_holds").alias("holds")))
        chosen = cut(choose(ranked, max(1, beam)), "descent")
        trace.append(chosen.select("qid", F.lit(depth).alias("depth"), "parent", "id"))
        near = chosen.groupBy("qid", "asked", "id").agg(F.max(F.struct("holds", "score")).alias("b")).select("qid", "asked", "id", "b.score", "b.holds")
        near = near.withColumn("_r", F.row_number().over(_best("qid"))).where(F.col("_r") <= max(1, beam)).drop("_r").join(seen, ["qid", "id"], "left_anti")
        frontier = cut(near.select("qid", "asked", "id", "score", "holds"), "descent")
        seen = seen.union(frontier.select("qid", "id"))
    found, steps = anchors[0], trace[0] if trace else plan.select("qid", F.lit(0).alias("depth"), F.lit("").alias("parent"), F.lit("").alias("id")).limit(0)
    for x in anchors[1:]:
        found = found.union(x)
    for x in trace[1:]:
        steps = steps.union(x)
    found = found.groupBy("qid", "id").agg(F.max(F.struct("holds", "score")).alias("b")).select("qid", "id", "b.score", "b.holds")
    found = found.withColumn("position", F.row_number().over(_best("qid"))).where(F.col("position") <= max(1, most))
    return {"anchors": found, "trace": steps}


def folded_centroids(links: DataFrame, vectors: DataFrame) -> DataFrame:
    """(id, i, value): every entry's vector as the mean direction of its own (id, v) and its children's, each child
    one vote whatever is below it. Levels are folded from the leaves up, one join a level."""
    own = vectors.select("id", F.posexplode(V.unit(F.col("v"))).alias("i", "x"))
    tree = links.select("parent", "child").distinct()
    waiting = cut(tree, "centroid-links")
    level = cut(own.join(tree.select(F.col("parent").alias("id")).distinct(), "id", "left_anti").select("id", "i", F.col("x").alias("value")), "centroids")
    done, ready = [level], level.select("id").distinct()
    while not is_empty(waiting):
        every = waiting.join(ready.select(F.col("id").alias("child"), F.lit(True).alias("r")), "child", "left")
        parents = every.groupBy("parent").agg(F.every(F.coalesce("r", F.lit(False))).alias("all")).where("all").select("parent")
        now = cut(waiting.join(parents, "parent"), "centroid-now")
        if is_empty(now):  # children without any vector: nothing more can be folded
            break
        below = done[0]
        for x in done[1:]:
            below = below.union(x)
        parts = now.join(below.select(F.col("id").alias("child"), "i", F.col("value").alias("x")), "child").select(F.col("parent").alias("id"), "i", "x")
        parts = parts.union(own.join(parents.select(F.col("parent").alias("id")), "id").select("id", "i", "x"))
        mean = parts.groupBy("id", "i").agg(F.avg("x").alias("x"))
        length = mean.groupBy("id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("n"))
        done.append(cut(mean.join(length, "id").select("id", "i", F.when(F.col("n") > 0, F.col("x") / F.col("n")).otherwise(F.col("x")).alias("value")), "centroids"))
        ready = ready.union(parents.select(F.col("parent").alias("id")))
        waiting = cut(waiting.join(parents, "parent", "left_anti"), "centroid-links")
    out = done[0]
    for x in done[1:]:
        out = out.union(x)
    return out


def subtree_similarity(folded: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, id, similarity): the cosine of each query (qid, q) and each folded vector (id, i, value)."""
    length = folded.groupBy("id").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("n"))
    asked = queries.select("qid", F.posexplode(V.unit(F.col("q"))).alias("i", "x"))
    dots = folded.join(asked, "i").groupBy("qid", "id").agg(F.sum(F.col("value") * F.col("x")).alias("d"))
    return dots.join(length, "id").select("qid", "id", F.when(F.col("n") > 0, F.col("d") / F.col("n")).otherwise(F.lit(0.0)).alias("similarity"))


def embedded(nodes: DataFrame) -> DataFrame:
    """The nodes that have a vector."""
    return nodes.where(F.col("kind").isin(*EMBEDDED))


def anchors_of(mode: str, parts: dict[str, DataFrame], limit: int) -> DataFrame:
    """(qid, id, position) of a mode: what the question names leads where text is drawn on, then the descent, then
    vectors, then text hits. parts: (qid, id, rank) under `named`, `tree`, `dense`, `flat`, those that the mode needs."""
    from loomgraph.operators.answers import plan_anchors

    if mode not in MODES:
        raise ValueError(f"no such mode: {mode}; there are {', '.join(MODES)}")
    order = [x for x in ("named", "tree", "dense", "flat") if x in MODES[mode] or x == "named" and "flat" in MODES[mode]]
    if missing := [x for x in order if x not in parts]:
        raise ValueError(f"mode {mode} needs {', '.join(missing)}")
    return plan_anchors([parts[x] for x in order], max(1, limit))


def merged(packet: dict[str, DataFrame], anchors: DataFrame) -> dict[str, DataFrame]:
    """One packet of those of several anchors (group, seed, position): nodes once, in the order of the first anchor that
    has them; of equal edges (by ends, kind and place) that of the last anchor."""
    w = Window.partitionBy("group", "id").orderBy("position")
    one = lambda df: df.join(anchors, "seed").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "seed")
    out = {name: one(packet[name]) for name in ("callers", "endpoints", "dependencies")}
    late = Window.partitionBy("group", "src", "dst", "kind", "line", "col").orderBy(F.col("position").desc())
    out["evidence"] = packet["evidence"].join(anchors, "seed").withColumn("_n", F.row_number().over(late)).where("_n = 1").drop("_n", "seed")
    return out
