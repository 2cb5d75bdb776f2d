"""From a source tree to the whole model, and answers from it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import text as X
from loomgraph.model import Graph, owner
from loomgraph.operators import answers, architecture, budget, derive, navigate, resolve, retrieval, traverse, tree
from loomgraph.sources import git_log, graph_json, models
from loomgraph.sources.java_source import emissions, source_files
from loomgraph.store import cut


@dataclass(frozen=True)
class Layers:
    tests: bool = True
    test_vocabulary: bool = False
    commit_vocabulary: bool = False
    framework: bool = True
    structure: bool = True
    workflow_depth: int = architecture.WORKFLOW_DEPTH


def build(spark: SparkSession, root: str, layers: Layers = Layers()) -> Graph:
    """The graph of a Java repository. The layers have one order, as later ones read what earlier ones wrote."""
    g = resolve.assemble(emissions(source_files(spark, root, layers.tests)))
    g = resolve.dispatch(resolve.overrides(resolve.resolve_calls(g)))
    if layers.test_vocabulary:
        g = resolve.test_vocabulary(g)
    if layers.commit_vocabulary:
        g = resolve.commit_vocabulary(g, git_log.commits(spark, root))
    if layers.framework:
        g = resolve.framework(g)
    if layers.structure:
        g = architecture.detect_modules(g)
        g = architecture.detect_workflows(g, layers.workflow_depth)
        g = architecture.detect_capabilities(g)
    return Graph(cut(g.nodes, "graph-nodes"), cut(g.edges, "graph-edges"))  # layers are plans; sessions ask many times


def load(spark: SparkSession, path: str, layers: Layers = Layers()) -> Graph:
    """A graph file if the path ends in .json, else a repository."""
    return graph_json.read(spark, path) if path.endswith(".json") else build(spark, path, layers)


def tree_hits(g: Graph, plan: DataFrame, questions: list[tuple[int, str]], index: tuple[DataFrame, DataFrame] | None = None, beam: int = navigate.BEAM, most: int = 10, choose=navigate.best_first) -> DataFrame:
    """(qid, id, rank): the graph's nodes where descents through the table of contents land."""
    nodes, links = index or derive.derive(g)
    nodes, links = cut(nodes, "index-nodes"), cut(links, "index-links")
    scores = tree.subtree_scores(tree.cards(nodes, links), links, questions)
    names = nodes.select("id", F.explode(F.array_distinct(F.array("name", X.simple_name(F.col("name")), F.substring_index("name", "#", -1)))).alias("name"), (F.col("kind") == "MEMBER").alias("member"))
    asked = plan.where("subject <> ''").select("qid", "subject")
    named = names.join(asked, F.lower("name") == F.lower("subject")).select("qid", "id").distinct()
    entries = nodes.select("id", "kind", F.col("facts")["kind"].alias("entity"))
    found = navigate.descend(plan.select("qid", "kind"), links, entries, scores, named, tree.holding(links, names, asked), derive.ROOT, beam, most, choose)["anchors"]
    of = nodes.where(F.size("graph_ids") > 0).select("id", F.col("graph_ids")[0].alias("node"))
    return found.join(of, "id").select("qid", F.col("node").alias("id"), F.col("position").alias("rank"))


def dense_index(g: Graph, encoder) -> DataFrame:
    """(id, test, v): the vector of each node that has one, its facets one vote each, and whether it is test code."""
    nodes = navigate.embedded(g.nodes)
    pooled = retrieval.facet_votes(models.encode(models.facets(nodes), encoder).select("id", "v"))
    v = F.transform(F.array_sort(F.collect_list(F.struct("i", "value"))), lambda x: x["value"])
    return pooled.groupBy("id").agg(v.alias("v")).join(nodes.select("id", X.is_test(F.col("name"), F.col("file")).alias("test")), "id").select("id", "test", "v")


def dense_hits(g: Graph, questions: list[tuple[int, str]], encoder, most: int) -> DataFrame:
    """(qid, id, rank) by vectors, test code demoted."""
    asked = g.spark.createDataFrame([(q, [float(x) for x in encoder.vector(text)]) for q, text in questions], "qid long, q array<double>")
    return retrieval.nearest(dense_index(g, encoder), asked, most, test=F.col("test")).select("qid", "id", "rank")


def ask(g: Graph, questions: list[tuple[int, str]], limit: int = 10, anchors: int = 1, depth: int | None = None, mode: str = "HYBRID", index=None, encoder=None, beam: int = navigate.BEAM, budget_: int | None = None) -> dict[str, DataFrame]:
    """Answers to all questions in one run: plan, anchors, packet, claims and their verdicts, and with a budget how
    much of each merged packet fits (`fits`). What leads is up to the mode; every claim is one edge and is verified
    against the graph."""
    spark = g.spark
    asked = spark.createDataFrame(questions, "qid long, question string")
    plan = cut(asked.select("qid", X.classify(F.col("question")).alias("p"), X.subject(F.col("question")).alias("subject")).select("qid", "p.kind", "subject", F.coalesce(F.lit(depth), "p.depth").alias("depth")), "plan")
    needs, parts = navigate.MODES.get(mode, ()), {}
    if "flat" in needs:
        named = answers.resolve_symbols(g.nodes, plan.where("subject <> ''").select(F.col("subject").alias("query")))
        parts["named"] = plan.join(named, plan["subject"] == named["query"]).select("qid", "id", F.lit(1).alias("rank"))
        anchorable = g.nodes.where("kind not in ('FILE', 'PACKAGE', 'REPOSITORY')").select("id")
        parts["flat"] = retrieval.search_nodes(g.nodes, questions, limit).join(anchorable, "id", "left_semi").select("qid", "id", "rank")
    if "tree" in needs:
        parts["tree"] = tree_hits(g, plan, questions, index, beam, max(1, anchors))
    if "dense" in needs and encoder is not None:
        parts["dense"] = dense_hits(g, questions, encoder, max(limit, anchors))
    chosen = cut(navigate.anchors_of(mode, parts, anchors), "anchors")
    # A packet an anchor; the seed says whose it is.
    seed = F.concat_ws("/", F.col("qid").cast("string"), F.col("position").cast("string"))
    seeds = cut(chosen.join(plan.select("qid", F.col("depth").alias("most")), "qid").select(seed.alias("seed"), "id", "most", F.col("qid").alias("group"), "position"), "seeds")
    packet = traverse.context(g, seeds.select("seed", "id", "most"), plan.agg(F.max("depth")).first()[0] or 1)
    packet = navigate.merged(packet, seeds.select("group", "seed", "position"))
    packet = {name: cut(rows.withColumn("seed", F.col("group").cast("string")).drop("group", "position"), name) for name, rows in packet.items()}
    anchor = seeds.select(F.col("group").cast("string").alias("seed"), F.col("id").alias("anchor"))
    claims = cut(answers.claims_from(packet["evidence"], anchor), "claims")
    verdicts = answers.verify_claims(claims, claims.select("claim_id", "src", "dst", "kind"), g.nodes, g.edges)
    out = {"plan": plan, "anchors": chosen, "packet": packet, "claims": claims, "verdicts": verdicts}
    if budget_ is not None:
        first = seeds.where("position = 1").select(F.col("group").cast("string").alias("seed"), "id")
        out["fits"] = compressed(g, packet, first, budget_)
    return out


def compressed(g: Graph, packet: dict[str, DataFrame], seeds: DataFrame, tokens: int = 1500) -> DataFrame:
    """How much of each packet fits the budget."""
    cost = X.node_tokens(F.col("id"), F.col("name"))
    fixed = seeds.join(g.nodes.select("id", "name"), "id").select("seed", cost.alias("t"), F.lit(0).alias("e"))
    fixed = fixed.union(packet["endpoints"].select("seed", cost, F.lit(1))).union(packet["dependencies"].select("seed", cost, F.lit(0)))
    fixed = fixed.groupBy("seed").agg(F.sum("t").alias("tokens"), F.sum("e").cast("int").alias("endpoints"))
    callers = packet["callers"].select("seed", F.col("id").alias("ord"), cost.alias("tokens"))
    anchors = seeds.select("seed", F.col("id").alias("anchor"))
    near = packet["evidence"].join(anchors, "seed")
    touches = (F.col("src") == F.col("anchor")) | (F.col("dst") == F.col("anchor")) | (owner("src") == F.col("anchor")) | (owner("dst") == F.col("anchor"))
    rank = F.struct((~touches).cast("int").alias("a"), (-F.col("confidence")).alias("b"), "src", "dst", "kind", "line", "col")
    evidence = near.groupBy("seed", "src", "dst", "kind", "line", "col", "confidence", "file").agg(F.min(rank).alias("ord")).select("seed", "ord", X.edge_tokens(F.col("src"), F.col("dst"), F.col("file")).alias("tokens"))
    return budget.compress(callers, evidence, fixed, tokens)
