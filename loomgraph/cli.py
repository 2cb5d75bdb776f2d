"""Commands over repositories and graph files: python -m loomgraph.cli COMMAND SOURCE ..."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import analytics, answers, architecture, budget, derive, traverse, tree
from loomgraph.operators import navigate as descent
from loomgraph.plans import repository
from loomgraph.sinks import exports
from loomgraph.sources import classpath

COMMANDS = ("inspect", "impact", "context", "architecture", "ask", "index", "navigate", "serve", "snapshot", "diff", "evaluate", "enrichment-plan", "enrich-targets", "enrich-apply", "visualize", "quantize-model")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loomgraph", description=__doc__)
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("source", help="a repository, or a graph file (.json)")
    p.add_argument("subject", nargs="?", default="", help="a symbol, a question, or the other graph of a diff")
    p.add_argument("--depth", type=int)
    p.add_argument("--out")
    p.add_argument("--choose", nargs="*", default=[], help="ids chosen at this step of a navigation")
    p.add_argument("--fail-under", type=float)
    p.add_argument("--strict", action="store_true")
    p.add_argument("--branches", action="store_true")
    p.add_argument("--risk", action="store_true")
    p.add_argument("--no-tests", action="store_true")
    p.add_argument("--format", choices=("json", "graphml", "dot", "cytoscape", "html"), default="html")
    p.add_argument("--max-nodes", type=int, default=exports.VIEW_NODES)
    p.add_argument("--max-impacted", type=int)
    p.add_argument("--budget", type=int, default=20_000)
    p.add_argument("--limit", type=int, default=40)
    p.add_argument("--anchors", type=int, default=1)
    p.add_argument("--mode", choices=tuple(descent.MODES), default="HYBRID", help="what an answer's anchors come from")
    p.add_argument("--model", help="folder of an embedding model, for the dense modes")
    p.add_argument("--beam", type=int, default=descent.BEAM)
    p.add_argument("--top", type=int, default=10, help="changed types whose risk a diff tells")
    p.add_argument("--kind", nargs="*", default=[], help="kinds of nodes that are shown")
    p.add_argument("--sarif", help="file for the impact as SARIF")
    p.add_argument("-k", type=int, default=0, help="k of the core that communities are taken from; 0: components")
    return p


def main(argv: list[str], spark: SparkSession | None = None, out=sys.stdout) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    try:
        return run(spark, a, out)
    except (ValueError, RuntimeError, FileNotFoundError) as e:
        print(f"error: {e}", file=out)
        return 1


def run(spark: SparkSession, a, out, g=None) -> int:
    say = lambda *x: print(*x, file=out)
    if a.command == "quantize-model":
        return quantize(a, say)
    if a.command == "serve":
        return serve(spark, a, out)
    g = g or repository.load(spark, a.source, repository.Layers(tests=not a.no_tests))
    if a.command in ("inspect", "snapshot"):
        if a.out:
            exports.write_json(g, a.out)
        say(exports.report("nodes by kind", g.nodes.groupBy("kind").count().orderBy("kind")))
        if not a.source.endswith(".json"):
            say(classpath.discover(a.source).report(a.source))
    elif a.command in ("impact", "context"):
        found = answers.resolve_symbols(g.nodes, spark.createDataFrame([(a.subject,)], "query string")).first()
        if found is None:
            raise ValueError(f"no symbol matches {a.subject}")
        if found["alternatives"]:
            say(f"{found['alternatives']} other symbols match {a.subject} as well; this is about {found['id']}")
        seeds = spark.createDataFrame([(found["id"], found["id"])], "seed string, id string")
        if a.command == "impact":
            depth = a.depth or 4
            hit = traverse.impact(g, seeds, depth)
            say(exports.report(f"impact of {found['id']}", traverse.impact_paths(g, hit, depth).orderBy("depth", "id")))
            if a.risk:
                say(exports.report("risk", answers.risk(g, hit, traverse.path_edges(g, hit))))
            if a.sarif:
                with open(a.sarif, "w", encoding="utf-8") as f:
                    results = ",\n".join(r["value"] for r in exports.sarif(hit, g.nodes).orderBy("id").toLocalIterator())
                    f.write(f'{{"version": "2.1.0", "runs": [{{"tool": {{"driver": {{"name": "loomgraph"}}}}, "results": [\n{results}\n]}}]}}\n')
            if a.max_impacted is not None:
                exports.gate(hit, a.max_impacted)
        else:
            for name, rows in traverse.context(g, seeds, a.depth or 3).items():
                say(exports.report(name, rows.drop("attributes", "seq")))
    elif a.command == "architecture":
        edges = repository_edges(g)
        say(exports.report("modules", g.nodes.where("kind = 'MODULE'").select("id", "attributes").orderBy("id")))
        say(exports.report("couplings", architecture.coupling(g.edges.where("kind in ('CALLS', 'DEPENDS_ON')"), architecture.modules(g)).orderBy(F.col("weight").desc()).limit(3)))
        ids = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
        say(exports.report("central types", analytics.pagerank(ids, edges).orderBy(F.col("rank").desc(), "id").limit(10)))
        core = analytics.k_core(edges, a.k).select(F.col("a").alias("src"), F.col("b").alias("dst")) if a.k else edges
        say(exports.report("communities", analytics.communities(core.select(F.col("src").alias("id")).union(core.select("dst")).distinct(), core).orderBy(F.col("size").desc(), "community")))
    elif a.command == "ask":
        from loomgraph.sources import models

        encoder = models.open_encoder(a.model) if "dense" in descent.MODES[a.mode] else None
        r = repository.ask(g, [(1, a.subject)], anchors=a.anchors, depth=a.depth, mode=a.mode, encoder=encoder, beam=a.beam, budget_=a.budget)
        say(exports.report("fits the budget", r["fits"]))
        say(exports.report("plan", r["plan"]), exports.report("anchors", r["anchors"]))
        say(exports.report("claims", r["claims"].join(r["verdicts"], "claim_id").select("verdict", "statement").orderBy("verdict", "statement")))
    elif a.command == "index":
        nodes, links = derive.derive(g)
        if a.out:
            exports.write_tree(nodes, links, answers.fingerprint(g.nodes, g.edges).first()[0], a.out)
        say(exports.report("entries", derive.statistics(nodes).orderBy("kind")))
    elif a.command == "diff":
        changes = answers.diff(g, repository.load(spark, a.subject))
        say(exports.report("changes", changes.groupBy("change").count().orderBy("change")))
        say(exports.report("changed symbols", answers.changed_symbols(changes).orderBy("id")))
        after = repository.load(spark, a.subject)
        say(exports.report("what if", answers.what_if(after, changes, a.depth or 4, a.top).orderBy(F.col("score").desc(), "id"), a.top))
    elif a.command == "navigate":
        return navigate(g, a, say)
    elif a.command == "evaluate":
        return evaluate(spark, g, a, say)
    elif a.command == "enrich-apply":
        return enrich(spark, g, a, say)
    elif a.command in ("enrichment-plan", "enrich-targets"):
        if a.branches:
            c = tree.rank_branches(*derive.derive(g))
        else:
            c = budget.candidates(g.nodes, g.edges)
        tokens = F.floor((F.length("id") + F.length("name")) / 4) + 3
        items = c.select(F.struct((-F.col("score")).alias("a"), "id").alias("ord"), "id", tokens.alias("cost"))
        taken = budget.knapsack(items, a.budget).where("taken").orderBy("ord").limit(a.limit)
        if a.command == "enrichment-plan":
            say(exports.report("plan", taken.select("id", "cost")))
        else:
            rows = [r.asDict(recursive=True) for r in answers.packets(g, taken.select("id")).collect()]
            say(exports.packet_markdown(rows, a.source))
    elif a.command == "visualize":
        g = shown(spark, g, a)
        if a.format == "json":
            exports.write_json(g, a.out)
        elif a.format == "html":
            with open(a.out, "w", encoding="utf-8") as f:
                f.write(exports.view(g, a.source, a.max_nodes))
        else:
            rows = getattr(exports, a.format)(g).orderBy("part", "value")
            with open(a.out, "w", encoding="utf-8") as f:
                f.writelines(r["value"] + "\n" for r in rows.select("value").toLocalIterator())
    return 0


def shown(spark: SparkSession, g, a):
    """The graph within the kinds and around the symbol that are asked for."""
    from loomgraph.model import induced, scope

    if a.kind:
        g = scope(g, a.kind)
    if a.subject:
        found = answers.resolve_symbols(g.nodes, spark.createDataFrame([(a.subject,)], "query string")).first()
        if found is None:
            raise ValueError(f"no symbol matches {a.subject}")
        packet = traverse.context(g, spark.createDataFrame([(found["id"], found["id"])], "seed string, id string"), a.depth or 3)
        ids = spark.createDataFrame([(found["id"],)], "id string")
        for name in ("callers", "endpoints", "dependencies"):
            ids = ids.union(packet[name].select("id"))
        g = induced(g, g.nodes.join(ids.distinct(), "id", "left_semi"))
    return g


def quantize(a, say) -> int:
    """Writes an int8 form of a model folder and reports what it costs."""
    import os
    import shutil

    from loomgraph.sources import models

    matrix = models.read_tensor(os.path.join(a.source, "model.safetensors"), "embeddings")
    q, scales = models.quantized(matrix.astype("f8"))
    os.makedirs(a.out, exist_ok=True)
    models.write_tensors(os.path.join(a.out, "model.safetensors"), {"embeddings": q, "scales": scales})
    shutil.copy(os.path.join(a.source, "vocab.txt"), a.out)
    say(models.quantization_report(matrix.astype("f8")))
    return 0


def serve(spark: SparkSession, a, out) -> int:
    from loomgraph.plans.server import Server
    from loomgraph.plans.session import Session

    if a.source.endswith(".json"):
        raise ValueError("a graph file can't be served: nothing tells when it is stale")
    server = Server(Session(spark, a.source, repository.Layers(tests=not a.no_tests)))

    def write(text: str) -> None:
        out.write(text)
        out.flush()

    server.serve(sys.stdin, write)
    return 0


def navigate(g, a, say) -> int:
    """One step of a navigation, kept in --out; the first asks the subject's question."""
    import os

    from loomgraph.plans.session import Navigation

    nodes, links = derive.derive(g)
    own = answers.fingerprint(g.nodes, g.edges).first()[0]
    if a.out and os.path.exists(a.out):
        nav = Navigation.read(a.out, own)
        nav.choose(a.choose, links, nodes)
    else:
        nav = Navigation(a.subject, own, [derive.ROOT])
    if a.out:
        nav.write(a.out)
    for r in nav.presented(links, nodes):
        say(f"  {r['id']}  {r['kind']}  {r['name']}")
    if nav.complete:
        say("anchors:", ", ".join(nav.anchors))
    return 0


def evaluate(spark: SparkSession, g, a, say) -> int:
    """Scores a question set (the subject's file): how much of what is expected the impact or context of each
    question's subject names."""
    from loomgraph.operators import evaluate as E
    from loomgraph.sources import graph_json
    from loomgraph.store import cut

    q = cut(graph_json.questions(spark, a.subject), "questions")
    named = answers.resolve_symbols(g.nodes, q.select(F.col("subject").alias("query")))
    seeds = cut(q.join(named.withColumnRenamed("id", "node"), q["subject"] == named["query"]).select(q["id"].alias("seed"), F.col("node").alias("id")), "seeds")
    packet = traverse.context(g, seeds, a.depth or 4)
    parts = [packet[k].select("seed", "id") for k in ("callers", "endpoints", "dependencies")] + [traverse.impact(g, seeds, a.depth or 4).select("seed", "id")]
    every = parts[0].union(parts[1]).union(parts[2]).union(parts[3]).join(g.nodes.select("id", "name"), "id")
    said = F.array("id", "name", F.substring_index("name", ".", -1), F.substring_index(F.substring_index("id", "#", 1), ".", -1))
    got = every.select(F.col("seed").alias("qid"), F.explode(said).alias("id"))
    expected = q.select(F.col("id").alias("qid"), F.explode("expected").alias("id"))
    r = cut(E.recall(q.select(F.col("id").alias("qid")), expected, got), "recall")
    say(str(r.agg(F.count(F.lit(1)).alias("questions"), F.round(F.avg("recall"), 3).alias("recall"), E.upper_median("expected").alias("median_expected")).first().asDict()))
    return 0 if a.fail_under is None or E.passes(r, a.fail_under) else 2


def enrich(spark: SparkSession, g, a, say) -> int:
    """Applies a claims file (the subject) and writes the graph to --out; --strict fails if any was rejected."""
    from loomgraph.sources import graph_json

    with open(a.subject, encoding="utf-8") as f:
        found = graph_json.claims(f.read())
    rows = [(c["claim_id"], c["subject"], c["kind"], c["value"], c["confidence"], c["ord"]) for c in found]
    claims = spark.createDataFrame(rows, "claim_id string, subject string, kind string, value string, confidence double, ord int")
    cites = spark.createDataFrame([(c["claim_id"], *x) for c in found for x in c["citations"]], "claim_id string, src string, dst string, kind string")
    verdicts = answers.verify_claims(claims, cites, g.nodes, g.edges)
    nodes, rejected = answers.merge_claims(g.nodes, claims, verdicts)
    if a.out:
        exports.write_json(type(g)(nodes.select(*g.nodes.columns), g.edges), a.out)
    lost = rejected.count()
    say(f"{len(rows) - lost} claims applied, {lost} rejected", exports.report("rejected", rejected.orderBy("claim_id")))
    return 3 if a.strict and lost else 0


def repository_edges(g):
    from loomgraph.model import lifted

    return lifted(g)


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
