"""Symbol resolution, snapshot diff, claims and their verification, enrichment, risk."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import text as X
from loomgraph.model import Graph, canonical, owner
from loomgraph.store import cut

# Risk factors by name, the kind that counts and its weight.
RISK_FACTORS = (
    ("direct-callers", None, 1.0), ("transitive-callers", None, 0.5), ("exposed-endpoints", "ENDPOINT", 6.0), ("database-tables", "DATABASE_TABLE", 4.0),
    ("transaction-boundaries", "TRANSACTION", 3.0), ("topics", "TOPIC", 4.0), ("external-services", "EXTERNAL_SERVICE", 5.0),
    ("security-guards", "SECURITY_GUARD", 5.0), ("workflows", "WORKFLOW", 6.0),
)
MOST_CONFIDENT_CLAIM = 0.80


def resolve_symbols(nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, id, tier, alternatives): exact id, name of a source node, id suffix of a source node, any name, any
    id suffix; the first tier with a match, its least id. A suffix is a trailing part of the id that starts at
    an identifier boundary, so nodes are exploded to their possible suffixes and everything is an equi-join."""
    q = queries.select("query").distinct()
    source = F.col("kind") != "EXTERNAL_SYMBOL"
    # Boundaries: what follows a character that no identifier has.
    cuts = F.filter(F.sequence(F.lit(2), F.length("id")), lambda i: ~F.substring(F.col("id"), i - 1, F.lit(1)).rlike("[A-Za-z0-9_$]"))
    suffixes = nodes.where(F.length("id") > 1).select("id", source.alias("source"), F.explode(F.transform(cuts, lambda i: F.substring(F.col("id"), i, F.length("id")))).alias("query"))
    rows = [
        nodes.select("id", F.col("id").alias("query"), F.lit(0).alias("tier")),
        nodes.select("id", F.col("name").alias("query"), F.when(source, 1).otherwise(3).alias("tier")),
        suffixes.select("id", "query", F.when(F.col("source"), 2).otherwise(4).alias("tier")),
    ]
    hits = reduce(DataFrame.union, [r.join(F.broadcast(q) if q.count() <= 100_000 else q, "query").select("query", "id", "tier") for r in rows]).groupBy("query", "id").agg(F.min("tier").alias("tier"))
    best = hits.groupBy("query").agg(F.min("tier").alias("tier"))
    return hits.join(best, ["query", "tier"]).groupBy("query", "tier").agg(F.min("id").alias("id"), (F.count(F.lit(1)) - 1).alias("alternatives")).select("query", "id", "tier", "alternatives")


def diff(before: Graph, after: Graph) -> DataFrame:
    """(change, what): added and removed nodes and edges, and edges that another resolver or confidence now
    supports; of parallel edges the last stands for all."""
    b, a = before.nodes.select("id").distinct(), after.nodes.select("id").distinct()
    nodes = a.join(b, "id", "left_anti").select(F.lit("node-added").alias("change"), F.col("id").alias("what"))
    nodes = nodes.union(b.join(a, "id", "left_anti").select(F.lit("node-removed"), "id"))

    def last(e):
        rank = F.struct(*[c for c in ("seq", "file", "line", "col", "resolver", "confidence") if c in e.columns])
        return e.groupBy("src", "dst", "kind").agg(F.max_by(F.struct("resolver", "confidence"), rank).alias("p"))

    e = last(before.edges).withColumnRenamed("p", "was").join(last(after.edges).withColumnRenamed("p", "now"), ["src", "dst", "kind"], "full")
    what = F.concat_ws("|", "src", "dst", "kind")
    change = F.when(F.col("was").isNull(), "edge-added").when(F.col("now").isNull(), "edge-removed").when(~F.col("was").eqNullSafe(F.col("now")), "edge-reresolved")
    return nodes.union(e.select(change.alias("change"), what.alias("what")).where("change is not null"))


def changed_symbols(changes: DataFrame, prefix: str = "type:") -> DataFrame:
    """Owners of added and removed nodes and of changed edges' sources, of one prefix."""
    ids = F.when(F.startswith(F.col("change"), F.lit("edge")), F.substring_index("what", "|", 1)).otherwise(F.col("what"))
    return changes.select(owner(ids).alias("id")).where(F.startswith(F.col("id"), F.lit(prefix))).distinct()


def risk(g: Graph, impacted: DataFrame, evidence: DataFrame) -> DataFrame:
    """(seed, score, band, impacted): weighted counts of what an impact (seed, id, depth) reaches, times the least
    confidence of its evidence (seed, confidence), to two decimals."""
    hit = impacted.join(g.nodes.select("id", "kind"), "id")
    raw = F.sum(F.when(F.col("depth") == 1, 1.0).otherwise(0.5))
    for _, kind, weight in RISK_FACTORS:
        if kind:
            raw = raw + F.sum(F.when(F.col("kind") == kind, weight).otherwise(0.0))
    counted = hit.groupBy("seed").agg(raw.alias("raw"), F.count(F.lit(1)).alias("impacted"))
    least = evidence.groupBy("seed").agg(F.min("confidence").alias("weakest"))
    score = F.floor(F.col("raw") * F.coalesce("weakest", F.lit(1.0)) * 100 + 0.5) / 100
    band = F.when(score >= 60, "HIGH").when(score >= 20, "MEDIUM").when(score > 0, "LOW").otherwise("NONE")
    return counted.join(least, "seed", "left").select("seed", score.alias("score"), band.alias("band"), "impacted")


def risk_factors(g: Graph, impacted: DataFrame) -> DataFrame:
    """(seed, factor, count, weight, contribution) of the factors that count."""
    hit = impacted.join(g.nodes.select("id", "kind"), "id")
    direct = F.when(F.col("depth") == 1, F.lit("direct-callers")).otherwise(F.lit("transitive-callers"))
    by_kind = F.create_map(*[F.lit(x) for name, kind, _ in RISK_FACTORS if kind for x in (kind, name)])
    weights = F.create_map(*[F.lit(x) for name, _, w in RISK_FACTORS for x in (name, w)])
    rows = hit.select("seed", direct.alias("factor")).union(hit.select("seed", by_kind[F.col("kind")])).where("factor is not null")
    return rows.groupBy("seed", "factor").agg(F.count(F.lit(1)).alias("count")).select("seed", "factor", "count", weights[F.col("factor")].alias("weight"), (F.col("count") * weights[F.col("factor")]).alias("contribution"))


def what_if(after: Graph, changes: DataFrame, depth: int = 4, top: int = 10) -> DataFrame:
    """(id, score, band, impacted): the changed types of a diff whose impact in the new graph is the riskiest, all of them
    in one run; a type that nothing depends on has 0."""
    from loomgraph.operators.traverse import impact, path_edges

    changed = cut(changed_symbols(changes).join(after.nodes.select("id").distinct(), "id", "left_semi"), "changed")
    found = cut(impact(after, changed.select(F.col("id").alias("seed"), "id"), depth), "what-if")
    scored = risk(after, found, path_edges(after, found)).withColumnRenamed("seed", "id")
    every = changed.join(scored, "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("band", F.lit("NONE")).alias("band"), F.coalesce("impacted", F.lit(0).cast("long")).alias("impacted"))
    return every.orderBy(F.col("score").desc(), "id").limit(top)


def claims_from(evidence: DataFrame, anchors: DataFrame) -> DataFrame:
    """(claim_id, subject, statement, src, dst, kind): a claim an edge (with seed), about the anchor (seed, anchor)
    that the edge touches: its source, target or their owners, in that order."""
    ends = F.array("src", "dst", owner("src"), owner("dst"))
    e = evidence.select("seed", "src", "dst", "kind", ends.alias("ends"))
    touching = e.join(anchors, "seed").where(F.array_contains("ends", F.col("anchor")))
    touching = touching.withColumn("b", F.struct(F.array_position("ends", F.col("anchor")).alias("at"), "anchor")).groupBy("seed", "src", "dst", "kind").agg(F.min("b").alias("b"))
    out = e.drop("ends").join(touching, ["seed", "src", "dst", "kind"], "left")
    statement = F.concat_ws(" ", "src", F.replace(F.lower("kind"), F.lit("_"), F.lit(" ")), "dst")
    return out.select("seed", F.sha2(F.concat_ws("|", "seed", "src", "dst", "kind"), 256).alias("claim_id"), F.coalesce("b.anchor", "src").alias("subject"), statement.alias("statement"), "src", "dst", "kind")


def verify_claims(claims: DataFrame, citations: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(claim_id, verdict) of claims (claim_id, subject) by their citations (claim_id, src, dst, kind). What isn't
    supported is withheld with the reason, not dropped."""
    known = nodes.select(F.col("id").alias("subject"), F.lit(True).alias("known")).distinct()
    there = edges.select("src", "dst", "kind", F.lit(True).alias("there")).distinct()
    cited = citations.join(there, ["src", "dst", "kind"], "left").join(claims.select("claim_id", "subject"), "claim_id")
    touches = (F.col("src") == F.col("subject")) | (F.col("dst") == F.col("subject")) | (owner("src") == F.col("subject")) | (owner("dst") == F.col("subject"))
    seen = cited.groupBy("claim_id").agg(F.count(F.lit(1)).alias("n"), F.every(F.coalesce("there", F.lit(False))).alias("all_there"), F.some(touches).alias("touches"))
    verdict = (
        F.when(F.col("n").isNull(), "UNSUPPORTED_MISSING_CITATION")
        .when(F.col("known").isNull(), "UNSUPPORTED_UNKNOWN_SYMBOL")
        .when(~F.col("all_there"), "UNSUPPORTED_CITATION_NOT_IN_GRAPH")
        .when(~F.col("touches"), "UNSUPPORTED_CITATION_UNRELATED")
        .otherwise("SUPPORTED")
    )
    return claims.join(known, "subject", "left").join(seen, "claim_id", "left").select("claim_id", verdict.alias("verdict"))


def merge_claims(nodes: DataFrame, claims: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes with claim.* attributes, rejected (claim_id, reason)): supported claims (claim_id, subject, kind, value,
    confidence, ord) become attributes of their subjects, the last of a kind wins, confidence 0.80 at most; a
    dispute is never applied, nor is a blank value; edges are never added."""
    judged = claims.join(verdicts, "claim_id").withColumn(
        "reason",
        F.when(F.upper("kind") == "DISPUTE", "dispute").when(F.trim(F.coalesce("value", F.lit(""))) == "", "blank").when(F.col("verdict") != "SUPPORTED", F.col("verdict")),
    )
    w = Window.partitionBy("subject", "kind").orderBy(F.col("ord").desc(), F.col("claim_id").desc())
    used = judged.where("reason is null").withColumn("_n", F.row_number().over(w)).where("_n = 1")
    entry = F.struct(F.concat(F.lit("claim."), F.lower("kind")).alias("key"), F.trim("value").alias("value"))
    trust = F.struct(F.concat(F.lit("claim."), F.lower("kind"), F.lit(".confidence")).alias("key"), F.least("confidence", F.lit(MOST_CONFIDENT_CLAIM)).cast("string").alias("value"))
    added = used.groupBy("subject").agg(F.map_from_entries(F.array_sort(F.flatten(F.collect_list(F.array(entry, trust))))).alias("added"))
    merged = nodes.join(added, nodes["id"] == added["subject"], "left").drop("subject")
    attributes = F.when(F.col("added").isNull(), F.col("attributes")).otherwise(F.map_concat(F.map_filter("attributes", lambda k, v: ~F.array_contains(F.map_keys("added"), k)), "added"))
    return merged.withColumn("attributes", attributes).drop("added"), judged.where("reason is not null").select("claim_id", "reason")


def strip_claims(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("attributes", F.map_filter("attributes", lambda k, v: ~F.startswith(k, F.lit("claim."))))


def fingerprint(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: SHA-256 over the sorted hashes of all rows in canonical form, gathered in three levels by their
    first digits, so that no array has more than a 16-millionth of the hashes or 4096 sums."""
    n = nodes.select(F.sha2(F.concat_ws("\x1f", F.lit("n"), "id", "kind", "name", canonical("attributes")), 256).alias("h"))
    e = edges.select(F.sha2(F.concat_ws("\x1f", F.lit("e"), "src", "dst", "kind", canonical("attributes"), "file", F.col("line").cast("string"), F.col("col").cast("string")), 256).alias("h"))
    parts = n.union(e).groupBy(F.substring("h", 1, 6).alias("p")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("h"))
    joined = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "h"))), lambda x: x["h"]), ""), 256)
    return parts.groupBy(F.substring("p", 1, 3).alias("q")).agg(joined.alias("h")).withColumnRenamed("q", "p").agg(joined.alias("fingerprint"))


def plan_anchors(parts: list[DataFrame], limit: int) -> DataFrame:
    """(qid, id, position) from ranked sources (qid, id, rank), the sources in order of trust; a node once."""
    rows = reduce(DataFrame.union, [p.select("qid", "id", F.lit(i).alias("source"), "rank") for i, p in enumerate(parts)])
    first = rows.groupBy("qid", "id").agg(F.min(F.struct("source", "rank")).alias("b"))
    w = Window.partitionBy("qid").orderBy("b.source", "b.rank", "id")
    return first.withColumn("position", F.row_number().over(w)).where(F.col("position") <= limit).select("qid", "id", "position")


def packets(g: Graph, ids: DataFrame) -> DataFrame:
    """Work packets (id, kind, name, facts, evidence): what a claim about the node may cite, in order."""
    touching = g.edges.select(F.col("src").alias("id"), "src", "dst", "kind").union(g.edges.select("dst", "src", "dst", "kind")).join(ids, "id", "left_semi").distinct()
    cited = touching.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("src", "kind", "dst"))).alias("citable"))
    return g.nodes.join(ids, "id", "left_semi").join(cited, "id", "left").select("id", "kind", "name", canonical("attributes").alias("facts"), "citable")


def node_cost(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", X.node_tokens(F.col("id"), F.col("name")).alias("tokens"))
