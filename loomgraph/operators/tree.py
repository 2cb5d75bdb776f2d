"""The containment tree: closure, fan-out buckets, cards, subtree retrieval, branch ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import text as X
from loomgraph.operators.retrieval import asked_terms
from loomgraph.store import cut, is_empty

FAN_OUT = 24
# Weight of a branch by the kind of its node, and names that say nothing.
BRANCH_WEIGHTS = {"CAPABILITY": 1.5, "MODULE": 1.4, "PACKAGE": 1.2, "TYPE": 1.0, "ENDPOINT": 1.0, "TOPIC": 1.0, "TABLE": 1.0}
GENERIC_NAMES = ("util", "utils", "common", "core", "base", "impl", "internal", "misc", "helper", "helpers", "support", "api", "model", "service")


def closure(links: DataFrame) -> DataFrame:
    """(id, anc): every node of links (parent, child) with all that is above it and itself. Paths double in length
    each round, so a tree of depth d takes log2(d) rounds."""
    direct = links.select(F.col("child").alias("id"), F.col("parent").alias("anc")).distinct()
    ids = direct.select("id").union(direct.select("anc")).distinct()
    known = new = cut(direct, "closure")
    up = lambda x: x.select(F.col("id").alias("anc"), F.col("anc").alias("top"))
    while True:
        # Only what the last round found goes on, from either end.
        further = new.join(up(known), "anc").union(known.join(up(new), "anc")).select("id", F.col("top").alias("anc"))
        new = cut(further.distinct().join(known, ["id", "anc"], "left_anti"), "closure")
        if is_empty(new):
            return known.union(ids.select("id", F.col("id").alias("anc"))).distinct()
        known = known.union(new)


def depths(links: DataFrame, root: str) -> DataFrame:
    """(id, depth) below the root: the links of the shortest path, which in a tree is the only one."""
    from loomgraph.operators.traverse import reach

    start = links.sparkSession.createDataFrame([(root, root)], "seed string, id string")
    return reach(start, links.select(F.col("parent").alias("at"), F.col("child").alias("to"))).select("id", "depth")


def buckets(children: DataFrame, fan_out: int = FAN_OUT) -> DataFrame:
    """children (parent, child, ord) with `bucket`: a parent of more than fan_out children gets groups of
    ceil(n / fan_out) neighbours in order; others have one child a bucket."""
    w = Window.partitionBy("parent")
    n = F.count(F.lit(1)).over(w)
    size = F.ceil(n / fan_out).cast("long")
    rn = F.row_number().over(w.orderBy("ord", "child"))
    return children.select("parent", "child", "ord", F.floor((rn - 1) / size).cast("long").alias("bucket"))


def grouped(children: DataFrame, fan_out: int = FAN_OUT) -> DataFrame:
    """(parent, child, ord, name): children under groups until no parent has more than fan_out; a group is named
    after its first and last member."""
    done = None
    level = cut(children.select("parent", "child", "ord", "name"), "bucket")
    while True:
        many = level.groupBy("parent").count().where(F.col("count") > fan_out).select("parent")
        wide = level.join(many, "parent", "left_semi")
        fine = level.join(many, "parent", "left_anti")
        done = fine if done is None else done.unionByName(fine)
        if is_empty(wide):
            return done
        b = buckets(wide, fan_out).join(wide.select("parent", "child", "name"), ["parent", "child"])
        b = b.withColumn("group", F.concat_ws("/", F.lit("group"), "parent", F.col("bucket").cast("string")))
        heads = b.groupBy("parent", "group").agg(F.min("ord").alias("ord"), F.concat_ws(" to ", F.min_by("name", "ord"), F.max_by("name", "ord")).alias("name"))
        heads = heads.select("parent", F.col("group").alias("child"), "ord", "name")
        level = cut(heads.unionByName(b.select(F.col("group").alias("parent"), "child", "ord", "name")), "bucket")


def top_members(members: DataFrame, edges: DataFrame, most: int = FAN_OUT) -> DataFrame:
    """(owner, id) of each type's members with the most references, ties by id."""
    degree = edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("owner").orderBy(F.coalesce("n", F.lit(0)).desc(), "id")
    return members.join(degree, "id", "left").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).select("owner", "id")


def cards(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, kind, name, text): what a card says: name, kind, facts but numbers, and the names of its children."""
    below = links.join(nodes.select(F.col("id").alias("child"), F.col("name").alias("child_name")), "child").groupBy("parent").agg(F.array_join(F.slice(F.array_sort(F.collect_set("child_name")), 1, 6), " ").alias("exemplars"))
    facts = F.array_join(F.transform(F.filter(F.map_entries("facts"), lambda e: ~e["value"].rlike("^[0-9]+$")), lambda e: e["value"]), " ")
    return nodes.join(below, nodes["id"] == below["parent"], "left").select("id", "kind", "name", F.concat_ws(" ", "name", F.lower("kind"), facts, "exemplars").alias("text"))


def subtree_scores(cards_: DataFrame, links: DataFrame, questions: list[tuple[int, str]]) -> DataFrame:
    """(qid, id, score): BM25 in which frequencies and lengths are those of a card's whole subtree, while document
    frequency and count are those of single cards. Only asked terms are pooled up the closure."""
    spark = cards_.sparkSession
    asked = asked_terms(spark, questions)
    wanted = spark.createDataFrame(asked or [(0, "", 0)], "qid long, term string, mult long")
    known = F.array(*[F.lit(t) for t in sorted({t for _, t, _ in asked}) or [""]])
    up = cut(closure(links), "closure")
    base = cut(cards_.select("id", X.tokenize(F.col("text")).alias("ts")).select("id", F.size("ts").cast("long").alias("length"), F.filter("ts", lambda t: F.array_contains(known, t)).alias("ts")), "cards")
    alone = base.join(up.select("id").distinct(), "id", "left_anti").select("id", F.col("id").alias("anc"))
    up = up.union(alone)
    lengths = up.join(base.select("id", "length"), "id").groupBy("anc").agg(F.sum("length").alias("length"))
    stats = lengths.agg(F.count(F.lit(1)).alias("n"), F.greatest(F.avg("length"), F.lit(1.0)).alias("avg"))
    tf = base.select("id", F.explode("ts").alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    pooled = tf.join(up, "id").groupBy("anc", "term").agg(F.sum("tf").alias("tf"))
    # A row an asked term, and one row: sizes that the questions bound.
    rows = pooled.join(F.broadcast(df), "term").join(F.broadcast(wanted), "term").join(lengths, "anc").crossJoin(F.broadcast(stats))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("mult") * idf * F.col("tf") * 2.2 / (F.col("tf") + 1.2 * (0.25 + 0.75 * F.col("length") / F.col("avg")))
    return rows.groupBy("qid", "anc").agg(F.sum(part).alias("score")).select("qid", F.col("anc").alias("id"), "score")


def holding(links: DataFrame, names: DataFrame, questions: DataFrame) -> DataFrame:
    """(qid, id): branches that hold a question's subject (qid, subject) by exact name; declarations first, members
    only if no declaration has the name. names: (id, name, member)."""
    hit = names.join(questions, F.lower("name") == F.lower("subject"))
    tier = hit.groupBy("qid").agg(F.min(F.col("member").cast("int")).alias("tier"))
    own = hit.join(tier, "qid").where("cast(member as int) = tier").select("qid", "id")
    return own.join(closure(links), "id").select("qid", F.col("anc").alias("id")).union(own).distinct()


def rank_branches(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, score) of branches worth a summary: log of symbols below times log of choices, weighed by kind, double
    for a name that says nothing, a tenth for tests; root, groups, single-child and summarized ones left out."""
    up = closure(links)
    sizes = up.where("id <> anc").groupBy(F.col("anc").alias("id")).agg(F.count(F.lit(1)).alias("symbols"))
    choices = links.groupBy(F.col("parent").alias("id")).agg(F.countDistinct("child").alias("choices"))
    weight = F.create_map(*[F.lit(x) for kv in BRANCH_WEIGHTS.items() for x in kv])
    name = X.last_segment(F.col("name"))
    score = F.log1p("symbols") * F.log1p("choices") * F.when(name.isin(*GENERIC_NAMES), 2.0).otherwise(1.0) * F.coalesce(weight[F.col("kind")], F.lit(1.0))
    n = nodes.where("kind not in ('ROOT', 'GROUP')").where(F.col("facts")["claim.summary"].isNull())
    ranked = n.join(sizes, "id").join(choices, "id").where("choices >= 2")
    return ranked.select("id", "name", X.demote(score, X.is_test(F.col("name"), F.coalesce(F.col("facts")["file"], F.lit("")))).alias("score"))
