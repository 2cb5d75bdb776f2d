"""Queries of descent, retrieval modes, merged packets, what-if and evaluation over the tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomgraph import catalogue
from loomgraph.model import Graph
from loomgraph.operators import answers, evaluate, navigate, retrieval, traverse, tree
from loomgraph.registered import ORACLES, QUERIES, query
from loomgraph.sources.tables import star_graph, table
from loomgraph.store import cut

_KINDS, _ENTRIES, _ENTITIES = tuple(navigate.AFFINITY), ("ENDPOINT", "TABLE", "TYPE", "MEMBER", "MODULE", "PACKAGE", "CAPABILITY", "GROUP"), ("CONTROLLER", "ENTITY", "SERVICE")


@query("affinity", """WITH c AS (SELECT c_custkey, c_custkey % 6 AS k, c_nationkey % 8 AS e, c_custkey % 3 AS y FROM customer)
 SELECT c_custkey, (CASE k
  WHEN 0 THEN CASE WHEN e = 0 THEN 1.8 WHEN e = 6 THEN 1.5 WHEN e = 2 AND y = 0 THEN 1.4 WHEN e = 3 THEN 0.8 ELSE 0.9 END
  WHEN 1 THEN CASE WHEN e = 1 THEN 1.8 WHEN e = 2 AND y = 1 THEN 1.5 WHEN e = 6 THEN 1.1 ELSE 0.9 END
  WHEN 2 THEN CASE WHEN e IN (0, 6) THEN 1.3 WHEN e = 2 THEN 1.1 ELSE 0.9 END
  WHEN 3 THEN CASE WHEN e = 4 THEN 1.8 WHEN e = 5 THEN 1.5 WHEN e = 6 THEN 1.2 WHEN e = 3 THEN 0.5 ELSE 0.9 END
  WHEN 4 THEN CASE WHEN e = 2 THEN 1.4 WHEN e = 3 THEN 1.1 WHEN e = 6 THEN 0.8 ELSE 1.0 END
  ELSE CASE WHEN e = 2 THEN 1.3 WHEN e = 3 THEN 1.1 ELSE 1.0 END END)::DOUBLE AS affinity FROM c""")
def affinity(spark, sf_dir):
    pick = lambda names, key, n: F.element_at(F.array(*[F.lit(x) for x in names]), (F.col(key) % n + 1).cast("int"))
    value = navigate.affinity(pick(_KINDS, "c_custkey", 6), pick(_ENTRIES, "c_nationkey", 8), pick(_ENTITIES, "c_custkey", 3))
    return table(spark, sf_dir, "customer").select("c_custkey", value.alias("affinity"))


def _library(spark, sf_dir):
    """(plan, links, entries, scores): sources over documents as a table of contents, and the questions' scores."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select(F.concat(F.lit("source:"), F.coalesce("source", F.lit(""))).alias("source"), F.concat(F.lit("doc:"), "doc_id").alias("doc"))
    links = docs.select(F.col("source").alias("parent"), F.col("doc").alias("child")).union(docs.select(F.lit("root"), "source").distinct())
    entries = docs.select(F.col("doc").alias("id"), F.lit("TYPE").alias("kind")).union(docs.select("source", F.lit("GROUP")).distinct()).withColumn("entity", F.lit(""))
    plan = spark.createDataFrame([(q, "LOOKUP") for q, _ in catalogue.QUESTIONS], "qid long, kind string")
    return plan, links, entries, cut(QUERIES["subtree_bm25"](spark, sf_dir), "scores")


_NOBODY = "qid long, id string"
_DESCENT = f"""s AS ({ORACLES["subtree_bm25"]}), q AS (SELECT unnest(range(1, {len(catalogue.QUESTIONS) + 1})) AS qid),
 d AS (SELECT 'source:' || coalesce(source, '') AS parent, 'doc:' || doc_id AS id FROM documents WHERE text IS NOT NULL),
 one AS (SELECT q.qid, p.parent AS id, coalesce(s.score, 0) AS score FROM q CROSS JOIN (SELECT DISTINCT parent FROM d) p LEFT JOIN s ON s.qid = q.qid AND s.id = p.parent),
 two AS (SELECT qid, id, score FROM one QUALIFY row_number() OVER (PARTITION BY qid ORDER BY {{first}}) <= 4),
 kids AS (SELECT two.qid, two.id AS parent, two.score AS above, d.id, 0.5 * two.score + 1.3 * coalesce(s.score, 0) AS score FROM two JOIN d ON d.parent = two.id LEFT JOIN s ON s.qid = two.qid AND s.id = d.id),
 kept AS (SELECT * FROM kids QUALIFY row_number() OVER (PARTITION BY qid, parent ORDER BY {{second}}) <= 4),
 low AS (SELECT qid, id, score FROM kept QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) <= 4),
 high AS (SELECT qid, parent AS id, any_value(above) AS score FROM kids GROUP BY qid, parent HAVING any_value(above) >= max(score)),
 rooted AS (SELECT qid, 'root' AS id, 0.0 AS score FROM one GROUP BY qid HAVING max(score) <= 0),
 a AS (SELECT * FROM low UNION ALL SELECT * FROM high UNION ALL SELECT * FROM rooted)
 SELECT qid::BIGINT AS qid, id, round(score, 4) AS score, position FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)::INT AS position FROM a) WHERE position <= 10"""


def _landed(spark, sf_dir, choose=navigate.best_first):
    plan, links, entries, scores = _library(spark, sf_dir)
    nobody = spark.createDataFrame([], _NOBODY)
    found = navigate.descend(plan, links, entries, scores, nobody, nobody, "root", 4, 10, choose)["anchors"]
    return found.select("qid", "id", F.round("score", 4).alias("score"), "position")


@query("beam_descent", f"WITH {_DESCENT.format(first='score DESC, id', second='score DESC, id')}")
def beam_descent(spark, sf_dir):
    return _landed(spark, sf_dir)


@query("dense_descent", f"WITH {_DESCENT.format(first='length(id) DESC, id', second='length(id) DESC, id')}")
def dense_descent(spark, sf_dir):
    """A descent whose branches are chosen by a similarity (here the length of an entry's id) instead of by score."""
    _, links, _, _ = _library(spark, sf_dir)
    near = links.select(F.explode(F.array(*[F.lit(q).cast("long") for q, _ in catalogue.QUESTIONS])).alias("qid"), F.col("child").alias("id")).withColumn("similarity", F.length("id").cast("double"))
    return _landed(spark, sf_dir, navigate.by_similarity(near))


@query("oracle_descent", f"WITH t AS (SELECT doc_id, 'doc:' || doc_id AS id, 'source:' || coalesce(source, '') AS parent FROM documents WHERE text IS NOT NULL AND doc_id % 97 = 5), {_DESCENT}".format(
    first="CASE WHEN id IN (SELECT parent FROM t) THEN 0 ELSE 1 END, score DESC, id", second="CASE WHEN id IN (SELECT id FROM t) THEN 0 ELSE 1 END, score DESC, id").replace(
    "kept AS (SELECT * FROM kids QUALIFY", "kept AS (SELECT * FROM kids WHERE id IN (SELECT id FROM t) OR parent NOT IN (SELECT parent FROM t) QUALIFY").replace(
    "two AS (SELECT qid, id, score FROM one QUALIFY", "two AS (SELECT qid, id, score FROM one WHERE id IN (SELECT parent FROM t) OR NOT EXISTS (SELECT 1 FROM t) QUALIFY"))
def oracle_descent(spark, sf_dir):
    """A descent that takes the branches to known targets where there are some."""
    _, links, _, _ = _library(spark, sf_dir)
    ids = table(spark, sf_dir, "documents").where("text is not null").select(F.concat(F.lit("doc:"), "doc_id").alias("id"), F.col("doc_id").alias("graph_id"))
    wanted = ids.where("graph_id % 97 = 5").select(F.explode(F.array(*[F.lit(q).cast("long") for q, _ in catalogue.QUESTIONS])).alias("qid"), "graph_id")
    return _landed(spark, sf_dir, navigate.on_path(navigate.paths_to(tree.closure(links), ids, wanted)))


_MODES = ("BM25", "TREE", "HYBRID", "DENSE_HYBRID")


@query("retrieval_modes", """WITH p AS (SELECT s_nationkey AS qid, s_suppkey AS id, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS named, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS tree,
  row_number() OVER (PARTITION BY s_nationkey ORDER BY s_name DESC, s_suppkey) AS dense, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS flat FROM supplier),
 u AS (SELECT m, qid, id, 0 AS o, named AS r FROM p, (SELECT unnest(['BM25', 'HYBRID', 'DENSE_HYBRID']) AS m) WHERE named = 1 UNION ALL SELECT m, qid, id, 1, tree FROM p, (SELECT unnest(['TREE', 'HYBRID']) AS m) WHERE tree <= 2
  UNION ALL SELECT 'DENSE_HYBRID', qid, id, 2, dense FROM p WHERE dense <= 2 UNION ALL SELECT m, qid, id, 3, flat FROM p, (SELECT unnest(['BM25', 'HYBRID', 'DENSE_HYBRID']) AS m)),
 f AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY m, qid, id ORDER BY o, r) = 1)
 SELECT m AS mode, qid, id, position FROM (SELECT *, row_number() OVER (PARTITION BY m, qid ORDER BY o, r, id)::INT AS position FROM f) WHERE position <= 4""")
def retrieval_modes(spark, sf_dir):
    """What each mode leads with, over ranked suppliers of a nation."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("qid"), F.col("s_suppkey").alias("id"), "s_name", "s_acctbal")

    def ranked(*order, most=None):
        rows = s.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order, "id")))
        return rows.where(F.col("rank") <= most) if most else rows

    parts = {"named": ranked(most=1), "tree": ranked("s_acctbal", most=2), "dense": ranked(F.col("s_name").desc(), most=2), "flat": ranked(F.col("s_acctbal").desc())}
    out = None
    for mode in _MODES:
        one = navigate.anchors_of(mode, parts, 4).select(F.lit(mode).alias("mode"), "qid", "id", "position")
        out = one if out is None else out.union(one)
    return out


# ---- dense tree


def _labels(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("vec:"), "vec_id").alias("id"), F.concat(F.lit("label:"), "label").alias("label"), F.col("embedding").alias("v"))
    links = e.select(F.col("label").alias("parent"), F.col("id").alias("child")).union(e.select(F.lit("root"), "label").distinct())
    return e.select("id", "v"), links


_UNIT = """u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
 w AS (SELECT vec_id, label, CASE WHEN list_dot_product(v, v) = 0 THEN v ELSE list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) END AS v FROM u),
 x AS (SELECT 'label:' || label AS id, generate_subscripts(v, 1) - 1 AS i, unnest(v) AS x FROM w)"""


@query("subtree_centroids", f"""WITH {_UNIT}, m AS (SELECT id, i, avg(x) AS x FROM x GROUP BY ALL), l AS (SELECT id, i, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS x FROM m),
 r AS (SELECT 'root' AS id, i, avg(x) AS x FROM l GROUP BY i)
 SELECT id, i::INT AS i, round(x, 6) AS value FROM l UNION ALL SELECT id, i::INT, round(x / sqrt(sum(x * x) OVER ()), 6) FROM r""")
def subtree_centroids(spark, sf_dir):
    vectors, links = _labels(spark, sf_dir)
    return navigate.folded_centroids(links, vectors).where("id not like 'vec:%'").select("id", "i", F.round("value", 6).alias("value"))


@query("dense_tree_score", f"""WITH {_UNIT}, m AS (SELECT id, i, avg(x) AS x FROM x GROUP BY ALL UNION ALL SELECT 'root', i, avg(x) FROM x GROUP BY i), n AS (SELECT id, sqrt(sum(x * x)) AS n FROM m GROUP BY id),
 q AS (SELECT vec_id AS qid, generate_subscripts(v, 1) - 1 AS i, unnest(v) AS y FROM w WHERE vec_id % 50 = 0)
 SELECT qid, id, round(sum(x * y) / any_value(n), 6) AS similarity FROM m JOIN n USING (id) JOIN q USING (i) GROUP BY qid, id""")
def dense_tree_score(spark, sf_dir):
    """The stated queries against the mean vector of every branch."""
    vectors, links = _labels(spark, sf_dir)
    folded = retrieval.fold_subtrees(vectors, tree.closure(links)).where("anc not like 'vec:%'").withColumnRenamed("anc", "id")
    asked = table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    return navigate.subtree_similarity(folded, asked).select("qid", "id", F.round("similarity", 6).alias("similarity"))


@query("embedded_nodes", """SELECT 'SERVICE' AS kind, count(*) AS n FROM customer UNION ALL SELECT 'MODULE', count(*) FROM region UNION ALL SELECT 'TYPE', count(*) FROM nation""")
def embedded_nodes(spark, sf_dir):
    return navigate.embedded(star_graph(spark, sf_dir).nodes).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


# ---- packets, what-if


@query("packet_merge", """WITH s AS (SELECT s_nationkey AS grp, 'supplier:' || s_suppkey AS id, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey)::INT AS position FROM supplier),
 e AS (SELECT DISTINCT 'order:' || l_orderkey || '#' || l_linenumber AS line, 'supplier:' || l_suppkey AS id FROM lineitem),
 c AS (SELECT grp, 'callers' AS part, line AS id, min(position) AS position FROM e JOIN s USING (id) GROUP BY ALL),
 d AS (SELECT grp, 'dependencies' AS part, 'nation:' || grp AS id, min(position) AS position FROM s GROUP BY grp)
 SELECT * FROM c UNION ALL SELECT * FROM d""")
def packet_merge(spark, sf_dir):
    """The suppliers of a nation as the anchors of one answer: callers and dependencies of their merged packet."""
    g = star_graph(spark, sf_dir)
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("group"), F.concat(F.lit("supplier:"), "s_suppkey").alias("id"))
    s = s.withColumn("position", F.row_number().over(Window.partitionBy("group").orderBy(F.substring_index("id", ":", -1).cast("long"))))
    packet = traverse.context(g, s.select(F.col("id").alias("seed"), "id"), 1)
    merged = navigate.merged(packet, s.select("group", F.col("id").alias("seed"), "position"))
    parts = [merged[p].select(F.col("group").alias("grp"), F.lit(p).alias("part"), "id", "position") for p in ("callers", "dependencies")]
    return parts[0].union(parts[1])


@query("what_if", """WITH b AS (SELECT * FROM orders WHERE o_orderdate < '2000-01-01'), a AS (SELECT * FROM orders WHERE o_orderdate >= '1994-06-01'),
 ch AS (SELECT o_custkey AS k FROM a WHERE o_orderkey NOT IN (SELECT o_orderkey FROM b) UNION SELECT o_custkey FROM b WHERE o_orderkey NOT IN (SELECT o_orderkey FROM a)),
 n AS (SELECT k, (SELECT count(*) FROM a WHERE o_custkey = k) AS n FROM ch WHERE k IN (SELECT o_custkey FROM a))
 SELECT 'type:' || k AS id, n * 7.0::DOUBLE AS score, CASE WHEN n * 7 >= 60 THEN 'HIGH' WHEN n * 7 >= 20 THEN 'MEDIUM' WHEN n > 0 THEN 'LOW' ELSE 'NONE' END AS band, n AS impacted FROM n ORDER BY score DESC, id LIMIT 10""")
def what_if(spark, sf_dir):
    """Customers whose orders differ between two snapshots, by what their change puts at risk in the later one."""

    def at(when):
        o = table(spark, sf_dir, "orders").where(when)
        nodes = o.selectExpr("concat('type:', o_custkey) AS id", "'TYPE' AS kind").distinct().union(o.selectExpr("concat('endpoint:', o_orderkey)", "'ENDPOINT'"))
        place = "'key' AS resolver, 1.0D AS confidence".split(", ")
        edges = o.selectExpr("concat('type:', o_custkey) AS src", "concat('x:', o_orderkey) AS dst", "'CALLS' AS kind", *place)
        return Graph(nodes, edges.union(o.selectExpr("concat('endpoint:', o_orderkey)", "concat('type:', o_custkey)", "'EXPOSES'", *place)))

    before, after = at("o_orderdate < '2000-01-01'"), at("o_orderdate >= '1994-06-01'")
    return answers.what_if(after, answers.diff(before, after), 2, 10)


# ---- evaluation


@query("precision", """WITH x AS (SELECT c_custkey AS qid, count(o_orderkey) AS returned, count(CASE WHEN o_orderpriority < '3' THEN 1 END) AS "right" FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY 1)
 SELECT qid, returned, "right", round(CASE WHEN returned = 0 THEN 1.0 ELSE "right" / returned END, 6) AS precision FROM x""")
def precision(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    rows = lambda when: orders.where(when).select(F.col("o_custkey").alias("qid"), F.col("o_orderkey").alias("id"))
    p = evaluate.precision(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("qid")), rows("o_orderpriority < '3'"), rows("o_orderstatus = 'F'"))
    return p.select("qid", "returned", "right", F.round("precision", 6).alias("precision"))


@query("location_recall", """WITH e AS (SELECT DISTINCT c_custkey AS qid, 'n' || c_nationkey || '/' || c_mktsegment AS file FROM customer UNION SELECT c_custkey, 'nowhere' FROM customer),
 v AS (SELECT DISTINCT c_custkey AS qid, 'src/n' || c_nationkey || '/' || c_mktsegment AS file FROM customer WHERE c_acctbal > 0)
 SELECT qid, avg(CASE WHEN EXISTS (SELECT 1 FROM v WHERE v.qid = e.qid AND ends_with(v.file, '/' || e.file)) THEN 1.0 ELSE 0.0 END)::DOUBLE AS recall FROM e GROUP BY qid""")
def location_recall(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    place = F.concat(F.lit("n"), "c_nationkey", F.lit("/"), "c_mktsegment")
    expected = c.select(F.col("c_custkey").alias("qid"), place.alias("file")).union(c.select("c_custkey", F.lit("nowhere")))
    return evaluate.locations(expected, c.where("c_acctbal > 0").select(F.col("c_custkey").alias("qid"), F.concat(F.lit("src/"), place).alias("file")))


@query("groundedness", """SELECT l_suppkey AS qid, round(avg(CASE WHEN l_linenumber > 1 AND 1 - l_discount >= 0.95 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS groundedness FROM lineitem GROUP BY 1""")
def groundedness(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("qid"), F.lit("lineitem").alias("file"), (F.col("l_linenumber") - 1).alias("line"), (1 - F.col("l_discount")).alias("confidence"))
    asked = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("qid"), F.lit(0.95).alias("min_confidence"))
    return evaluate.groundedness(asked, lines).select("qid", F.round("groundedness", 6).alias("groundedness"))


@query("reaching_ranks", """WITH a AS (SELECT l_orderkey AS qid, l_linenumber AS position, CASE l_linenumber % 3 WHEN 0 THEN 'order:' || l_orderkey || '#' || l_linenumber WHEN 1 THEN 'order:' || (l_orderkey + 1) ELSE 'customer:' || o_custkey END AS id FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
 s AS (SELECT o_orderkey AS qid, o_custkey AS c FROM orders)
 SELECT s.qid, coalesce(min(CASE WHEN split_part(a.id, '#', 1) = 'order:' || s.qid OR a.id = 'customer:' || c THEN position END), 0)::INT AS rank FROM s LEFT JOIN a ON a.qid = s.qid GROUP BY s.qid""")
def reaching_ranks(spark, sf_dir):
    """Orders as subjects that customers hold; anchors are their lines, other orders and their customers."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    anchors = lines.selectExpr("l_orderkey AS qid", "CASE l_linenumber % 3 WHEN 0 THEN concat('order:', l_orderkey, '#', l_linenumber) WHEN 1 THEN concat('order:', l_orderkey + 1) ELSE concat('customer:', o_custkey) END AS id", "l_linenumber AS position")
    held = orders.selectExpr("concat('customer:', o_custkey) AS src", "concat('order:', o_orderkey) AS dst", "'CONTAINS' AS kind")
    subjects = orders.selectExpr("o_orderkey AS qid", "concat('order:', o_orderkey) AS subject")
    return evaluate.reaching_ranks(anchors, subjects, held).select("qid", F.coalesce("rank", F.lit(0)).cast("int").alias("rank"))


@query("baseline_report", """SELECT count(*) AS questions, round(avg(c_acctbal), 6) AS graph_recall, round(avg(c_custkey), 6) AS graph_evidence, round(avg(c_nationkey), 6) AS graph_size,
 round(avg(c_acctbal / 2), 6) AS search_recall, round(avg(c_custkey % 5), 6) AS search_evidence, round(avg(c_nationkey * 3), 6) AS search_size FROM customer""")
def baseline_report(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    one = c.selectExpr("c_custkey AS qid", "c_acctbal AS recall", "c_custkey AS evidence", "c_nationkey AS size")
    return evaluate.baseline_report(one, c.selectExpr("c_custkey AS qid", "c_acctbal / 2 AS recall", "c_custkey % 5 AS evidence", "c_nationkey * 3 AS size"))


@query("oracle_targets", """SELECT n_nationkey AS qid, unnest(['nation:' || n_nationkey, 'customer:' || n_nationkey]) AS graph_id FROM nation""")
def oracle_targets(spark, sf_dir):
    q = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("qid"), F.col("n_name").alias("subject"), F.array(F.concat(F.lit("customer:"), "n_nationkey"), F.lit("no such name")).alias("expected"))
    return evaluate.targets(star_graph(spark, sf_dir).nodes, q)


# ---- claims and names


@query("claims_generated", """WITH e AS (SELECT DISTINCT 'order:' || l_orderkey AS seed, 'order:' || l_orderkey || '#' || l_linenumber AS src, 'supplier:' || l_suppkey AS dst FROM lineitem)
 SELECT seed, sha256(concat_ws('|', seed, src, dst, 'CONSUMES')) AS claim_id, seed AS subject, src || ' consumes ' || dst AS statement FROM e""")
def claims_generated(spark, sf_dir):
    """A claim an edge of the lines of every order, about the order."""
    e = star_graph(spark, sf_dir).edges.where("kind = 'CONSUMES'").select(F.substring_index("src", "#", 1).alias("seed"), "src", "dst", "kind").distinct()
    anchors = table(spark, sf_dir, "orders").select(F.concat(F.lit("order:"), "o_orderkey").alias("seed")).withColumn("anchor", F.col("seed"))
    return answers.claims_from(e, anchors).select("seed", "claim_id", "subject", "statement")


@query("claims_merged", """WITH c AS (SELECT o_custkey AS k, o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'SUMMARY' WHEN 1 THEN 'DISPUTE' WHEN 2 THEN 'RISK' ELSE 'SUMMARY' END AS kind, CASE WHEN o_orderkey % 7 = 0 THEN ' ' ELSE 'says ' || o_orderkey END AS value, o_orderstatus <> 'P' AS fine FROM orders),
 u AS (SELECT * FROM c WHERE kind <> 'DISPUTE' AND trim(value) <> '' AND fine QUALIFY row_number() OVER (PARTITION BY k, kind ORDER BY o_orderkey DESC) = 1)
 SELECT 'customer:' || c_custkey AS id, max(CASE WHEN kind = 'SUMMARY' THEN value END) AS summary, max(CASE WHEN kind = 'RISK' THEN value END) AS risk, coalesce(max(CASE WHEN kind IS NOT NULL THEN '0.8' END), '') AS trust
 FROM customer LEFT JOIN u ON k = c_custkey GROUP BY 1""")
def claims_merged(spark, sf_dir):
    """Claims about customers, by their orders: disputes, blank values and unsupported ones are left out, the last of a
    kind wins, and confidence is cut to 0.80."""
    o = table(spark, sf_dir, "orders")
    kind = "CASE o_orderkey % 4 WHEN 0 THEN 'SUMMARY' WHEN 1 THEN 'DISPUTE' WHEN 2 THEN 'RISK' ELSE 'SUMMARY' END AS kind"
    claims = o.selectExpr("concat('c', o_orderkey) AS claim_id", "concat('customer:', o_custkey) AS subject", kind, "CASE WHEN o_orderkey % 7 = 0 THEN ' ' ELSE concat('says ', o_orderkey) END AS value", "0.9D AS confidence", "o_orderkey AS ord")
    verdicts = o.selectExpr("concat('c', o_orderkey) AS claim_id", "CASE WHEN o_orderstatus <> 'P' THEN 'SUPPORTED' ELSE 'UNSUPPORTED_MISSING_CITATION' END AS verdict")
    nodes = table(spark, sf_dir, "customer").select(F.concat(F.lit("customer:"), "c_custkey").alias("id"), F.create_map().cast("map<string,string>").alias("attributes"))
    a = F.col("attributes")
    merged, _ = answers.merge_claims(nodes, claims, verdicts)
    return merged.select("id", a["claim.summary"].alias("summary"), a["claim.risk"].alias("risk"), F.coalesce(a["claim.summary.confidence"], a["claim.risk.confidence"], F.lit("")).alias("trust"))


@query("claims_stripped", "SELECT c_custkey, 'kept ' || c_name AS note, 1::BIGINT AS n FROM customer")
def claims_stripped(spark, sf_dir):
    both = F.create_map(F.lit("claim.summary"), F.col("c_name"), F.lit("note"), F.concat(F.lit("kept "), "c_name"), F.lit("claim.risk"), F.lit("x"))
    out = answers.strip_claims(table(spark, sf_dir, "customer").select("c_custkey", both.alias("attributes")))
    return out.select("c_custkey", F.col("attributes")["note"].alias("note"), F.size("attributes").cast("long").alias("n"))


@query("work_packets", """WITH e AS (SELECT DISTINCT 'supplier:' || l_suppkey AS id, 'order:' || l_orderkey || '#' || l_linenumber AS src, 'CONSUMES' AS kind, 'supplier:' || l_suppkey AS dst FROM lineitem
  UNION SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'CONTAINS', 'supplier:' || s_suppkey FROM supplier UNION SELECT 'supplier:' || s_suppkey, 'supplier:' || s_suppkey, 'DEPENDS_ON', 'nation:' || s_nationkey FROM supplier)
 SELECT 'supplier:' || s_suppkey AS id, s_name AS name, count(*) AS citable, min(src || ' ' || e.kind || ' ' || dst) AS first FROM supplier JOIN e ON e.id = 'supplier:' || s_suppkey GROUP BY 1, 2""")
def work_packets(spark, sf_dir):
    """What a claim about each supplier may cite."""
    from loomgraph.sources.tables import as_graph_rows

    g = as_graph_rows(star_graph(spark, sf_dir))
    p = answers.packets(g, g.nodes.where("kind = 'EXTERNAL_SERVICE'").select("id"))
    said = F.array_min(F.transform("citable", lambda c: F.concat_ws(" ", c["src"], c["kind"], c["dst"])))
    return p.select("id", "name", F.size("citable").cast("long").alias("citable"), said.alias("first"))


@query("name_parts", """SELECT c_custkey, 'star.n' || c_nationkey || '.web' AS package, 'Customer' || c_custkey AS simple, '/n' || c_nationkey || '/c' || c_custkey AS path, '/c' || c_custkey AS alone, '<default>' AS none FROM customer""")
def name_parts(spark, sf_dir):
    from loomgraph.functions import text as X

    name = F.concat(F.lit("star.n"), "c_nationkey", F.lit(".web.Customer"), "c_custkey")
    path = X.join_paths(F.concat(F.lit("n"), "c_nationkey", F.lit("//")), F.concat(F.lit("c"), "c_custkey"))
    alone = X.join_paths(F.lit("/"), F.concat(F.lit("/c"), "c_custkey"))
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", X.package_from_name(name).alias("package"), X.simple_name(name).alias("simple"), path.alias("path"), alone.alias("alone"), X.package_from_name(F.concat(F.lit("Main"), "c_custkey")).alias("none"))


@query("kind_priors", """SELECT 'MODULE' AS kind, 1.3::DOUBLE AS prior UNION ALL SELECT 'TYPE', 1.15 UNION ALL SELECT 'SERVICE', 1.3 UNION ALL SELECT 'EXTERNAL_SERVICE', 1.3 UNION ALL SELECT 'DATABASE_TABLE', 1.3 UNION ALL SELECT 'ENDPOINT', 1.3 UNION ALL SELECT 'METHOD', 1.0""")
def kind_priors(spark, sf_dir):
    from loomgraph.functions import text as X

    return star_graph(spark, sf_dir).nodes.select("kind").distinct().select("kind", X.kind_prior(F.col("kind")).cast("double").alias("prior"))
