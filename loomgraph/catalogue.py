"""Every query by name, with the SQL that gives the same rows where SQL can.

All of them run over whole tables. Scores are rounded to 6 places, as sums of doubles depend on their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions import text as X
from loomgraph.functions import vectors as V
from loomgraph.model import Graph, dedup_edges, owner, scope, upsert_nodes
from loomgraph.operators import analytics, answers, budget, retrieval, traverse, tree
from loomgraph.registered import ORACLES, QUERIES, query
from loomgraph.sources.tables import as_graph_rows, part_supplier_pairs, star_graph, table
from loomgraph.store import cut

# The star graph in SQL; {..} as in sources.tables.
_E = """
e AS (
 SELECT 'region:' || n_regionkey AS src, 'nation:' || n_nationkey AS dst, 'CONTAINS' AS kind, 'key' AS resolver, 1.0::DOUBLE AS confidence, '' AS file, 0 AS line, 0 AS col FROM nation
 UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey, 'CONTAINS', 'key', 1.0, '', 0, 0 FROM customer
 UNION ALL SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey, 'CONTAINS', 'key', 1.0, '', 0, 0 FROM supplier
 UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey, 'DEPENDS_ON', 'key', 1.0, '', 0, 0 FROM nation
 UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'DEPENDS_ON', 'key', 1.0, '', 0, 0 FROM customer
 UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'DEPENDS_ON', 'key', 1.0, '', 0, 0 FROM supplier
 UNION ALL SELECT 'order:' || o_orderkey, 'customer:' || o_custkey, 'DEPENDS_ON', 'key', 1.0, '', 0, 0 FROM orders
 UNION ALL SELECT 'order:' || l_orderkey, 'order:' || l_orderkey || '#' || l_linenumber, 'DECLARES', l_returnflag, round(1 - l_discount, 2), 'lineitem', l_orderkey::INT, l_linenumber FROM lineitem
 UNION ALL SELECT 'order:' || l_orderkey || '#' || l_linenumber, 'part:' || l_partkey, 'CALLS', l_returnflag, round(1 - l_discount, 2), 'lineitem', l_orderkey::INT, l_linenumber FROM lineitem
 UNION ALL SELECT 'order:' || l_orderkey || '#' || l_linenumber, 'supplier:' || l_suppkey, 'CONSUMES', l_returnflag, round(1 - l_discount, 2), 'lineitem', l_orderkey::INT, l_linenumber FROM lineitem)"""
_N = """
n AS (
 SELECT 'region:' || r_regionkey AS id, 'MODULE' AS kind, r_name AS name FROM region
 UNION ALL SELECT 'nation:' || n_nationkey, 'TYPE', n_name FROM nation
 UNION ALL SELECT 'customer:' || c_custkey, 'SERVICE', c_name FROM customer
 UNION ALL SELECT 'supplier:' || s_suppkey, 'EXTERNAL_SERVICE', s_name FROM supplier
 UNION ALL SELECT 'part:' || p_partkey, 'DATABASE_TABLE', p_name FROM part
 UNION ALL SELECT 'order:' || o_orderkey, 'ENDPOINT', o_orderpriority FROM orders
 UNION ALL SELECT DISTINCT 'order:' || l_orderkey || '#' || l_linenumber, 'METHOD', 'line ' || l_linenumber FROM lineitem)"""
_BACK = "b AS (SELECT DISTINCT dst AS at, src AS nxt FROM e WHERE kind IN ('CALLS', 'CONSUMES', 'DEPENDS_ON'))"
_TOKENS = """
parts AS (SELECT {id} AS id, list_filter(regexp_split_to_array({text}, '[^A-Za-z0-9]+'), lambda p: p <> '') AS ps FROM {table}),
toks AS (SELECT id, list_filter(flatten(list_transform(ps, lambda p: list_concat([p], string_split(
   regexp_replace(regexp_replace(p, '([^A-Z])([A-Z])', '\\1 \\2', 'g'), '^([a-z0-9]) ', '\\1'), ' ')))), lambda t: length(t) > 1) AS ts FROM parts),
lens AS (SELECT id, len(ts) AS length FROM toks),
terms AS (SELECT id, lower(unnest(ts)) AS term FROM toks),
post AS (SELECT id, term, count(*) AS tf FROM terms GROUP BY ALL)"""


def _seeds(spark: SparkSession, *ids: str) -> DataFrame:
    return spark.createDataFrame([(i, i) for i in ids], "seed string, id string")


# ---- traversal


@query("impact_distance", f"""WITH RECURSIVE {_E}, {_BACK}, r(id, depth) AS (
 SELECT 'region:1', 0 UNION SELECT b.nxt, r.depth + 1 FROM r JOIN b ON b.at = r.id WHERE r.depth < 3)
 SELECT id, min(depth)::INT AS depth FROM r GROUP BY id HAVING min(depth) > 0""")
def impact_distance(spark, sf_dir):
    return traverse.impact(star_graph(spark, sf_dir), _seeds(spark, "region:1"), 3).select("id", "depth")


@query("impact_all_nations", f"""WITH RECURSIVE {_E}, {_BACK}, r(seed, id, depth) AS (
 SELECT 'nation:' || n_nationkey, 'nation:' || n_nationkey, 0 FROM nation
 UNION SELECT r.seed, b.nxt, r.depth + 1 FROM r JOIN b ON b.at = r.id WHERE r.depth < 2),
 f AS (SELECT seed, id, min(depth) AS depth FROM r GROUP BY ALL)
 SELECT seed, depth::INT AS depth, count(*) AS reached FROM f WHERE depth > 0 GROUP BY ALL""")
def impact_all_nations(spark, sf_dir):
    g = star_graph(spark, sf_dir)
    seeds = g.nodes.where("kind = 'TYPE'").select(F.col("id").alias("seed"), "id")
    return traverse.impact(g, seeds, 2).groupBy("seed", "depth").agg(F.count(F.lit(1)).alias("reached"))


@query("declared_closure", f"""WITH RECURSIVE {_E}, r(seed, id) AS (
 SELECT 'region:' || r_regionkey, 'region:' || r_regionkey FROM region
 UNION SELECT r.seed, e.dst FROM r JOIN e ON e.src = r.id WHERE e.kind = 'CONTAINS') SELECT seed, id FROM r""")
def declared_closure(spark, sf_dir):
    g = star_graph(spark, sf_dir)
    links = g.edges.where("kind = 'CONTAINS'").select(F.col("src").alias("at"), F.col("dst").alias("to"))
    return traverse.reach(g.nodes.where("kind = 'MODULE'").select(F.col("id").alias("seed"), "id"), links).select("seed", "id")


@query("tree_depth", f"""WITH RECURSIVE {_E}, r(seed, id, depth) AS (
 SELECT 'region:' || r_regionkey, 'region:' || r_regionkey, 0 FROM region
 UNION SELECT r.seed, e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.id WHERE e.kind = 'CONTAINS')
 SELECT seed, max(depth)::INT AS depth FROM r GROUP BY seed""")
def tree_depth(spark, sf_dir):
    g = star_graph(spark, sf_dir)
    links = g.edges.where("kind = 'CONTAINS'").select(F.col("src").alias("at"), F.col("dst").alias("to"))
    return traverse.reach(g.nodes.where("kind = 'MODULE'").select(F.col("id").alias("seed"), "id"), links).groupBy("seed").agg(F.max("depth").alias("depth"))


@query("subtree_sizes", f"""WITH RECURSIVE {_E}, c AS (SELECT src, dst FROM e WHERE kind = 'CONTAINS'), r(anc, id) AS (
 SELECT src, dst FROM c UNION SELECT r.anc, c.dst FROM r JOIN c ON c.src = r.id) SELECT anc, count(*) AS size FROM r GROUP BY anc""")
def subtree_sizes(spark, sf_dir):
    links = star_graph(spark, sf_dir).edges.where("kind = 'CONTAINS'").select(F.col("src").alias("parent"), F.col("dst").alias("child"))
    return tree.closure(links).where("anc <> id").groupBy("anc").agg(F.count(F.lit(1)).alias("size"))


@query("context_callers", f"""WITH RECURSIVE {_E}, {_N}, {_BACK}, r(id, depth) AS (
 SELECT 'nation:3', 0 UNION SELECT b.nxt, r.depth + 1 FROM r JOIN b ON b.at = r.id WHERE r.depth < 3)
 SELECT DISTINCT n.id, n.kind, n.name FROM r JOIN n USING (id) WHERE n.kind IN ('METHOD', 'TYPE') AND n.id <> 'nation:3'""")
def context_callers(spark, sf_dir):
    return traverse.context(star_graph(spark, sf_dir), _seeds(spark, "nation:3"), 3)["callers"].drop("seed")


@query("context_endpoints", f"""WITH RECURSIVE {_E}, {_N}, {_BACK}, r(id, depth) AS (
 SELECT 'nation:3', 0 UNION SELECT b.nxt, r.depth + 1 FROM r JOIN b ON b.at = r.id WHERE r.depth < 3)
 SELECT DISTINCT n.id, n.kind, n.name FROM r JOIN n USING (id) WHERE n.kind = 'ENDPOINT'""")
def context_endpoints(spark, sf_dir):
    return traverse.context(star_graph(spark, sf_dir), _seeds(spark, "nation:3"), 3)["endpoints"].drop("seed")


@query("downstream", f"""WITH {_E}, own AS (SELECT 'order:' || o_orderkey AS seed, 'order:' || o_orderkey AS id FROM orders
  UNION SELECT src, dst FROM e WHERE kind = 'DECLARES')
 SELECT seed, e.kind, count(*) AS n FROM own JOIN e ON e.src = own.id
 WHERE e.kind NOT IN ('DECLARES', 'CONTAINS') AND (e.kind <> 'CALLS' OR own.id = own.seed)
   AND seed IN (SELECT 'order:' || o_orderkey FROM orders) GROUP BY ALL""")
def downstream(spark, sf_dir):
    g = star_graph(spark, sf_dir)
    seeds = g.nodes.where("kind = 'ENDPOINT'").select(F.col("id").alias("seed"), "id")
    return traverse.downstream(g, seeds).groupBy("seed", "kind").agg(F.count(F.lit(1)).alias("n"))


# ---- graph tables


@query("induced_subgraph", f"""WITH {_E}, {_N}, k AS (SELECT id FROM n WHERE kind IN ('MODULE', 'TYPE', 'SERVICE'))
 SELECT src, dst, kind FROM e WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)""")
def induced_subgraph(spark, sf_dir):
    return scope(star_graph(spark, sf_dir), ["MODULE", "TYPE", "SERVICE"]).edges.select("src", "dst", "kind")


@query("degree_topk", f"""WITH {_E}, d AS (SELECT src AS id, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e)
 SELECT id, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree FROM d GROUP BY id ORDER BY sum(i + o) DESC, id LIMIT 20""")
def degree_topk(spark, sf_dir):
    d = analytics.degrees(star_graph(spark, sf_dir).edges)
    return d.orderBy((F.col("in_degree") + F.col("out_degree")).desc(), "id").limit(20)


_LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"


@query("edge_dedup_first", f"""SELECT l_orderkey::INT AS line, l_linenumber AS col, l_partkey, l_suppkey, l_discount FROM (
 SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_LINE.replace('l_orderkey, l_linenumber, ', '')}) AS rn FROM lineitem) WHERE rn = 1""")
def edge_dedup_first(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").selectExpr("*", "concat('order:', l_orderkey) AS src", "concat('order:', l_orderkey, '#', l_linenumber) AS dst", "'DECLARES' AS kind", "'lineitem' AS file", "cast(l_orderkey AS int) AS line", "l_linenumber AS col")
    return dedup_edges(lines, *_LINE.split(", ")[2:]).select("line", "col", "l_partkey", "l_suppkey", "l_discount")


@query("node_upsert_precedence", f"""WITH m AS (SELECT *, 'part:' || l_partkey AS id, l_linenumber = 1 AS declared, CASE WHEN l_returnflag = 'N' THEN 'EXTERNAL_SYMBOL' ELSE 'DATABASE_TABLE' END AS kind FROM lineitem),
 k AS (SELECT *, CASE WHEN declared THEN 0 WHEN kind <> 'EXTERNAL_SYMBOL' THEN 1 ELSE 2 END AS rk FROM m),
 b AS (SELECT * FROM k QUALIFY rk = min(rk) OVER (PARTITION BY id)),
 w AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY {_LINE}) AS first, row_number() OVER (PARTITION BY id ORDER BY {', '.join(c + ' DESC' for c in _LINE.split(', '))}) AS last FROM b)
 SELECT id, kind, declared, l_orderkey, l_linenumber FROM w WHERE CASE WHEN declared THEN last ELSE first END = 1""")
def node_upsert_precedence(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem").selectExpr("*", "concat('part:', l_partkey) AS id", "l_linenumber = 1 AS declared", "CASE WHEN l_returnflag = 'N' THEN 'EXTERNAL_SYMBOL' ELSE 'DATABASE_TABLE' END AS kind")
    return upsert_nodes(m, *_LINE.split(", ")).select("id", "kind", "declared", "l_orderkey", "l_linenumber")


@query("owner_lift", f"""WITH {_E} SELECT split_part(src, '#', 1) AS src, dst, count(*) AS n FROM e WHERE kind = 'CONSUMES' GROUP BY ALL""")
def owner_lift(spark, sf_dir):
    e = star_graph(spark, sf_dir).edges.where("kind = 'CONSUMES'")
    return e.groupBy(owner("src").alias("src"), "dst").agg(F.count(F.lit(1)).alias("n"))


def _snapshots(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")

    def at(when, resolver):
        o = orders.where(when)
        nodes = o.selectExpr("concat('type:', o_orderkey) AS id", "'TYPE' AS kind")
        return Graph(nodes, o.selectExpr("concat('type:', o_orderkey, '#pay') AS src", "concat('type:', o_custkey) AS dst", "'CALLS' AS kind", f"{resolver} AS resolver", "1.0D AS confidence", "o_orderkey AS seq"))

    return at("o_orderdate < '2000-01-01'", "o_orderpriority"), at("o_orderdate >= '1997-01-01'", "CASE WHEN o_orderstatus = 'F' THEN 'again' ELSE o_orderpriority END")


_DIFF = """b AS (SELECT 'type:' || o_orderkey AS id, 'type:' || o_orderkey || '#pay|type:' || o_custkey || '|CALLS' AS what, o_orderpriority AS r FROM orders WHERE o_orderdate < '2000-01-01'),
 a AS (SELECT 'type:' || o_orderkey AS id, 'type:' || o_orderkey || '#pay|type:' || o_custkey || '|CALLS' AS what, CASE WHEN o_orderstatus = 'F' THEN 'again' ELSE o_orderpriority END AS r FROM orders WHERE o_orderdate >= '1997-01-01'),
 d AS (SELECT 'node-added' AS change, id AS what FROM a WHERE id NOT IN (SELECT id FROM b) UNION ALL SELECT 'node-removed', id FROM b WHERE id NOT IN (SELECT id FROM a)
  UNION ALL SELECT CASE WHEN b.what IS NULL THEN 'edge-added' WHEN a.what IS NULL THEN 'edge-removed' ELSE 'edge-reresolved' END, coalesce(a.what, b.what)
  FROM b FULL JOIN a ON a.what = b.what WHERE a.r IS DISTINCT FROM b.r)"""


@query("snapshot_diff", f"WITH {_DIFF} SELECT change, what FROM d")
def snapshot_diff(spark, sf_dir):
    return answers.diff(*_snapshots(spark, sf_dir))


@query("changed_symbols", f"WITH {_DIFF} SELECT DISTINCT split_part(split_part(what, '|', 1), '#', 1) AS id FROM d")
def changed_symbols(spark, sf_dir):
    return answers.changed_symbols(answers.diff(*_snapshots(spark, sf_dir)))


@query("symbol_resolution", f"""WITH {_N}, q AS (SELECT n_name AS query FROM nation UNION SELECT r_name FROM region UNION SELECT 'customer:' || c_custkey FROM customer UNION SELECT '0' UNION SELECT 'line 3' UNION SELECT 'nowhere'),
 s AS (SELECT id, kind, name, substr(id, i) AS suf FROM (SELECT *, unnest(range(2, length(id) + 1)) AS i FROM n) WHERE NOT regexp_matches(substr(id, i - 1, 1), '[A-Za-z0-9_$]')),
 h AS (SELECT query, id, 0 AS tier FROM q JOIN n ON n.id = q.query UNION ALL SELECT query, id, 1 FROM q JOIN n ON n.name = q.query UNION ALL SELECT query, id, 2 FROM q JOIN s ON s.suf = q.query),
 m AS (SELECT query, id, min(tier) AS tier FROM h GROUP BY ALL), b AS (SELECT * FROM m QUALIFY tier = min(tier) OVER (PARTITION BY query))
 SELECT query, min(id) AS id, tier, count(*) - 1 AS alternatives FROM b GROUP BY query, tier""")
def symbol_resolution(spark, sf_dir):
    q = table(spark, sf_dir, "nation").select(F.col("n_name").alias("query")).union(table(spark, sf_dir, "region").select("r_name"))
    q = q.union(table(spark, sf_dir, "customer").select(F.concat(F.lit("customer:"), "c_custkey"))).union(spark.createDataFrame([("0",), ("line 3",), ("nowhere",)], "query string"))
    return answers.resolve_symbols(star_graph(spark, sf_dir).nodes, q)


@query("graph_fingerprint", f"""WITH {_E}, {_N}, h AS (SELECT sha256(concat_ws(chr(31), 'n', id, kind, name, '{{}}')) AS h FROM n
  UNION ALL SELECT sha256(concat_ws(chr(31), 'e', src, dst, kind, '{{}}', file, line, col)) FROM e),
 p AS (SELECT substr(h, 1, 6) AS p, sha256(string_agg(h, '' ORDER BY h)) AS h FROM h GROUP BY 1),
 q AS (SELECT substr(p, 1, 3) AS p, sha256(string_agg(h, '' ORDER BY p)) AS h FROM p GROUP BY 1) SELECT sha256(string_agg(h, '' ORDER BY p)) AS fingerprint FROM q""")
def graph_fingerprint(spark, sf_dir):
    g = as_graph_rows(star_graph(spark, sf_dir))
    return answers.fingerprint(g.nodes, g.edges)


# ---- architecture


@query("pagerank40", """WITH RECURSIVE w AS (SELECT 'supplier:' || l_suppkey AS src, 'part:' || l_partkey AS dst, count(*) AS w FROM lineitem GROUP BY ALL),
 s AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS share FROM w),
 i AS (SELECT src AS id, true AS gives FROM w UNION SELECT dst, false FROM w), c AS (SELECT count(*) AS n FROM i),
 r(id, gives, rank, k) AS (SELECT id, gives, 1.0::DOUBLE / n, 0 FROM i, c
  UNION ALL SELECT i.id, i.gives, (0.15 + 0.85 * z.sink) / c.n + 0.85 * coalesce(g.got, 0), z.k + 1
  FROM i CROSS JOIN c CROSS JOIN (SELECT sum(CASE WHEN gives THEN 0 ELSE rank END) AS sink, max(k) AS k FROM r) z
  LEFT JOIN (SELECT s.dst, sum(r.rank * s.share) AS got FROM r JOIN s ON s.src = r.id GROUP BY s.dst) g ON g.dst = i.id WHERE z.k < 40)
 SELECT id, round(rank, 9) AS rank FROM r WHERE k = 40""")
def pagerank40(spark, sf_dir):
    pairs = part_supplier_pairs(spark, sf_dir)
    ids = pairs.select(F.col("src").alias("id")).union(pairs.select("dst"))
    return analytics.pagerank(ids, pairs).select("id", F.round("rank", 9).alias("rank"))


_PAIRS = "p AS (SELECT DISTINCT 'part:' || l_partkey AS a, 'supplier:' || l_suppkey AS b FROM lineitem), u AS (SELECT a, b FROM p UNION SELECT b, a FROM p)"


@query("communities", f"""WITH RECURSIVE {_PAIRS}, r(id, root, k) AS (SELECT DISTINCT a, a, 0 FROM u UNION ALL
  SELECT id, nxt, k + 1 FROM (SELECT r.id, r.k, least(r.root, m.root) AS nxt, bool_or(m.root < r.root) OVER () AS moved
   FROM r JOIN (SELECT u.a AS id, min(r.root) AS root FROM u JOIN r ON r.id = u.b GROUP BY u.a) m ON m.id = r.id) WHERE moved),
 c AS (SELECT id, root FROM r WHERE k = (SELECT max(k) FROM r))
 SELECT 'community:' || root AS community, count(*) AS size, (SELECT count(*) FROM p JOIN c d ON d.id = p.a WHERE d.root = c.root) AS cohesion FROM c GROUP BY root""")
def communities(spark, sf_dir):
    pairs = part_supplier_pairs(spark, sf_dir)
    return analytics.communities(pairs.select(F.col("src").alias("id")).union(pairs.select("dst")), pairs)


CORE = 30


@query("kcore", f"""WITH RECURSIVE {_PAIRS}, r(a, b, k) AS (SELECT a, b, 0 FROM p UNION ALL
  SELECT a, b, k + 1 FROM (SELECT *, bool_or(n < {CORE} OR m < {CORE}) OVER () AS weak FROM (SELECT *, count(*) OVER (PARTITION BY a) AS n, count(*) OVER (PARTITION BY b) AS m FROM r))
  WHERE weak AND n >= {CORE} AND m >= {CORE}),
 z AS (SELECT *, count(*) OVER (PARTITION BY a) AS n, count(*) OVER (PARTITION BY b) AS m FROM r WHERE k = (SELECT max(k) FROM r))
 SELECT a, b FROM z WHERE (SELECT min(least(n, m)) FROM z) >= {CORE}""")
def kcore(spark, sf_dir):
    return analytics.k_core(part_supplier_pairs(spark, sf_dir), CORE)


@query("module_coupling", """SELECT 'module:' || c_nationkey AS src, 'module:' || s_nationkey AS dst, count(*) AS weight FROM lineitem JOIN orders ON o_orderkey = l_orderkey
 JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey WHERE c_nationkey <> s_nationkey GROUP BY ALL""")
def module_coupling(spark, sf_dir):
    from loomgraph.operators.architecture import coupling

    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    edges = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"))
    of = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("type"), F.col("c_nationkey").cast("string").alias("module"))
    of = of.union(table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey"), F.col("s_nationkey").cast("string")))
    return coupling(edges, of).select(F.concat(F.lit("module:"), "src").alias("src"), F.concat(F.lit("module:"), "dst").alias("dst"), "weight")


@query("risk_score", f"""WITH RECURSIVE {_E}, {_N}, {_BACK}, r(seed, id, depth) AS (
 SELECT 'region:' || r_regionkey, 'region:' || r_regionkey, 0 FROM region UNION SELECT r.seed, b.nxt, r.depth + 1 FROM r JOIN b ON b.at = r.id WHERE r.depth < 3),
 f AS (SELECT seed, id, min(depth) AS depth FROM r GROUP BY ALL HAVING min(depth) > 0)
 SELECT seed, round(sum(CASE WHEN depth = 1 THEN 1.0 ELSE 0.5 END) + sum(CASE kind WHEN 'ENDPOINT' THEN 6.0 WHEN 'DATABASE_TABLE' THEN 4.0 WHEN 'EXTERNAL_SERVICE' THEN 5.0 ELSE 0 END), 2)::DOUBLE AS raw, count(*) AS impacted
 FROM f JOIN n USING (id) GROUP BY seed""")
def risk_score(spark, sf_dir):
    g = star_graph(spark, sf_dir)
    seeds = g.nodes.where("kind = 'MODULE'").select(F.col("id").alias("seed"), "id")
    found = cut(traverse.impact(g, seeds, 3), "impact")
    certain = seeds.select("seed", F.lit(1.0).alias("confidence"))
    return answers.risk(g, found, certain).select("seed", F.col("score").alias("raw"), "impacted")


@query("workflow_steps", """SELECT 'workflow:order:' || l_orderkey AS workflow, count(DISTINCT l_linenumber) AS steps, count(DISTINCT l_suppkey) AS touches
 FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey""")
def workflow_steps(spark, sf_dir):
    from loomgraph.operators.architecture import workflows

    w = workflows(star_graph(spark, sf_dir), 8)
    return w.groupBy("workflow").agg(F.countDistinct(F.when(F.col("role") == "step", F.col("id"))).alias("steps"), F.countDistinct(F.when(F.col("role") == "effect", F.col("id"))).alias("touches")).where("steps > 0 or touches > 0")


@query("capability_groups", r"""WITH s AS (SELECT page_id, list_filter(string_split(regexp_extract(url, '^\w+://[^/]*([^?#]*)', 1), '/'), lambda x: trim(x) <> '' AND NOT starts_with(x, '{')) AS p FROM pages)
 SELECT replace(lower(p[1]), '.html', '') AS capability, count(*) AS entry_points FROM s GROUP BY 1""")
def capability_groups(spark, sf_dir):
    path = F.regexp_extract("url", r"^\w+://[^/]*([^?#]*)", 1)
    return table(spark, sf_dir, "pages").groupBy(X.capability_of_path(path).alias("capability")).agg(F.count(F.lit(1)).alias("entry_points"))


@query("enrichment_candidates", f"""WITH {_E}, {_N}, i AS (SELECT dst AS id, count(*) AS ins FROM e GROUP BY 1),
 d AS (SELECT id, count(*) AS doubts FROM (SELECT src AS id FROM e WHERE confidence < 0.95 UNION ALL SELECT dst FROM e WHERE confidence < 0.95) GROUP BY 1)
 SELECT id, kind, name, round(coalesce(ins, 0) + 2.5 * coalesce(doubts, 0), 2)::DOUBLE AS score FROM n LEFT JOIN i USING (id) LEFT JOIN d USING (id) WHERE coalesce(ins, 0) + 2.5 * coalesce(doubts, 0) > 0""")
def enrichment_candidates(spark, sf_dir):
    g = star_graph(spark, sf_dir)
    return budget.candidates(g.nodes, g.edges)


@query("event_transitions", """SELECT event_type AS src, nxt AS dst, count(*) AS n FROM (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) WHERE nxt IS NOT NULL GROUP BY ALL""")
def event_transitions(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("src"), F.lead("event_type").over(w).alias("dst")).where("dst is not null").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


# ---- text


@query("token_stats", f"WITH {_TOKENS.format(id='doc_id', text='text', table='documents')} SELECT id AS doc_id, length::BIGINT AS length, (SELECT count(*) FROM post WHERE post.id = lens.id) AS distinct_terms FROM lens")
def token_stats(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", X.tokenize(F.coalesce("text", F.lit(""))).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("length"), F.size(F.array_distinct("t")).cast("long").alias("distinct_terms"))


@query("doc_frequency", f"WITH {_TOKENS.format(id='doc_id', text='text', table='documents')} SELECT term, count(*) AS df, sum(tf)::BIGINT AS total FROM post GROUP BY term")
def doc_frequency(spark, sf_dir):
    return retrieval.term_counts(table(spark, sf_dir, "documents"))


QUESTIONS = [(1, "which thing reads the Nation and onth table"), (2, "who changes erth inger"), (3, "Wie ist die schau der lich"), (4, "le tionon de la eauier")]


def _asked_sql() -> str:
    """q(qid, term, mult): the questions' terms, which SQL makes for itself."""
    asked = ", ".join(f"({q}, '{s}')" for q, s in QUESTIONS)
    words = ", ".join(f"'{w}'" for w in X.QUESTION_WORDS)
    own = _TOKENS.format(id="qid", text="question", table=f"(VALUES {asked}) AS asked(qid, question)")
    return f"q AS (WITH {own} SELECT id AS qid, term, tf AS mult FROM post WHERE term NOT IN ({words}))"


def _bm25_sql() -> str:
    return f"""WITH {_asked_sql()}, {_TOKENS.format(id='doc_id', text='text', table='documents')},
 s AS (SELECT count(*) AS n, avg(length) AS al FROM lens), df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
 sc AS (SELECT qid, id, sum(mult * ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2) / (tf + 1.2 * (1 - 0.75 + 0.75 * length / al))) AS score
  FROM q JOIN post USING (term) JOIN df USING (term) JOIN lens USING (id) CROSS JOIN s GROUP BY qid, id)
 SELECT qid::BIGINT AS qid, id AS doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)::INT AS rank FROM sc WHERE score > 0) WHERE rank <= 10"""


@query("bm25_search", _bm25_sql())
def bm25_search(spark, sf_dir):
    hits = retrieval.bm25(table(spark, sf_dir, "documents").where("text is not null"), QUESTIONS, 10, id_col="doc_id")
    return hits.select("qid", F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


@query("text_mentions", "SELECT doc_id, length(split_part(text, 'worthless', 1)) - length(replace(split_part(text, 'worthless', 1), chr(10), '')) + 1 AS first_line FROM documents WHERE contains(text, 'worthless')")
def text_mentions(spark, sf_dir):
    return retrieval.mentions(table(spark, sf_dir, "documents"), "worthless")


def _intent_sql() -> str:
    cases = " ".join(f"WHEN {' OR '.join(f'contains(lower(text), {n!r})' for n in needles)} THEN '{kind}:{depth}'" for needles, kind, depth in X.INTENTS)
    return f"SELECT conv_id, turn, split_part(p, ':', 1) AS kind, split_part(p, ':', 2)::INT AS depth FROM (SELECT *, CASE {cases} ELSE 'LOOKUP:2' END AS p FROM conversations)"


@query("question_plan", _intent_sql())
def question_plan(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.classify(F.coalesce("text", F.lit(""))).alias("p")).select("conv_id", "turn", "p.kind", "p.depth")


@query("question_subject", f"""WITH w AS (SELECT conv_id, turn, generate_subscripts(ws, 1) AS i, regexp_replace(unnest(ws), '[^A-Za-z0-9_.#/()]', '', 'g') AS w
  FROM (SELECT conv_id, turn, regexp_split_to_array(text, '[\\s,?()]+') AS ws FROM conversations)),
 s AS (SELECT * FROM w WHERE w <> '' AND lower(w) NOT IN ({', '.join(f"'{x}'" for x in X.QUESTION_WORDS)}) AND (contains(w, '.') OR contains(w, '#') OR (regexp_matches(w, '^[A-Z]') AND w <> upper(w)))),
 b AS (SELECT conv_id, turn, w FROM s QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY length(w) DESC, i) = 1)
 SELECT c.conv_id, c.turn, coalesce(b.w, '') AS subject FROM conversations c LEFT JOIN b USING (conv_id, turn)""")
def question_subject(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.subject(F.coalesce("text", F.lit(""))).alias("subject"))


@query("source_fingerprint", "SELECT doc_id, sha256(coalesce(text, '')) AS fingerprint FROM documents")
def source_fingerprint(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("fingerprint"))


@query("test_sources", r"""SELECT page_id, contains('/' || url, '/src/test/') OR contains('/' || url, '/src/testFixtures/') OR contains('/' || url, '/src/it/') OR contains('/' || url, '/src/integration-test/') OR contains('/' || url, '/src/integrationTest/')
  OR regexp_matches(lower(regexp_extract(url, '([^./]*)$', 1)), '(test|tests|testcase|it)$') AS is_test FROM pages""")
def test_sources(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.is_test(F.col("url"), F.col("url")).alias("is_test"))


@query("sql_tables", r"""WITH s AS (SELECT p_partkey, 'SELECT a FROM ' || replace(p_type, ' ', '_') || ' JOIN o.' || p_brand || ' update ' || p_brand || '_x into values' AS s FROM part),
 m AS (SELECT p_partkey, regexp_extract_all(s, '(?i)\b(?:from|join|update|into)\s+([A-Za-z_][A-Za-z0-9_$.]*)', 1) AS ms FROM s)
 SELECT p_partkey, array_to_string(list_filter(ms, lambda n: NOT (contains(n, '.') AND NOT contains(n, '_')) AND lower(n) NOT IN ('select','where','set','values','on','as','left','right','inner','outer','fetch')), ',') AS tables FROM m""")
def sql_tables(spark, sf_dir):
    s = F.concat(F.lit("SELECT a FROM "), F.replace("p_type", F.lit(" "), F.lit("_")), F.lit(" JOIN o."), "p_brand", F.lit(" update "), "p_brand", F.lit("_x into values"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(X.sql_tables(s), ",").alias("tables"))


#: Values of properties and the keys that they name: with and without a default, nested, blank, open, malformed.
PLACEHOLDERS = (("${app.%s:1}", "app.%s"), ("${app.%s}", "app.%s"), ("plain %s", None), ("${}", None), ("a ${ x.%s : y} ${z}", "x.%s"), ("${%s", None), ("${out.${in.%s}:d}", "out.${in.%s"), ("${:%s}", None), ("$%s}", None))


@query("placeholders", "SELECT event_id, CASE " + " ".join(f"WHEN event_id % {len(PLACEHOLDERS)} = {i} THEN " + (f"replace('{k}', '%s', event_type)" if k else "NULL") for i, (_, k) in enumerate(PLACEHOLDERS)) + " END AS key FROM events")
def placeholders(spark, sf_dir):
    form = F.element_at(F.array(*[F.lit(v) for v, _ in PLACEHOLDERS]), (F.col("event_id") % len(PLACEHOLDERS) + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", X.placeholder(F.replace(form, F.lit("%s"), F.col("event_type"))).alias("key"))


@query("camel_words", r"SELECT c_custkey, lower(trim(regexp_replace(regexp_replace(c_name || 'Of' || c_mktsegment || 'x', '[^A-Za-z0-9]+', ' ', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g'))) AS words FROM customer")
def camel_words(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", X.camel_words(F.concat("c_name", F.lit("Of"), "c_mktsegment", F.lit("x"))).alias("words"))


# ---- vectors


def _query_vectors(spark, sf_dir):
    """The stated query set: every row whose id is divisible by 50."""
    return table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))


_VEC = """u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
 w AS (SELECT vec_id, label, CASE WHEN list_dot_product(v, v) = 0 THEN v ELSE list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) END AS v FROM u)"""


@query("dense_topk", f"""WITH {_VEC}, s AS (SELECT a.vec_id AS qid, b.vec_id AS id, list_dot_product(a.v, b.v) AS sim FROM w a, w b WHERE a.vec_id % 50 = 0)
 SELECT qid, id, round(sim, 6) AS similarity FROM s QUALIFY row_number() OVER (PARTITION BY qid ORDER BY sim DESC, id) <= 10""")
def dense_topk(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return retrieval.nearest(v, _query_vectors(spark, sf_dir), 10).select("qid", "id", F.round("similarity", 6).alias("similarity"))


@query("dense_demoted", f"""WITH {_VEC}, s AS (SELECT a.vec_id AS qid, b.vec_id AS id, CASE WHEN b.label = 0 THEN least(list_dot_product(a.v, b.v), 0.1 * list_dot_product(a.v, b.v)) ELSE list_dot_product(a.v, b.v) END AS sim FROM w a, w b WHERE a.vec_id % 50 = 0)
 SELECT qid, id, round(sim, 6) AS similarity FROM s QUALIFY row_number() OVER (PARTITION BY qid ORDER BY sim DESC, id) <= 10""")
def dense_demoted(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    return retrieval.nearest(v, _query_vectors(spark, sf_dir), 10, test=F.col("label") == 0).select("qid", "id", F.round("similarity", 6).alias("similarity"))


@query("centroids", f"""WITH {_VEC}, x AS (SELECT label, generate_subscripts(v, 1) - 1 AS i, unnest(v) AS x FROM w), m AS (SELECT label, i, avg(x) AS x FROM x GROUP BY ALL), l AS (SELECT label, sqrt(sum(x * x)) AS n FROM m GROUP BY label)
 SELECT label, i::INT AS i, round(CASE WHEN n = 0 THEN x ELSE x / n END, 6) AS value FROM m JOIN l USING (label)""")
def centroids(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("label", F.col("embedding").alias("v"))
    return retrieval.centroids(v, "label").select("label", "i", F.round("value", 6).alias("value"))


@query("quantize_error", """WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), s AS (SELECT *, list_max(list_transform(v, lambda x: abs(x))) / 127 AS s FROM u)
 SELECT vec_id, round(s, 9) AS scale, list_sum(list_transform(v, lambda x: greatest(-127, least(127, floor(x / s + 0.5)))))::BIGINT AS total, list_max(list_transform(v, lambda x: abs(x - s * greatest(-127, least(127, floor(x / s + 0.5)))))) <= s * 0.5000001 AS bounded FROM s""")
def quantize_error(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    q = v.select("vec_id", "v", V.scale(F.col("v")).alias("s"), V.quantize(F.col("v")).alias("q"))
    worst = F.array_max(F.zip_with(V.doubles(F.col("v")), V.dequantize(F.col("q"), F.col("s")), lambda a, b: F.abs(a - b)))
    return q.select("vec_id", F.round("s", 9).alias("scale"), F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), (worst <= F.col("s") * 0.5000001).alias("bounded"))


@query("subtree_vectors", f"""WITH {_VEC}, x AS (SELECT label, generate_subscripts(v, 1) - 1 AS i, unnest(v) AS x FROM w)
 SELECT anc, i::INT AS i, round(avg(x), 6) AS value FROM (SELECT 'label:' || label AS anc, i, x FROM x UNION ALL SELECT 'root', i, x FROM x) GROUP BY ALL""")
def subtree_vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    anc = e.select(F.col("vec_id").alias("id"), F.explode(F.array(F.concat(F.lit("label:"), "label"), F.lit("root"))).alias("anc"))
    return retrieval.fold_subtrees(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), anc).select("anc", "i", F.round("value", 6).alias("value"))


@query("retrieval_metrics", f"""WITH {_VEC}, s AS (SELECT a.vec_id AS qid, b.vec_id AS id, a.label = b.label AS hit, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_dot_product(a.v, b.v) DESC, b.vec_id) AS rk FROM w a, w b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
 f AS (SELECT qid, min(CASE WHEN hit THEN rk END) AS rk FROM s WHERE rk <= 10 GROUP BY qid)
 SELECT count(*) AS questions, round(avg(CASE WHEN rk IS NULL THEN 0 ELSE 1 END), 6) AS recall, round(avg(coalesce(1.0 / rk, 0)), 6) AS mrr, round(avg(CASE WHEN rk = 1 THEN 1 ELSE 0 END), 6) AS recall_at_1 FROM f""")
def retrieval_metrics(spark, sf_dir):
    from loomgraph.operators.evaluate import rank_metrics

    e = table(spark, sf_dir, "embeddings")
    hits = retrieval.nearest(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), _query_vectors(spark, sf_dir), 11).where("qid <> id")
    w = Window.partitionBy("qid").orderBy("rank")
    hits = hits.withColumn("rank", F.row_number().over(w)).where("rank <= 10")
    labels = e.select(F.col("vec_id").alias("id"), "label")
    asked = labels.select(F.col("id").alias("qid"), F.col("label").alias("wanted"))
    ranks = hits.join(labels, "id").join(asked, "qid").groupBy("qid").agg(F.min(F.when(F.col("label") == F.col("wanted"), F.col("rank"))).alias("rank"))
    return rank_metrics(ranks)


# ---- budgets, claims, trees


@query("knapsack_skip", """WITH RECURSIVE p AS (SELECT p_brand, p_partkey, p_size AS cost, row_number() OVER (PARTITION BY p_brand ORDER BY -p_retailprice, p_partkey) AS rn FROM part),
 r(p_brand, rn, used, taken, p_partkey) AS (SELECT p_brand, 0::BIGINT, 0::BIGINT, false, -1::BIGINT FROM (SELECT DISTINCT p_brand FROM part)
  UNION ALL SELECT p.p_brand, p.rn, r.used + CASE WHEN r.used + p.cost <= 500 THEN p.cost ELSE 0 END, r.used + p.cost <= 500, p.p_partkey FROM r JOIN p ON p.p_brand = r.p_brand AND p.rn = r.rn + 1)
 SELECT p_brand, p_partkey, taken FROM r WHERE rn > 0""")
def knapsack_skip(spark, sf_dir):
    items = table(spark, sf_dir, "part").select("p_brand", F.struct((-F.col("p_retailprice")).alias("a"), "p_partkey").alias("ord"), F.col("p_partkey").alias("id"), F.col("p_size").alias("cost"))
    return budget.knapsack(items, 500, "p_brand").select("p_brand", F.col("id").alias("p_partkey"), "taken")


_COST = "floor((length({0}) + length({1})) / 4)::BIGINT + 3"
_COMPRESS = f"""WITH {_E}, o AS (SELECT dst AS seed, src AS id FROM e WHERE kind = 'DEPENDS_ON' AND src LIKE 'order:%'),
 c AS (SELECT seed, row_number() OVER w AS n, sum({_COST.format('id', 'id')}) OVER w AS s FROM o WINDOW w AS (PARTITION BY seed ORDER BY id ROWS UNBOUNDED PRECEDING)),
 v AS (SELECT seed, row_number() OVER w AS n, sum(floor((length(src) + length(dst) + length(file)) / 4)::BIGINT + 6) OVER w AS s FROM e JOIN o ON o.id = split_part(e.src, '#', 1)
  WHERE kind = 'CONSUMES' WINDOW w AS (PARTITION BY seed ORDER BY -confidence, src, dst, resolver, line, col ROWS UNBOUNDED PRECEDING)),
 f AS (SELECT 'customer:' || c_custkey AS seed, {_COST.format("('customer:' || c_custkey)", 'c_name')} AS f, 1 AS ends FROM customer),
 t AS (SELECT f.*, coalesce((SELECT max(n) FROM c WHERE c.seed = f.seed), 0) AS cn, coalesce((SELECT max(s) FROM c WHERE c.seed = f.seed), 0) AS cs,
  coalesce((SELECT max(n) FROM v WHERE v.seed = f.seed), 0) AS vn, coalesce((SELECT max(s) FROM v WHERE v.seed = f.seed), 0) AS vs FROM f),
 k AS (SELECT t.*, CASE WHEN f + cs + vs <= 300 THEN cn ELSE greatest(coalesce((SELECT max(n) FROM c WHERE c.seed = t.seed AND t.f + t.vs + c.s <= 300), 0), least(cn, ends)) END AS ck FROM t),
 m AS (SELECT k.*, coalesce((SELECT s FROM c WHERE c.seed = k.seed AND c.n = k.ck), 0) AS ckept FROM k),
 z AS (SELECT m.*, CASE WHEN f + ckept + vs <= 300 THEN vn ELSE greatest(coalesce((SELECT max(n) FROM v WHERE v.seed = m.seed AND m.f + m.ckept + v.s <= 300), 0), least(vn, 1)) END AS vk FROM m)
 SELECT seed, ck::BIGINT AS callers_kept, vk::BIGINT AS evidence_kept, (f + ckept + coalesce((SELECT s FROM v WHERE v.seed = z.seed AND v.n = z.vk), 0))::BIGINT AS tokens FROM z"""


@query("compress_packets", _COMPRESS)
def compress_packets(spark, sf_dir):
    g = star_graph(spark, sf_dir)
    orders = g.edges.where("kind = 'DEPENDS_ON' and src like 'order:%'").select(F.col("dst").alias("seed"), F.col("src").alias("id"))
    callers = orders.select("seed", F.col("id").alias("ord"), X.node_tokens(F.col("id"), F.col("id")).alias("tokens"))
    lines = g.edges.where("kind = 'CONSUMES'").withColumn("id", owner("src")).join(orders, "id")
    rank = F.struct((-F.col("confidence")).alias("a"), "src", "dst", "resolver", "line", "col")
    evidence = lines.select("seed", rank.alias("ord"), X.edge_tokens(F.col("src"), F.col("dst"), F.col("file")).alias("tokens"))
    fixed = g.nodes.where("kind = 'SERVICE'").select(F.col("id").alias("seed"), X.node_tokens(F.col("id"), F.col("name")).alias("tokens"), F.lit(1).alias("endpoints"))
    return budget.compress(callers, evidence, fixed, 300)


@query("claim_verdicts", """WITH c AS (SELECT DISTINCT 'c' || l_orderkey || '-' || l_linenumber AS claim_id, CASE WHEN l_linenumber = 7 THEN 'order:none' WHEN l_linenumber = 6 THEN 'region:0' ELSE 'order:' || l_orderkey END AS subject FROM lineitem),
 x AS (SELECT DISTINCT 'c' || l_orderkey || '-' || l_linenumber AS claim_id, l_linenumber, l_suppkey, l_orderkey FROM lineitem WHERE l_linenumber <> 5),
 j AS (SELECT claim_id, bool_and(l_linenumber <> 4) AS there, max(l_linenumber) AS ln FROM x GROUP BY claim_id)
 SELECT c.claim_id, CASE WHEN j.claim_id IS NULL THEN 'UNSUPPORTED_MISSING_CITATION' WHEN c.subject = 'order:none' OR c.subject NOT IN (SELECT 'order:' || o_orderkey FROM orders UNION SELECT 'region:0') THEN 'UNSUPPORTED_UNKNOWN_SYMBOL'
  WHEN NOT j.there THEN 'UNSUPPORTED_CITATION_NOT_IN_GRAPH' WHEN ln = 6 THEN 'UNSUPPORTED_CITATION_UNRELATED' ELSE 'SUPPORTED' END AS verdict FROM c LEFT JOIN j USING (claim_id)""")
def claim_verdicts(spark, sf_dir):
    """Claims about orders from their lines: lines 4 cite what isn't there, 5 nothing, 6 are about another node,
    7 about none."""
    lines = table(spark, sf_dir, "lineitem").selectExpr("concat('c', l_orderkey, '-', l_linenumber) AS claim_id", "CASE WHEN l_linenumber = 7 THEN 'order:none' WHEN l_linenumber = 6 THEN 'region:0' ELSE concat('order:', l_orderkey) END AS subject", "l_orderkey", "l_linenumber", "l_suppkey")
    cites = lines.where("l_linenumber <> 5").selectExpr("claim_id", "concat('order:', l_orderkey, '#', l_linenumber) AS src", "concat('supplier:', l_suppkey) AS dst", "CASE WHEN l_linenumber = 4 THEN 'CALLS' ELSE 'CONSUMES' END AS kind")
    g = star_graph(spark, sf_dir)
    return answers.verify_claims(lines.select("claim_id", "subject").distinct(), cites, g.nodes, g.edges)


@query("bucket_fanout", """SELECT c_nationkey AS parent, (rn - 1) // size AS bucket, min(c_custkey) AS first, max(c_custkey) AS last, count(*) AS n FROM (
 SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rn, ceil(count(*) OVER (PARTITION BY c_nationkey) / 24)::BIGINT AS size FROM customer) GROUP BY 1, 2""")
def bucket_fanout(spark, sf_dir):
    children = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("parent"), F.col("c_custkey").alias("child"), F.col("c_custkey").alias("ord"))
    b = tree.buckets(children, 24)
    return b.groupBy("parent", "bucket").agg(F.min("child").alias("first"), F.max("child").alias("last"), F.count(F.lit(1)).alias("n"))


def _subtree_sql() -> str:
    cards = "(SELECT 'doc:' || doc_id AS id, text FROM documents WHERE text IS NOT NULL UNION ALL SELECT DISTINCT 'source:' || coalesce(source, ''), 'source:' || coalesce(source, '') FROM documents WHERE text IS NOT NULL UNION ALL SELECT 'root', 'all sources') AS cards"
    return f"""WITH {_asked_sql()}, {_TOKENS.format(id='id', text='text', table=cards)},
 up AS (SELECT id, id AS anc FROM lens UNION SELECT 'doc:' || doc_id, 'source:' || coalesce(source, '') FROM documents WHERE text IS NOT NULL UNION SELECT id, 'root' FROM lens),
 ln AS (SELECT anc, sum(length) AS length FROM up JOIN lens USING (id) GROUP BY anc), st AS (SELECT count(*) AS n, greatest(avg(length), 1) AS al FROM ln),
 df AS (SELECT term, count(*) AS df FROM post GROUP BY term), pl AS (SELECT anc, term, sum(tf) AS tf FROM post JOIN up USING (id) GROUP BY ALL)
 SELECT qid::BIGINT AS qid, anc AS id, round(sum(mult * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / al))), 6) AS score
 FROM pl JOIN q USING (term) JOIN df USING (term) JOIN ln USING (anc) CROSS JOIN st GROUP BY qid, anc"""


@query("subtree_bm25", _subtree_sql())
def subtree_bm25(spark, sf_dir):
    """BM25 where a document is a subtree: sources over documents, one root over sources."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    cards = docs.select(F.concat(F.lit("doc:"), "doc_id").alias("id"), "text")
    sources = docs.select(F.concat(F.lit("source:"), F.coalesce("source", F.lit(""))).alias("id")).distinct().select("id", F.col("id").alias("text"))
    cards = cards.union(sources).union(spark.createDataFrame([("root", "all sources")], "id string, text string"))
    links = docs.select(F.concat(F.lit("source:"), F.coalesce("source", F.lit(""))).alias("parent"), F.concat(F.lit("doc:"), "doc_id").alias("child")).union(sources.select(F.lit("root"), "id"))
    return tree.subtree_scores(cards, links, QUESTIONS).select("qid", "id", F.round("score", 6).alias("score"))


@query("grounded_recall", """WITH x AS (SELECT c_custkey, count(o_orderkey) AS n, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS hit FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)
 SELECT count(*) AS questions, round(avg(CASE WHEN n = 0 THEN 1.0 ELSE hit / n END), 6) AS recall, (SELECT n FROM (SELECT n, row_number() OVER (ORDER BY n) - 1 AS rn, count(*) OVER () AS c FROM x) WHERE rn = c // 2) AS median_expected FROM x""")
def grounded_recall(spark, sf_dir):
    """Customers as questions, their orders as expectations, finished ones as found."""
    from loomgraph.operators.evaluate import recall, upper_median

    orders = table(spark, sf_dir, "orders")
    expected = orders.select(F.col("o_custkey").alias("qid"), F.col("o_orderkey").alias("id"))
    got = orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("qid"), F.col("o_orderkey").alias("id"))
    r = recall(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("qid")), expected, got)
    return r.agg(F.count(F.lit(1)).alias("questions"), F.round(F.avg("recall"), 6).alias("recall"), upper_median("expected").alias("median_expected"))


@query("plan_anchors", """WITH a AS (SELECT s_nationkey AS qid, s_suppkey AS id, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS rank FROM supplier),
 b AS (SELECT s_nationkey AS qid, s_suppkey AS id, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS rank FROM supplier),
 u AS (SELECT *, 0 AS src FROM a WHERE rank <= 2 UNION ALL SELECT *, 1 FROM b), f AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY qid, id ORDER BY src, rank) = 1)
 SELECT qid, id, position FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY src, rank, id)::INT AS position FROM f) WHERE position <= 5""")
def plan_anchors(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("qid"), F.col("s_suppkey").alias("id"), "s_acctbal")
    a = s.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("s_acctbal").desc(), "id"))).where("rank <= 2")
    b = s.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("id")))
    return answers.plan_anchors([a, b], 5)


from loomgraph import catalogue_answers, catalogue_java  # noqa: E402, F401
