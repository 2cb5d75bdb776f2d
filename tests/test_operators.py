import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomgraph.functions import text as X
from loomgraph.model import EDGE_SCHEMA, NODE_SCHEMA, Graph, lifted, owner, repository_types
from loomgraph.operators import analytics, answers, budget, evaluate, navigate, retrieval, traverse, tree


def graph(spark, nodes, edges):
    n = [(i, k, name or i, {}, "r", 1.0, f, 1, 1, s) for s, (i, k, name, f) in enumerate((*x, None, "")[:4] if len(x) < 4 else x for x in nodes)]
    e = [(a, b, k, {}, "r", c, "f", s, 1, s) for s, (a, b, k, c) in enumerate((*x, 1.0)[:4] for x in edges)]
    return Graph(spark.createDataFrame(n, NODE_SCHEMA), spark.createDataFrame(e, EDGE_SCHEMA))


def seeds(spark, *ids):
    return spark.createDataFrame([(i, i) for i in ids], "seed string, id string")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def small(spark):
    nodes = [("file:A", "FILE"), ("type:a.A", "TYPE"), ("type:a.A#m()", "METHOD"), ("type:a.B", "TYPE"), ("type:a.B#n()", "METHOD"), ("type:a.C", "SERVICE"), ("endpoint:GET:/x", "ENDPOINT"), ("external:call:q/0", "EXTERNAL_SYMBOL")]
    edges = [
        ("file:A", "type:a.A", "DECLARES"), ("type:a.A", "type:a.A#m()", "DECLARES"), ("file:A", "type:a.B", "DECLARES"), ("type:a.B", "type:a.B#n()", "DECLARES"), ("file:A", "type:a.C", "DECLARES"),
        ("type:a.B#n()", "type:a.A#m()", "CALLS", 0.95), ("endpoint:GET:/x", "type:a.B#n()", "EXPOSES"), ("type:a.C", "type:a.B", "DEPENDS_ON"), ("ghost", "type:a.A", "CALLS"), ("type:a.A", "type:a.C", "DEPENDS_ON"),
    ]
    return graph(spark, nodes, edges)


def test_impact_counts_members_and_skips_ghosts(spark, small):
    got = traverse.impact(small, seeds(spark, "type:a.A"), 4)
    assert {(r["id"], r["depth"]) for r in got.collect()} == {("type:a.B#n()", 1), ("endpoint:GET:/x", 2)}
    paths = {r["id"]: r["path"] for r in traverse.impact_paths(small, got, 4).collect()}
    assert paths["endpoint:GET:/x"] == ["type:a.A#m()", "type:a.B#n()", "endpoint:GET:/x"]


def test_context_has_callers_endpoints_and_dependencies(spark, small):
    p = traverse.context(small, seeds(spark, "type:a.A"), 3)
    assert [r["id"] for r in p["callers"].collect()] == ["type:a.B#n()"]
    assert [r["id"] for r in p["endpoints"].collect()] == ["endpoint:GET:/x"]
    assert [r["id"] for r in p["dependencies"].collect()] == ["type:a.C"]
    assert {(r["src"], r["dst"]) for r in p["evidence"].collect()} == {("type:a.B#n()", "type:a.A#m()"), ("endpoint:GET:/x", "type:a.B#n()"), ("type:a.A", "type:a.C")}


def test_types_and_lifted_edges(small):
    assert {r["id"] for r in repository_types(small).collect()} == {"type:a.A", "type:a.B", "type:a.C"}
    assert rows(lifted(small)) == [("type:a.A", "type:a.C"), ("type:a.B", "type:a.A"), ("type:a.C", "type:a.B")]


def test_owner(spark):
    df = spark.createDataFrame([("type:A#m(B)",), ("type:A.field:x",), ("#odd",), ("plain",)], "id string")
    assert [r[0] for r in df.select(owner("id")).collect()] == ["type:A", "type:A", "#odd", "plain"]


def test_symbol_tiers(spark, small):
    q = spark.createDataFrame([("type:a.B",), ("A",), ("m()",), ("q/0",), ("C",), ("nothing",)], "query string")
    got = {r["query"]: (r["id"], r["tier"]) for r in answers.resolve_symbols(small.nodes, q).collect()}
    assert got == {"type:a.B": ("type:a.B", 0), "A": ("file:A", 2), "m()": ("type:a.A#m()", 2), "q/0": ("external:call:q/0", 4), "C": ("type:a.C", 2)}


def test_pagerank_equals_a_loop(spark):
    r = random.Random(4)
    ids, edges = [f"n{i}" for i in range(12)], [(f"n{r.randrange(9)}", f"n{r.randrange(12)}") for _ in range(40)]
    rank = dict.fromkeys(ids, 1 / 12)
    for _ in range(40):
        sink = sum(rank[i] for i in ids if not any(a == i for a, _ in edges))
        new = dict.fromkeys(ids, (0.15 + 0.85 * sink) / 12)
        for a, b in edges:
            new[b] += 0.85 * rank[a] / sum(x == a for x, _ in edges)
        rank = new
    got = analytics.pagerank(spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame(edges, "src string, dst string"))
    assert {x["id"]: pytest.approx(x["rank"]) for x in got.collect()} == rank


def test_components_and_core(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y"), ("x", "x")], "src string, dst string")
    ids = spark.createDataFrame([(i,) for i in "abcdxyz"], "id string")
    assert {r["id"]: r["root"] for r in analytics.components(ids, edges).collect()} == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x", "y": "x", "z": "z"}
    assert rows(analytics.k_core(edges, 2)) == [("a", "b"), ("a", "c"), ("b", "c")]
    assert ("community:a", 4, 4) in rows(analytics.communities(ids, edges))


def test_knapsack_skips_and_goes_on(spark):
    items = spark.createDataFrame([("g", i, f"i{i}", c) for i, c in enumerate([5, 9, 4, 3, 1])], "g string, ord int, id string, cost int")
    assert [r["taken"] for r in budget.knapsack(items, 10, "g").orderBy("ord").collect()] == [True, False, True, False, True]
    assert budget.knapsack(items, 10).where("taken").count() == 3


def test_compress_equals_the_loop(spark):
    r = random.Random(8)
    callers, evidence, fixed, want = [], [], [], {}
    for s in range(120):
        c, e = [r.randrange(1, 30) for _ in range(r.randrange(6))], [r.randrange(1, 30) for _ in range(r.randrange(7))]
        f, ends = r.randrange(40), r.randrange(4)
        callers += [(s, i, x) for i, x in enumerate(c)]
        evidence += [(s, i, x) for i, x in enumerate(e)]
        fixed.append((s, f, ends))
        while f + sum(c) + sum(e) > 90:
            if c and len(c) > ends:
                c.pop()
            elif len(e) > 1:
                e.pop()
            else:
                break
        want[s] = (len(c), len(e), f + sum(c) + sum(e))
    got = budget.compress(spark.createDataFrame(callers, "seed int, ord int, tokens int"), spark.createDataFrame(evidence, "seed int, ord int, tokens int"), spark.createDataFrame(fixed, "seed int, tokens int, endpoints int"), 90)
    assert {r["seed"]: (r["callers_kept"], r["evidence_kept"], r["tokens"]) for r in got.collect()} == want


def test_digest():
    assert budget.digest(["a b", "a", "c d e", None, " ", "a b"]) == "c d e; a b"
    assert budget.digest(["x" * 300, "short one"]) == "short one"
    assert budget.digest([]) == ""


def test_tokenize_equals_the_state_machine(spark):
    def machine(text):
        out = []
        import re

        for part in re.split("[^A-Za-z0-9]+", text):
            if len(part) > 1:
                out.append(part.lower())
            word = ""
            for i, c in enumerate(part):
                if c.isupper() and i and not part[i - 1].isupper() and len(word) > 1:
                    out.append(word.lower())
                    word = ""
                word += c
            if len(word) > 1:
                out.append(word.lower())
        return out

    r = random.Random(2)
    texts = ["".join(r.choice("abAB1 _.") for _ in range(r.randrange(25))) for _ in range(800)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in df.select("t", X.tokenize(F.col("t")).alias("x")).collect():
        assert sorted(row["x"]) == sorted(machine(row["t"]))


def test_bm25_equals_a_loop(spark):
    docs = {1: "payment service pays", 2: "the order service", 3: "PaymentGateway paymentGateway", 4: "nothing here"}
    toks = {1: ["payment"] * 2 + ["service"] * 2 + ["pays"] * 2, 2: ["the"] * 2 + ["order"] * 2 + ["service"] * 2, 3: ["paymentgateway", "payment", "gateway"] * 2, 4: ["nothing"] * 2 + ["here"] * 2}
    avg = sum(map(len, toks.values())) / 4
    want = {}
    for k, ts in toks.items():
        s = 0.0
        for q in ["payment", "service"] * 2:
            n, tf = sum(q in x for x in toks.values()), ts.count(q)
            s += math.log(1 + (4 - n + 0.5) / (n + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ts) / avg)) if tf else 0
        if s:
            want[k] = s
    got = retrieval.bm25(spark.createDataFrame(list(docs.items()), "id int, text string"), [(1, "which payment service")])
    assert {r["id"]: pytest.approx(r["score"]) for r in got.collect()} == want


@pytest.mark.parametrize(("question", "plan"), [("What breaks if PaymentService changes?", ("IMPACT", "PaymentService", 4)), ("who is the author", ("SECURITY", "", 3)), ("restore it", ("ENDPOINT", "", 3)), ("Which table does Owner persist to?", ("PERSISTENCE", "Owner", 3)), ("hello", ("LOOKUP", "", 2))])
def test_plan(spark, question, plan):
    q = F.lit(question)
    row = spark.range(1).select(X.classify(q).alias("p"), X.subject(q).alias("s")).first()
    assert (row["p"]["kind"], row["s"], row["p"]["depth"]) == plan


def test_text_functions(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    L = F.lit
    assert value(X.join_paths(L("/a/"), L("b"))) == "/a/b" and value(X.join_paths(L(""), L(""))) == "/"
    assert value(X.package_from_name(L("perf.MediaItem.Content"))) == "perf" and value(X.package_from_name(L("Main"))) == "<default>"
    assert value(X.placeholder(L("${a.b:x}"))) == "a.b" and value(X.placeholder(L("plain"))) is None
    assert value(X.sql_tables(L("select * from A join o.pets update b_c.d where"))) == ["A", "b_c.d"]
    assert value(X.capability_of_path(L("/{id}/Owners.html"))) == "owners" and value(X.capability_of_topic(L("<dynamic-topic>"))) is None
    assert value(X.suffix_match(L("type:a.B"), L("B"))) and not value(X.suffix_match(L("type:a.xB"), L("B")))
    assert value(X.demote(L(-0.5), L(True))) == -0.5 and value(X.demote(L(0.5), L(True))) == pytest.approx(0.05)
    assert value(X.doc_sentence(L("Says <b>it</b>, e.g.this. More."))) == "Says it , e.g.this."


def test_claims(spark, small):
    claims = spark.createDataFrame([("1", "type:a.A"), ("2", "type:a.A"), ("3", "nobody"), ("4", "type:a.C"), ("5", "type:a.A")], "claim_id string, subject string")
    cites = spark.createDataFrame([("1", "type:a.B#n()", "type:a.A#m()", "CALLS"), ("3", "type:a.C", "type:a.B", "DEPENDS_ON"), ("4", "type:a.B#n()", "type:a.A#m()", "CALLS"), ("5", "type:a.A", "x", "CALLS")], "claim_id string, src string, dst string, kind string")
    got = {r["claim_id"]: r["verdict"].replace("UNSUPPORTED_", "") for r in answers.verify_claims(claims, cites, small.nodes, small.edges).collect()}
    assert got == {"1": "SUPPORTED", "2": "MISSING_CITATION", "3": "UNKNOWN_SYMBOL", "4": "CITATION_UNRELATED", "5": "CITATION_NOT_IN_GRAPH"}
    own = spark.createDataFrame([("1", "type:a.A", "SUMMARY", " does it ", 0.95, 1), ("5", "type:a.A", "NAME", "x", 0.5, 2), ("2", "type:a.A", "DISPUTE", "no", 0.5, 3)], "claim_id string, subject string, kind string, value string, confidence double, ord int")
    verdicts = spark.createDataFrame(list(got.items()), "claim_id string, verdict string")
    nodes, rejected = answers.merge_claims(small.nodes, own, verdicts)
    a = {r["id"]: r["attributes"] for r in nodes.collect()}["type:a.A"]
    assert a == {"claim.summary": "does it", "claim.summary.confidence": "0.8"} and {r["claim_id"]: r["reason"] for r in rejected.collect()} == {"5": "CITATION_NOT_IN_GRAPH", "2": "dispute"}
    assert all(not r["attributes"] for r in answers.strip_claims(nodes).collect())
    mine = answers.claims_from(small.edges.withColumn("seed", F.lit("s")), spark.createDataFrame([("s", "type:a.A")], "seed string, anchor string"))
    assert {(r["src"], r["subject"]) for r in mine.collect()} >= {("type:a.B#n()", "type:a.A"), ("ghost", "type:a.A")}


def test_risk(spark, small):
    got = traverse.impact(small, seeds(spark, "type:a.A"), 4)
    r = answers.risk(small, got, traverse.path_edges(small, got)).first()
    assert (r["score"], r["band"], r["impacted"]) == (math.floor((1 + 0.5 + 6) * 0.95 * 100 + 0.5) / 100, "LOW", 2)
    assert ("type:a.A", "exposed-endpoints", 1, 6.0, 6.0) in rows(answers.risk_factors(small, got))


def test_fan_out(spark):
    flat = spark.createDataFrame([("p", f"c{i:03}", i, f"n{i}") for i in range(130)], "parent string, child string, ord int, name string")
    got = tree.grouped(flat, 5)
    assert max(r["count"] for r in got.groupBy("parent").count().collect()) <= 5
    up = tree.closure(got)
    assert up.where("anc = 'p' and id like 'c%'").count() == 130


def test_descent(spark):
    links = spark.createDataFrame([("r", "a"), ("r", "b"), ("a", "a1"), ("b", "b1"), ("b", "b2")], "parent string, child string")
    nodes = spark.createDataFrame([("r", "ROOT", ""), ("a", "MODULE", ""), ("b", "MODULE", ""), ("a1", "TYPE", ""), ("b1", "TYPE", ""), ("b2", "MEMBER", "")], "id string, kind string, entity string")
    scores = spark.createDataFrame([(q, i, x) for q in (1, 2, 3) for i, x in (("a", 5.0), ("b", 1.0), ("a1", 2.0), ("b1", 2.0))], "qid int, id string, score double")
    plan = spark.createDataFrame([(1, "LOOKUP"), (2, "STRUCTURE"), (3, "LOOKUP")], "qid int, kind string")
    held = spark.createDataFrame([(3, "b"), (3, "b2")], "qid int, id string")
    named = spark.createDataFrame([(3, "b2")], "qid int, id string")
    found = navigate.descend(plan, links, nodes, scores, named, held, "r", beam=1)
    got = {}
    for r in found["anchors"].orderBy("position").collect():
        got.setdefault(r["qid"], []).append(r["id"])
    # 1: the leaf, which beats its branch; 2: stops at the module; 3: what holds the subject leads, down to it.
    assert got == {1: ["a1"], 2: ["a"], 3: ["b2"]}
    assert [r["id"] for r in found["trace"].where("qid = 3").orderBy("depth").collect()] == ["b", "b2"]
    with pytest.raises(ValueError, match="no such mode"):
        navigate.anchors_of("GUESS", {}, 1)
    with pytest.raises(ValueError, match="needs dense"):
        navigate.anchors_of("DENSE", {}, 1)


def test_knapsack_leaves_out_what_can_never_fit(spark):
    r = random.Random(8)
    items = [(i, r.choice([3, 5, 9, 40])) for i in range(400)]
    got = {x["id"]: x["taken"] for x in budget.knapsack(spark.createDataFrame([(i, i, c) for i, c in items], "ord int, id int, cost int"), 100).collect()}
    used, want = 0, {}
    for i, c in items:
        want[i] = used + c <= 100
        used += c if want[i] else 0
    assert got == want


def test_evaluation(spark):
    q = spark.createDataFrame([(1,), (2,), (3,)], "qid int")
    expected = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "qid int, id string")
    got = spark.createDataFrame([(1, "a"), (1, "z"), (2, "d")], "qid int, id string")
    assert {r["qid"]: r["recall"] for r in evaluate.recall(q, expected, got).collect()} == {1: 0.5, 2: 0.0, 3: 1.0}
    assert {r["qid"]: r["precision"] for r in evaluate.precision(q, expected, got).collect()} == {1: 0.5, 2: 0.0, 3: 1.0}
    assert spark.createDataFrame([(4,), (1,), (3,), (2,)], "x int").agg(evaluate.upper_median("x")).first()[0] == 3
    files = spark.createDataFrame([(1, "B.java"), (2, "x/C.java")], "qid int, file string")
    seen = spark.createDataFrame([(1, "src/a/B.java"), (2, "y/C.java")], "qid int, file string")
    assert {r["qid"]: r["recall"] for r in evaluate.locations(files, seen).collect()} == {1: 1.0, 2: 0.0}


def test_partitions_do_not_change_results(spark, small):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append((rows(traverse.impact(small, seeds(spark, "type:a.A"), 3).select("id", "depth", "via")), answers.fingerprint(small.nodes, small.edges).first()[0]))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1]
    assert isinstance(small.nodes.schema, StructType)


def test_pagerank_of_edges_that_lead_out_of_the_ids_equals_a_loop(spark):
    ids = ["a", "b", "c", "d", "e"]
    edges = [("a", "b"), ("a", "c"), ("b", "a"), ("b", "x"), ("c", "d"), ("c", "d"), ("c", "e"), ("y", "a"), ("d", "d")]
    shares = {(s, t): edges.count((s, t)) / sum(1 for e in edges if e[0] == s) for s, t in edges}
    rank = dict.fromkeys(ids, 0.2)
    for _ in range(7):
        sink = sum(r for i, r in rank.items() if not any(s == i for s, _ in edges))
        rank = {i: (0.15 + 0.85 * sink) / 5 + 0.85 * sum(rank.get(s, 0) * w for (s, t), w in shares.items() if t == i) for i in ids}
    got = analytics.pagerank(spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame(edges, "src string, dst string"), 7)
    assert {r["id"]: round(r["rank"], 12) for r in got.collect()} == {i: round(r, 12) for i, r in rank.items()}


def test_rounds_of_a_bipartite_pagerank_write_nothing(spark, monkeypatch):
    written = []
    real = analytics.cut
    monkeypatch.setattr(analytics, "cut", lambda df, label: written.append(label) or real(df, label))
    edges = spark.createDataFrame([("s1", "p1"), ("s1", "p2"), ("s2", "p2")], "src string, dst string")
    got = analytics.pagerank(edges.select(edges.src.alias("id")).union(edges.select("dst")), edges, 40)
    assert got.count() == 4 and len(written) < 10
