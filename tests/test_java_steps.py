"""The steps that the queries over the Java program share: what they read, and that less work gives the same rows."""

import java_fixture
import pytest
from pyspark.sql import functions as F

from loomgraph import catalogue_java
from loomgraph.model import repository_types
from loomgraph.operators import architecture, resolve, traverse
from loomgraph.sources import java_source
from loomgraph.store import cut

TYPES = resolve.TYPE_KINDS


def plain(e):
    """An emission without its number, which only tells the order within a file."""
    return {k: str(v) for k, v in e.items() if k != "ord"}


@pytest.mark.parametrize("edges", [("CONSUMES",), ("EXPOSES", "THROWS"), ("PERSISTS", "CATCHES", "CREATES"), ("EXTENDS", "IMPLEMENTS", "IMPORTS"), ("PARTICIPATES_IN", "CALLS")])
@pytest.mark.parametrize("nodes", [(), ("METHOD",), ("TOPIC", "ENDPOINT", "DATABASE_TABLE", "PACKAGE")])
def test_words_lose_no_emission(nodes, edges, monkeypatch):
    for ids in ((), TYPES):
        short = [[plain(e) for e in java_source.parse(t, f, frozenset(nodes), frozenset(ids), frozenset(edges))] for f, t in java_fixture.FILES.items()]
        with monkeypatch.context() as m:
            m.setattr(java_source, "WORDS", {})
            whole = [[plain(e) for e in java_source.parse(t, f, frozenset(nodes), frozenset(ids), frozenset(edges))] for f, t in java_fixture.FILES.items()]
        assert short == whole


def test_a_file_without_the_words_is_not_parsed(monkeypatch):
    def no(*_):
        raise AssertionError("parsed")

    monkeypatch.setattr(java_source, "_Parser", no)
    assert java_source.parse(java_fixture.FILES["src/main/java/shop/Payments.java"], "Payments.java", frozenset(), (), frozenset({"CONSUMES", "EXPOSES"})) == []


def test_texts_without_the_words_stay_in_spark(spark):
    files = spark.createDataFrame(list(java_fixture.FILES.items()), "path string, text string")
    assert "KafkaListener" in java_source.emissions(files, (), (), ("CONSUMES",))._jdf.queryExecution().optimizedPlan().toString()
    found = java_source.emissions(files, (), (), ("CONSUMES",)).select("src", "refs").collect()
    assert [(r["src"], r["refs"]) for r in found] == [("type:shop.Listener#heard(String)", ["topic:payments.done"])]


def test_tokens_of_odd_text():
    tokens = lambda t: [(k, v) for k, v, _ in java_source._Parser(t, "f").tokens]
    assert tokens('a /**/ b /** d */ /* c */ \'\' " # é 1.5e3 ->::+=/= // x\n/* open') == [
        ("id", "a"), ("id", "b"), ("doc", "/** d */"), ("str", "''"), ("num", "1.5e3"), ("op", "->"), ("op", "::"), ("op", "+="), ("op", "/="), ("op", "/"), ("op", "*"), ("id", "open")
    ]
    assert [p for *_, p in java_source._Parser(" ab  #\n c", "f").tokens] == [1, 8]


TWICE = {
    "a/X.java": "package p;\n/** First. */\nclass X { int a; void f() {} }\n",
    "b/X.java": "package p;\n/** Second. */\nclass X { long a; }\nclass Only {}\n",
}


def test_nodes_that_one_emission_has_are_not_ranked(spark):
    files = spark.createDataFrame([*TWICE.items(), *java_fixture.FILES.items()], "path string, text string")
    e = cut(java_source.emissions(files), "java", ("record", "kind"))
    once, ranked = resolve.declared_once(e), resolve.declarations(e)
    rows = lambda df: sorted(str(r) for r in df.collect())
    assert rows(once) == rows(ranked)
    assert once.where("id = 'type:p.X'").first()["attributes"]["doc"] == "Second"
    assert once.where("id = 'type:p.X.field:a'").first()["attributes"]["declaredType"] == "long"


def test_a_kind_is_read_without_the_others(spark):
    files = spark.createDataFrame(list(java_fixture.FILES.items()), "path string, text string")
    e = cut(java_source.emissions(files), "java", ("record", "kind"))
    calls = resolve.link(e).where("kind = 'CALLS'")
    settled = [f for f in e.where("record = 'edge' and kind = 'CALLS'").inputFiles()]
    assert settled and e.columns == [c.split()[0] for c in java_source.EMISSION.split(", ")]
    assert "PartitionFilters: [isnotnull(record" in calls._sc._jvm.PythonSQLUtils.explainString(calls._jdf.queryExecution(), "simple") and calls.count() > 0


CREATIONS = {
    "plain": "package p; class A { B b() { return new B<C>(1, x(2)) ; } int[] n() { return new int[] {1}; } }",
    "anonymous": "package p; class A { Runnable r() { f(new B(1)); return new Runnable() { public void run() { } }; } }",
    "inner": "package p; class A { void r() { f(new B(new C(2) { int x; })); } }",
}


@pytest.mark.parametrize("kinds", [("TYPE",), ("TYPE", "METHOD"), ("METHOD", "FIELD")])
def test_only_creations_with_a_body_are_entered(kinds, monkeypatch):
    names = lambda t, edges: [e["id"] for e in java_source.parse(t, "A.java", frozenset(kinds), (), edges) if e["record"] == "node"]
    for text in CREATIONS.values():
        assert names(text, frozenset()) == names(text, frozenset({"CALLS"}))  # with calls every body is read

    def no(*_):
        raise AssertionError("entered")

    monkeypatch.setattr(java_source._Parser, "statements", no)
    names(CREATIONS["plain"], frozenset())
    for text in ("anonymous", "inner"):
        with pytest.raises(AssertionError):
            names(CREATIONS[text], frozenset())


MARKED = {
    "a/X.java": "package p;\n@PreAuthorize(\"a\") class X { @Value(\"${k}\") int a; @Value(\"${l}\") int b; void f() {} }\n",
    "b/X.java": "package p;\nclass X { long a; }\n",
    "c/Y.java": "package p;\nclass Y { int z; }\n",
}


def test_nodes_without_the_asked_attributes_are_bare_and_still_rank(spark):
    files = spark.createDataFrame(list(MARKED.items()), "path string, text string")
    kinds = (*TYPES, "METHOD", "FIELD")
    for keys in (resolve.GUARD_KEYS, resolve.PROPERTY_KEYS):
        e = cut(java_source.emissions(files, kinds, (), (), keys), "java", ("record", "kind"))
        found = {r["id"] for r in resolve.declared_once(e).collect()}
        assert found == {r["id"] for r in resolve.declarations(e).collect()}
        assert found == (set() if keys == resolve.GUARD_KEYS else {"type:p.X.field:b"})  # the later X is without guard and its a without value
        bare = e.where("record = 'bare'")
        assert bare.where("name is not null or attributes is not null").count() == 0 and "type:p.Y.field:z" in {r["id"] for r in bare.collect()}


def test_types_that_files_hold_are_not_traversed_from(spark, monkeypatch):
    files = spark.createDataFrame(list(java_fixture.FILES.items()) + [("d/Out.java", "package d;\nclass Out { class In { class Deep { } } }\n")], "path string, text string")
    g = resolve.assemble(java_source.emissions(files))
    seeds = []

    def reach(start, *args, **more):
        seeds.extend(r["seed"] for r in start.collect())
        return traverse.reach(start, *args, **more)

    monkeypatch.setattr(architecture, "reach", reach)
    held = {r["type"]: r["file"] for r in architecture.declaring_files(g).collect()}
    assert {held["type:d.Out"], held["type:d.Out.In"], held["type:d.Out.In.Deep"]} == {"file:d/Out.java"}
    assert set(held) == {r["id"] for r in repository_types(g).collect()}
    assert "type:d.Out" not in seeds and {"type:d.Out.In", "type:d.Out.In.Deep"} <= set(seeds)
    assert {r["type"]: r["package"] for r in architecture.packages(g).collect()}["type:d.Out.In.Deep"] == "d"


APART = {
    "a/Store.java": "package p;\nclass Store { int rows; Store(Shelf s, q.Far f) { rows = extra + s.n; } }\n",
    "b/Store.java": "package p;\nclass /* kept // here */ Store { int extra; void g() { rows++; if (null == other) return; } }\n",
    "c/Shelf.java": "package p;\n@Table(name = \"é\")\npublic final class\n// a shelf of the Store\nShelf { int n; class In { @Inject void set(Shelf s, Out o) { n = 1; } } }\n",
    "d/In.java": "package p;\nclass Shelf { int m; class In { int o; } record Out(int a) { } interface Éa { } }\n",
    "e/Out.java": "package p;\ninterface Out { Store make(int n); @Deprecated int put(Store s); }\n",
    "f/Anon.java": "package p;\nclass Anon { Object x = null; Anon(/* none */) { } Object f() { return new Out(1) { int held; Object Anon$1(Out o) { return held + lost; } }; } }\n",
    "g/Anon.java": "package p;\nclass Anon { Object f() { return new Base() { int lost; public Anon$1(Store s) { lost = 0; } }; } }\n",
    "h/Wide.java": "package q;\nimport p.*;\nenum Wide { A; Wide  /* x */ ( Shelf.In i, String s, Wide$1 w) { } void h() { try { } catch (Gone | Lost e) { throw new Lost(); } } }\nclass Lost extends Gone implements Far { }\n",
    "i/Gone.java": "package q;\nclass Gone extends RuntimeException { }\n@interface Far { int value() default 1; }\n",
    "j/Alone.java": "package r;\nclass Alone { Alone() { } int z; int z() { return Math.abs(z); } Alone make() { return new Alone(); } }\n",
}


@pytest.mark.parametrize("edges", [("READS", "WRITES"), ("DEPENDS_ON",), ("CREATES",), ("THROWS", "CATCHES"), ("EXTENDS", "IMPLEMENTS"), ("CATCHES", "READS", "DEPENDS_ON")])
def test_declarations_read_apart_settle_the_same(spark, edges, monkeypatch):
    files = spark.createDataFrame([*APART.items(), *java_fixture.FILES.items()], "path string, text string")
    monkeypatch.setattr(catalogue_java, "java_files", lambda *_: files)
    rows = lambda df: sorted(str(r) for r in df.drop("seq").collect())
    ids = [*(TYPES if set(edges) - {"READS", "WRITES"} else ()), *(("FIELD",) if set(edges) & {"READS", "WRITES"} else ())]
    whole = resolve.link(cut(java_source.emissions(files, (), ids, edges), "java", ("record", "kind")))
    assert whole.count() > 0 and rows(catalogue_java.read(spark, "", edges=edges).edges) == rows(whole)


def test_only_texts_that_may_inject_are_parsed(spark, monkeypatch):
    texts = {**APART, **java_fixture.FILES}
    files = spark.createDataFrame(list(texts.items()), "path string, text string")
    monkeypatch.setattr(catalogue_java, "java_files", lambda *_: files)
    rows = lambda df: sorted(str(r) for r in df.drop("seq").collect())
    injected = "attributes['injection'] is not null"
    found = catalogue_java.read(spark, "", edges=("DEPENDS_ON",), only=injected, may=java_source.may_inject).edges
    assert found.count() > 8 and rows(found) == rows(catalogue_java.read(spark, "", edges=("DEPENDS_ON",)).edges.where(injected))
    assert {p[0] for p in APART if java_source.may_inject(APART[p])} == set("acdfgh")
    assert java_source.may_inject("".join(f"class A{i} {{ }} " for i in range(17)))
    assert not java_source.may_inject("class A { A( /* none */ ) { } A a = new A(); void f(A a) { } }") and java_source.may_inject("class A { A // one\n (/* two */int a) { } }")


def test_only_files_that_may_tell_are_parsed(spark):
    files = spark.createDataFrame(list(APART.items()), "path string, text string")
    of = lambda df: {r["path"][0] for r in df.select("path").collect()}
    access = cut(java_source.emissions(files, (), (), ("READS", "WRITES")), "java", ("record", "kind"))
    assert of(resolve.holders(access, files)) == set("abdg")
    alone = files.where("path >= 'i'")
    thrown = cut(java_source.emissions(alone, (), (), ("CREATES", "READS")), "java", ("record", "kind"))
    assert of(resolve.holders(thrown, alone)) == set()
    assert resolve.holders(thrown.where("kind = 'WRITES'"), alone) is None


def test_members_of_annotations_are_not_evaluated_where_nothing_tells_them(monkeypatch):
    def no(*_):
        raise AssertionError("evaluated")

    monkeypatch.setattr(java_source._Parser, "members", no)
    for text in java_fixture.FILES.values():
        assert java_source.parse(text, "A.java", frozenset(), frozenset(TYPES), frozenset({"READS", "WRITES", "DEPENDS_ON"})) is not None
    with pytest.raises(AssertionError):
        java_source.parse(java_fixture.FILES["src/main/java/shop/Order.java"], "A.java", frozenset({"METHOD"}), (), frozenset({"READS"}))


def test_literals_are_no_fields():
    refs = [e["refs"] for e in java_source.parse("package p; class A { int a; boolean f() { return a == null || true; } }", "A.java", frozenset(), (), frozenset({"READS"}))]
    assert refs == [["type:p.A.field:a"]]
