from collections import Counter, defaultdict

import pytest
import support
from pyspark.sql import functions as F

from loomgraph.llm import line_dedup, mixing, registry


def test_line_dedup_equals_sql(spark, sf, duck):
    support.same(line_dedup.op10_line_dedup(spark, sf), line_dedup.OP10_SQL, duck)


def test_line_dedup_counts_documents(spark, duck):
    rows = [(1, "Often\nx")] * 10 + [(i, "Twice\ny") for i in range(2, 6) for _ in range(3)] + [(i, "all\nz") for i in range(20, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_dedup.dedup_lines(docs).select("row.doc_id", "n_dropped").distinct().collect()
    duck = duck.cursor()
    duck.register("repeated", docs.distinct().toPandas())
    want = duck.sql(line_dedup.OP10_SQL.replace("FROM documents", "FROM repeated")).df()
    assert {(r["doc_id"], r["n_dropped"]) for r in got} == set(zip(want["doc_id"], want["n_dropped"], strict=True))
    assert sum(r["n_dropped"] for r in got) == 20


def brute_lines(rows, min_docs):
    strip, fold = " \t\n\x0b\x0c\r", {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    key = lambda x: x.strip(strip).translate(fold)
    seen = Counter(k for k, _ in {(key(x), i) for i, t in rows for x in (t or "").split("\n")} if k)
    out = []
    for _, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (key(x) and seen[key(x)] >= min_docs)]
        out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def test_line_dedup_odd_rows(spark, odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = line_dedup.dedup_lines(odd, min_docs=3).select("row.text", "kept_text", "n_lines", "n_dropped").collect()
    want = Counter((t, *x) for (_, t), x in zip(rows, brute_lines(rows, 3), strict=True))
    assert Counter(tuple(r) for r in got) == want
    assert line_dedup.dedup_lines(none).count() == 0
    assert line_dedup.stage(spark, odd, "").columns == odd.columns


def test_line_dedup_keeps_positions(spark):
    docs = spark.createDataFrame([(i, f"a{i}\n Shared \nb{i}\nSHARED\n\nc{i}") for i in range(5)], "doc_id long, text string")
    got = {r["id"]: (r["kept_text"], r["n_dropped"]) for r in line_dedup.dedup_lines(docs, min_docs=5).select("row.doc_id", "kept_text", "n_dropped").withColumnRenamed("doc_id", "id").collect()}
    assert got[3] == ("a3\nb3\n\nc3", 2)


def fill(sizes, weights=(1, 2, 3)):
    """Targets by giving out the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, open_, left = dict.fromkeys(names, 0.0), set(names), float(sum(sizes.values()))
    while left > 1e-9 and open_:
        total = sum(w[s] for s in open_)
        share = {s: left * w[s] / total for s in open_}
        left = 0.0
        for s in list(open_):
            target[s] += share[s]
            if target[s] > 3 * sizes[s]:
                left += target[s] - 3 * sizes[s]
                target[s] = 3.0 * sizes[s]
                open_.discard(s)
    return target


def test_targets_fill_up_like_the_loop(spark):
    sizes = {"a": 10, "b": 5000, "c": 100, "d": 7, None: 900, "e": 0, "f": 1}
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    want = fill(sizes)
    assert all(got[s] == pytest.approx(want[s], abs=1e-6) for s in sizes)


def test_mix_meets_targets(spark, sf):
    rows = mixing.op6_mixing(spark, sf).collect()
    again = mixing.op6_mixing(spark, sf).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in rows) == sorted((r["doc_id"], r["taken"]) for r in again)
    taken, most, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        taken[r["source"]] += r["taken"]
        most[r["source"]] = max(most[r["source"]], r["size"])
        target[r["source"]] = r["target"]
        assert r["taken"] % max(r["size"], 1) == 0 and r["taken"] <= 3 * r["size"]
    assert sum(target.values()) == pytest.approx(sum(r["size"] for r in rows))
    assert all(abs(taken[s] - target[s]) <= most[s] / 2 + 1e-6 for s in target)


def test_mix_rounds_by_blocks(spark):
    df = spark.range(3000).select(F.col("id"), F.lit("s").alias("source"), (F.col("id") % 50 + 1).alias("size")).union(spark.range(9).select(F.col("id") + 5000, F.lit("t"), F.lit(5)))
    got = mixing.mix(df, block=8).collect()
    assert len(got) == 3009
    s = [r for r in got if r["source"] == "s"]
    assert abs(sum(r["copies"] * r["size"] for r in s) - s[0]["target"]) <= 25
    rate = s[0]["target"] / s[0]["source_size"]
    assert {r["copies"] for r in s} <= {int(rate), int(rate) + 1}


def test_equal_rows_are_one_group(spark):
    df = spark.range(5000).select(F.lit(None).cast("long").alias("id"), F.lit("s").alias("source"), F.lit(7).alias("size"))
    df = df.union(spark.range(40).select(F.col("id"), F.lit("t"), F.lit(1000)))
    got = mixing.mix(df, block=8).collect()
    assert len(got) == 5040
    for s, size in (("s", 7), ("t", 1000)):
        own = [r for r in got if r["source"] == s]
        assert abs(sum(r["copies"] * size for r in own) - own[0]["target"]) <= size / 2 + 1e-6
        assert max(r["copies"] for r in own) - min(r["copies"] for r in own) <= 1


def test_mix_odd_rows(odd, none):
    got = mixing.mix_documents(odd).collect()
    assert len(got) == odd.count()
    assert all(r["copies"] >= 0 for r in got)
    assert mixing.mix_documents(none).count() == 0


def test_registry_names():
    assert {n.split("_")[0] for n in registry.QUERIES} == {f"op{i}" for i in range(1, 11)}
    assert set(registry.ORACLES) <= set(registry.QUERIES)
