from collections import defaultdict

import test_lines_and_mix as lines
import test_near as near
import test_quality as quality

import corpus_pipeline
from loomgraph.llm import quality_rules


def test_stages_equal_brute_force(spark, sf):
    """Every stage but the mix row by row; the mix by its targets."""
    rows = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    texts = {}
    for i, r in rows.items():
        n, _, _, _, repeats = quality.base(r["text"])
        if n >= 50 and 100 * repeats <= 50 * n and all(quality.covered(r["text"], k) <= most for k, most in quality_rules.LIMITS.items()):
            texts[i] = r["text"]
    shares = {r["doc_id"]: r["dup_line_share"] for r in quality_rules.op3_quality_rules(spark, sf).collect()}
    texts = {i: t for i, t in texts.items() if shares[i] <= quality_rules.LINE_LIMIT}
    texts = dict(zip(texts, (x[0] for x in lines.brute_lines(list(texts.items()), 10)), strict=True))
    groups = near.brute_join(list(texts.items()), 5, 80)
    texts = {i: t for i, t in texts.items() if groups[i][1] == i}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    texts = {i: t for i, t in texts.items() if not near.leaks(t, items)}
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in got} == set(texts)
    sizes = defaultdict(int)
    for i, t in texts.items():
        sizes[rows[i]["source"]] += len(quality.WORD.findall(t))
    target = lines.fill(sizes)
    for r in got:
        assert r["size"] == len(quality.WORD.findall(texts[r["doc_id"]]))
        assert abs(r["target"] - target[r["source"]]) < 1e-6


def test_stage_list():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "n-gram join", "decontamination", "mixing"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_odd_and_empty_tables(spark, odd, none, sf, tmp_path):
    for name, docs, ids in (("odd", odd, {3, 4, 7, 8}), ("none", none, set())):
        folder = str(tmp_path / name)
        docs.write.parquet(f"{folder}/documents.parquet")
        spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
        got = {r["doc_id"] for r in corpus_pipeline.run(spark, folder).collect()}
        assert got <= ids | {None}
        assert (4 in got) == (name == "odd")
