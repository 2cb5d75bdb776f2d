import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from loomgraph.llm import decontaminate, lm_scoring, ngram_join, suffix_dedup

W = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def shingles(text, k):
    w = W.findall((text or "").translate(FOLD))
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute_join(rows, k, percent):
    """{id: (n, component)} by every pair."""
    ids, sets = [i for i, _ in rows], [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                root[top(i)] = top(j)
    least = defaultdict(lambda: float("inf"))
    for i, x in enumerate(ids):
        least[top(i)] = min(least[top(i)], x)
    return {x: (len(sets[i]), least[top(i)]) for i, x in enumerate(ids)}


def family(seed, n, words, edits):
    r = random.Random(seed)
    base = [f"f{seed}w{r.randrange(5000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randrange(edits + 1)):
            w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_join_equals_every_pair(spark, k, percent, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 7)  # families go over several blocks
    texts = family(1, 30, 200, 6) + family(2, 25, 60, 3) + family(3, 10, 12, 1) + family(4, 12, 3, 1) + ["one two", "One TWO", "one", "one", "", None, "a b c", "a b c", " a\nb\tc "]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join_ngrams(df, k, percent).collect()}
    assert got == brute_join(rows, k, percent)


@pytest.mark.parametrize(("rows_a", "rows_b"), [(900, 300), (5, 700), (17, 16), (1, 1)])
def test_trees_of_several_levels_find_every_pair(rows_a, rows_b):
    """Families of unlike sizes, in no order; trees of unlike heights."""
    import numpy as np

    rng = np.random.default_rng(9)
    bases = [rng.multinomial(m, rng.dirichlet(np.ones(16))) for m in (40, 60, 90, 200, 200, 210, 400) for _ in range(3)]
    draw = lambda n: np.maximum(np.stack([bases[k] for k in rng.integers(0, len(bases), n)]) - rng.binomial(2, 0.3, (n, 16)), 0).astype(np.int32)
    a, b = draw(rows_a), draw(rows_b)
    n = lambda x: x.sum(axis=1).astype(np.int64)
    common = np.minimum(a[:, None], b[None]).sum(axis=2)
    for percent in (80, 90):
        i, j, slack = ngram_join.tree_pairs(a, n(a), b, n(b), percent)
        want = common * (100 + percent) - percent * (n(a)[:, None] + n(b)[None])
        assert len(i) == int((want >= 0).sum()) == len(set(zip(i.tolist(), j.tolist(), strict=True)))
        assert (want[i, j] == slack).all() and (slack >= 0).all()
    order, levels = ngram_join.loaded(a, n(a), 90)
    assert sorted(order.tolist()) == list(range(rows_a)) and len(levels[-1][0]) == 1


@pytest.mark.parametrize("larger_first", [True, False])
def test_trees_find_truncated_copies(larger_first):
    import numpy as np

    rng = np.random.default_rng(4)
    large = np.array([rng.multinomial(100, [1 / 12] * 12) for _ in range(3)]).repeat(20, axis=0)  # 20 at a place, so that boxes are tight
    small = large.copy()
    for f in range(0, 60, 20):
        for _ in range(20):
            small[f : f + 20, rng.choice(np.flatnonzero(small[f]))] -= 1
    a, b = (large, small) if larger_first else (small, large)
    n = lambda x: x.sum(axis=1).astype(np.int64)
    i, j, _ = ngram_join.tree_pairs(a, n(a), b, n(b), 80)
    common = np.minimum(a[:, None], b[None]).sum(axis=2)
    want = np.nonzero(180 * common >= 80 * (n(a)[:, None] + n(b)[None]))
    assert len(want[0]) >= 60 and set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*(x.tolist() for x in want), strict=True))


def test_join_on_documents(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.op8_ngram_join(spark, sf).collect()}
    assert got == brute_join(rows, 3, 90)


def test_join_odd_rows(spark, odd, none):
    got = ngram_join.join_ngrams(odd, 5, 80).collect()
    assert len(got) == odd.count()
    by = {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None}
    assert (by[1], by[2], by[4], by[5], by[8]) == (1, 2, 4, 4, 4)
    assert ngram_join.join_ngrams(none).count() == 0
    two = odd.union(odd.where("doc_id = 8").withColumn("text", F.lit("another text of five words or more under a known id")))
    assert sorted((r["doc_id"] or -1) for r in ngram_join.stage(spark, two, "").collect()) == [-1, -1, 1, 2, 3, 4, 6, 7, 8, 9]
    kept = ngram_join.stage(spark, odd, "")
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, -1, 1, 2, 3, 4, 6, 7, 9]


def test_ranges_find_every_bucket():
    import pyarrow as pa

    r = random.Random(5)
    rows = sorted({(r.randrange(40), r.randrange(300)) for _ in range(400)} | {(41, i) for i in range(50)})
    want = defaultdict(set)
    for k, v in rows:
        want[k].add(v)
    for size in (1, 7, 1000):
        for cut_at in (0, 137, 300):
            got = defaultdict(set)
            for part in (rows[:cut_at], rows[cut_at:]):
                batches = [pa.RecordBatch.from_arrays([pa.array([x[c] for x in part[i : i + size]], pa.int64()) for c in (0, 1)], ["key", "node"]) for i in range(0, len(part), size)]
                for b in ngram_join._bucket_rows(iter(batches)):
                    for k, v in zip(b.column("key").to_pylist(), b.column("node").to_pylist(), strict=True):
                        got[k].add(v)
            content = {frozenset(v) for v in got.values()}
            assert all(got[k] == v or frozenset(v) in content for k, v in want.items() if len(v) > 1)


def brute_strings(rows):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - 99):
            s = b[p : p + 100]
            if s in seen:
                gone[p : p + 100] = [True] * 100
            seen.add(s)
        spans = sum(g and (not k or not gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("block", [3, 4096])
def test_strings_equal_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    r = random.Random(3)
    passage = "".join(r.choice("abcdé ") for _ in range(260))
    texts = [f"{''.join(r.choice('xyz ') for _ in range(r.randrange(200)))}{passage[r.randrange(80) : 260 - r.randrange(60)]}{r.random()}" for _ in range(25)]
    texts += ["ab" * 300, "ab" * 120, passage, passage, "x" * 99, "x" * 100, "x" * 101, "", None, "the same again " * 40]
    rows = list(enumerate(texts))
    got = suffix_dedup.dedup_strings(spark.createDataFrame(rows, "doc_id long, text string"), carry=["doc_id"]).collect()
    assert {x["row"]["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in got} == brute_strings(rows)


def test_strings_on_documents(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.op5_suffix_dedup(spark, sf).collect()}
    assert got == brute_strings(rows)


def test_strings_odd_rows(odd, none):
    got = suffix_dedup.dedup_strings(odd).collect()
    assert len(got) == odd.count()
    by = defaultdict(list)
    for r in got:
        by[r["row"]["doc_id"]].append(r["n_removed"])
    assert by[4] == [by[4][0]] * 2 and by[4][0] == by[5][0] > 0  # the null id has that text first
    assert 0 in by[None]
    assert suffix_dedup.dedup_strings(none).count() == 0


def leaks(text, items):
    """Items of which some window of the text, at any place, is 0.8 similar or more."""
    words = [w for w in map(decontaminate.normal, W.findall(text or "")) if w]
    grams = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    found = set()
    for item_id, t in items:
        own = [w for w in map(decontaminate.normal, W.findall(t or "")) if w]
        if len(own) < 5:  # as a whole document only
            found |= {item_id} if own and own == words else set()
            continue
        theirs = grams(own)
        for start in range(-len(own) + 5, len(words)):
            here = grams(words[max(0, start) : start + len(own)])
            both = sum((here & theirs).values())
            if both and both / (sum(here.values()) + sum(theirs.values()) - both) >= 0.8:
                found.add(item_id)
                break
    return found


def test_leaks_equal_every_window(spark):
    r = random.Random(9)
    say = lambda n: [f"b{r.randrange(3000)}" for _ in range(n)]
    items = [(i, say(20 + i)) for i in range(12)]
    docs = []
    for i, w in items:
        docs += [say(30) + w + say(10), w, say(5) + w[: len(w) // 2] + say(40), w[:8] + ["new"] + w[8:] + say(12), say(25) + [*w[:10], "CHANGED!", *w[11:]]]
        docs += [say(20) + w[len(w) // 2 :] + w[: len(w) // 2] + say(9), w[-6:] + w[:-6], say(9) + w[8:20] + w[:8] + w[20:]]  # moved blocks
    docs += [say(60), [], ["one"], ["too", "short"], ["a", "too", "short"]]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(90, None), (91, ""), (92, "Too short."), (93, " ".join(items[0][1]))], "item_id long, text string")
    df = spark.createDataFrame([(k, " ".join(w).upper() + ".") for k, w in enumerate(docs)], "doc_id long, text string")
    got = {x["row"]["doc_id"]: {h["item_id"] for h in x["hits"]} for x in decontaminate.find_leaks(df, bench).collect()}
    plain = [(x["item_id"], x["text"]) for x in bench.collect()]
    for k, w in enumerate(docs):
        assert got[k] == leaks(" ".join(w).upper() + ".", plain), k


def test_leaks_odd_rows(spark, odd, none, sf):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    assert decontaminate.find_leaks(odd, bench).count() == odd.count()
    assert decontaminate.find_leaks(none, bench).count() == 0
    assert decontaminate.stage(spark, odd, sf).columns == odd.columns
    assert all(not r["hits"] for r in decontaminate.find_leaks(odd, bench.limit(0)).collect())


def test_multi_index_has_all_within_the_radius():
    import numpy as np

    rng = np.random.default_rng(1)
    prints = rng.integers(0, 256, (60, decontaminate.BITS // 8), dtype=np.uint8)
    asked = []
    for _ in range(50):
        bits = np.unpackbits(prints[rng.integers(60)])
        bits[rng.choice(decontaminate.BITS, rng.integers(0, 75), replace=False)] ^= 1
        asked.append(np.packbits(bits))
    asked = np.stack(asked)
    x, y = decontaminate.MultiIndex(prints).near(asked)
    want = np.nonzero(np.bitwise_count(asked[:, None] ^ prints[None]).sum(axis=2) <= decontaminate.RADIUS)
    assert len(want[0]) > 20 and set(zip(x.tolist(), y.tolist(), strict=True)) == set(zip(*(v.tolist() for v in want), strict=True))


def test_leaks_in_several_passes(spark, monkeypatch):
    items = [(i, " ".join(f"p{i}w{k}" for k in range(20))) for i in range(8)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(1, f"{items[1][1]} and {items[6][1]}"), (1, f"{items[1][1]} and {items[6][1]}"), (2, None), (3, "clean"), (None, items[0][1])], "doc_id long, text string")
    whole = sorted(str(r) for r in decontaminate.find_leaks(docs, bench).select("row", "hits.item_id").collect())
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 300)
    assert len(decontaminate.parts_of(bench)) > 2
    got = [(r["row"], r["hits"]) for r in decontaminate.find_leaks(docs, bench).collect()]
    assert len(got) == 5 and sorted(len(h) for _, h in got) == [0, 0, 1, 2, 2] and len(whole) == 5


def test_losses_equal_a_plain_model(spark):
    import math

    texts = {1: "a b a b c", 2: "a b c c", 3: "c a b", 4: "", 5: None, 6: "zz"}
    good = {1, 3}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r for r in lm_scoring.score(df, spark.createDataFrame([(i,) for i in good], "doc_id long")).collect()}
    pairs = lambda t: list(zip(["<s>", *(t or "").split()], (t or "").split(), strict=False))
    for i, t in texts.items():
        for name, ids in (("background_loss", set(texts)), ("target_loss", good)):
            counted = [p for k in ids - {i} for p in pairs(texts[k])]
            w, h, p = Counter(x for _, x in counted), Counter(x for x, _ in counted), Counter(counted)
            loss = 0.0
            for a, b in pairs(t):
                single = (w[b] + 0.5) / (len(counted) + 0.5 * lm_scoring.WORD_SLOTS)
                loss -= math.log((p[a, b] + lm_scoring.PRIOR * single) / (h[a] + lm_scoring.PRIOR))
            assert got[i][name] == pytest.approx(loss / max(1, len(pairs(t))), rel=1e-4)
        assert got[i]["n_tokens"] == len(pairs(t))


def test_losses_of_more_words_than_slots(spark):
    import math

    r = random.Random(6)
    texts = {i: [f"v{r.randrange(400_000)}" for _ in range(20_000)] for i in range(30)}
    texts[30] = [*texts[3][:9_000], *texts[8][50:5_000]]
    good = {3, 5, 30}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
    got = {x["doc_id"]: x for x in lm_scoring.score(df, spark.createDataFrame([(i,) for i in good], "doc_id long")).collect()}
    pairs = {i: list(zip([None, *w], w, strict=False)) for i, w in texts.items()}
    size = max(lm_scoring.WORD_SLOTS, len({x for w in texts.values() for x in w}))
    for i in (0, 3, 30):
        for name, ids in (("background_loss", set(texts)), ("target_loss", good)):
            counted = [p for k in ids - {i} for p in pairs[k]]
            w, h, p = Counter(x for _, x in counted), Counter(x for x, _ in counted), Counter(counted)
            loss = -sum(math.log((p[a, b] + lm_scoring.PRIOR * (w[b] + 0.5) / (len(counted) + 0.5 * size)) / (h[a] + lm_scoring.PRIOR)) for a, b in pairs[i])
            assert got[i][name] == pytest.approx(loss / len(pairs[i]), rel=1e-6)


def test_losses_odd_rows(spark, odd, none):
    ids = spark.createDataFrame([(4,), (None,), (4,)], "doc_id long")
    assert lm_scoring.score(odd, ids).count() == odd.count()
    assert lm_scoring.score(none, ids).count() == 0
    assert lm_scoring.score(odd, ids.limit(0)).count() == odd.count()
