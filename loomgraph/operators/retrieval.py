"""Text and vector retrieval."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.functions import text as X
from loomgraph.functions import vectors as V
from loomgraph.store import cut, is_empty

K1, B = 1.2, 0.75
#: Query vectors that are sent to the tasks at once, about; rows and queries of one matrix product.
QUERIES, ROWS, ASKED = 8192, 2048, 1024


def postings(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, term, tf, length): one row a document and term."""
    terms = docs.select(F.col(id_col).alias("id"), X.tokenize(F.col(text_col)).alias("terms"))
    return (
        terms.select("id", F.size("terms").cast("long").alias("length"), F.explode("terms").alias("term"))
        .groupBy("id", "term", "length")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def term_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, df, total): documents that have the term, and how often it stands in all. Both are counted in one pass
    and summed on the map side, so that what is shuffled grows with the vocabulary of a task, not the texts."""
    terms = docs.select(X.tokenize(F.col(text_col)).alias("ts"))
    marked = F.concat("ts", F.transform(F.array_distinct("ts"), lambda t: F.concat(F.lit("+"), t)))
    counts = terms.select(F.explode(marked).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    once = F.startswith("t", F.lit("+"))
    return counts.groupBy(F.ltrim("t", F.lit("+")).alias("term")).agg(F.sum(F.when(once, F.col("n"))).alias("df"), F.sum(F.when(~once, F.col("n"))).alias("total"))


def asked_terms(spark: SparkSession, questions: list[tuple[int, str]]) -> list[tuple[int, str, int]]:
    """(question, term, how often) of a stated, small set of questions."""
    asked = spark.createDataFrame(questions, "qid long, question string").select("qid", F.explode(X.query_terms(F.col("question"))).alias("term"))
    return sorted((r["qid"], r["term"], r["count"]) for r in asked.groupBy("qid", "term").count().collect())


def bm25(docs: DataFrame, questions: list[tuple[int, str]], limit: int | None = 10, prior=None, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(qid, id, score, rank): the best documents of each question, ties by id. Questions are a stated, small
    set: one pass over the texts keeps a document's length and asked terms, and the rest works on those."""
    spark = docs.sparkSession
    asked = asked_terms(spark, questions)
    wanted = spark.createDataFrame(asked or [(0, "", 0)], "qid long, term string, mult long")
    known = F.array(*[F.lit(t) for t in sorted({t for _, t, _ in asked}) or [""]])
    base = docs.select(F.col(id_col).alias("id"), (prior if prior is not None else F.lit(1.0)).alias("prior"), X.tokenize(F.col(text_col)).alias("terms"))
    base = base.select("id", "prior", F.size("terms").alias("length"), F.filter("terms", lambda t: F.array_contains(known, t)).alias("terms"))
    base = cut(base, "bm25")
    n_docs, avg = base.agg(F.count(F.lit(1)), F.avg("length")).first()
    hits = base.select("id", "prior", "length", F.explode("terms").alias("term"))
    hits = hits.groupBy("id", "prior", "length", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = base.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    # df and wanted have a row an asked term: sizes that the questions bound.
    scored = hits.join(F.broadcast(df.join(wanted, "term")), "term")
    idf = F.log(1 + (F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("mult") * idf * (F.col("tf") * (K1 + 1)) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(float(avg or 1.0))))
    total = scored.groupBy("qid", "id", "prior").agg(F.sum(part).alias("s")).where("s > 0").select("qid", "id", (F.col("s") * F.col("prior")).alias("score"))
    best = Window.partitionBy("qid").orderBy(F.col("score").desc(), "id")
    ranked = total.withColumn("rank", F.row_number().over(best))
    return ranked.where(F.col("rank") <= limit) if limit else ranked


def node_text(nodes: DataFrame) -> DataFrame:
    """Nodes as search documents: name, id, kind and all attributes; external symbols have none."""
    attributes = F.array_join(F.transform(F.map_entries(F.coalesce("attributes", F.create_map().cast("map<string,string>"))), lambda e: F.concat_ws(" ", e["key"], e["value"])), " ")
    return nodes.where("kind <> 'EXTERNAL_SYMBOL'").select("id", "kind", "name", "file", F.concat_ws(" ", "name", "id", "kind", attributes).alias("text"))


def search_nodes(nodes: DataFrame, questions: list[tuple[int, str]], limit: int = 10) -> DataFrame:
    docs = node_text(nodes)
    return bm25(docs, questions, limit, prior=X.kind_prior(F.col("kind")))


def mentions(docs: DataFrame, needle: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The plain text search: documents that contain the needle, and the line that it first stands on."""
    t = F.col(text_col)
    head = F.substring_index(t, needle, 1)
    return docs.where(F.contains(t, F.lit(needle))).select(F.col(id_col), (F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("first_line"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int, test=None) -> DataFrame:
    """(qid, id, similarity, rank) of the k vectors (id, v) most like each query (qid, q): exact, by cosine.
    The queries are a stated set, sent to the tasks in blocks of about QUERIES, one pass a block; a query's best k
    of each task are all that is shuffled. test: which rows are demoted as test code. Vectors and queries that are no
    plain vectors of one length (nulls, no numbers, other lengths) are compared by expressions, pair by pair."""
    plain = lambda c, d: F.coalesce((F.size(c) == d) & F.forall(c, lambda x: F.abs(x) <= 2), F.lit(False))
    n, d = queries.agg(F.count(F.lit(1)), F.max(F.size("q"))).first()
    d = max(d or 0, 0)
    asked = queries.select("qid", V.unit(F.col("q")).alias("q"))
    if vectors.rdd.getNumPartitions() < vectors.sparkSession.sparkContext.defaultParallelism:
        vectors = vectors.repartition(vectors.sparkSession.sparkContext.defaultParallelism)
    flag = F.coalesce(test, F.lit(False)) if test is not None else F.lit(False)
    given = vectors.select("id", "v", flag.alias("test")).withColumn("u", V.unit(F.col("v")))
    fine = plain(F.col("u"), d) & F.col("id").isNotNull()
    blocks = max(1, -(-n // QUERIES))
    parts = []
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b) if blocks > 1 else asked
        parts.append(_best(given.where(fine), block.where(plain(F.col("q"), d)), k, d))
    odd = (given.where(~fine), asked), (given.where(fine), asked.where(~plain(F.col("q"), d)))
    for some, with_ in odd:
        if not is_empty(some) and not is_empty(with_):
            score = V.dot(F.col("u"), F.col("q"))
            parts.append(some.crossJoin(F.broadcast(with_)).select("qid", "id", X.demote(score, F.col("test")).alias("similarity")))
    w = Window.partitionBy("qid").orderBy(F.col("similarity").desc(), "id")
    return reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _best(vectors: DataFrame, queries: DataFrame, k: int, d: int) -> DataFrame:
    """(qid, id, similarity): each task's k best of vectors (id, u, test) for each of a block of queries (qid, q), unit
    vectors of d numbers. Matrix products tell which pairs can be among them; these are summed again in a fixed order."""
    spark = vectors.sparkSession
    block = queries.select("qid", "q").toArrow()
    qids = block.column("qid").combine_chunks()
    asked = np.asarray(block.column("q").combine_chunks().flatten(), dtype=np.float64).reshape(len(qids), d) if len(qids) else np.zeros((0, d))
    sent = spark.sparkContext.broadcast((qids, asked))
    schema = T.StructType([T.StructField("qid", queries.schema["qid"].dataType), T.StructField("id", vectors.schema["id"].dataType), T.StructField("similarity", T.DoubleType())])

    def run(batches):
        import pyarrow as pa

        qids, asked = sent.value
        best = BestPairs(asked, k)
        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                best.add(some.column(0).to_numpy(zero_copy_only=False), np.asarray(some.column(1).flatten(), dtype=np.float64).reshape(some.num_rows, asked.shape[1]), some.column(2).to_numpy(zero_copy_only=False))
        if len(best.of):
            yield pa.RecordBatch.from_arrays([qids.take(pa.array(best.of)), pa.array(best.ids, kind), pa.array(best.scores)], ["qid", "id", "similarity"])

    return vectors.select("id", "u", "test").mapInArrow(run, schema)


def _order(ids: np.ndarray) -> np.ndarray:
    """Numbers in the order of ids."""
    return np.unique(ids, return_inverse=True)[1] if ids.dtype == object else ids


def _first(group: np.ndarray, k: int, *by: np.ndarray) -> np.ndarray:
    """Indices of the first k of each group, in order by the keys."""
    order = np.lexsort((*by[::-1], group))
    g = group[order]
    starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, int)
    place = np.arange(len(g)) - np.repeat(starts, np.diff(np.r_[starts, len(g)]))
    return order[place < k]


class BestPairs:
    """The k rows most like each query, by score, then id, of rows added bit by bit: of (query's number), ids, scores."""

    def __init__(self, asked: np.ndarray, k: int):
        self.asked, self.k = asked, k
        self.turned = np.ascontiguousarray(asked.T)
        self.slack = 2e-15 * max(1, asked.shape[1])  # twice what a product of unit vectors may be off by
        self.of, self.ids, self.scores = np.zeros(0, np.int64), None, np.zeros(0)
        self.least = np.full(len(asked), -np.inf)  # a query's k-th best so far

    def add(self, ids: np.ndarray, rows: np.ndarray, test: np.ndarray) -> None:
        test = np.asarray(test, dtype=bool)
        # Of equal rows no more than the first k can count.
        marked = np.ascontiguousarray(np.column_stack([rows, test]))
        _, same = np.unique(marked.view(np.dtype((np.void, marked.shape[1] * 8))).ravel(), return_inverse=True)
        keep = _first(same.ravel(), self.k, _order(ids))
        ids, rows, test = ids[keep], rows[keep], test[keep]
        turned, found = np.ascontiguousarray(rows.T), []
        for at in range(0, len(self.asked), ASKED):
            product = self.asked[at : at + ASKED] @ turned
            if test.any():
                product[:, test] = np.minimum(product[:, test], 0.1 * product[:, test])
            floor = self.least[at : at + ASKED]
            if np.isneginf(floor).any() and len(ids) > self.k:
                floor = np.maximum(floor, np.partition(product, -self.k, axis=1)[:, -self.k])
            q, r = np.nonzero(product >= (floor - self.slack)[:, None])
            q += at
            exact = np.zeros(len(q))
            for x, y in zip(turned, self.turned, strict=True):
                exact += x[r] * y[q]
            found.append((q, r, np.where(test[r], np.minimum(exact, exact * 0.1), exact)))
        q, r, scores = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (self.of, self.of, self.scores)
        of, every = np.concatenate([self.of, q]), np.concatenate([self.ids, ids[r]]) if self.ids is not None else ids[r]
        scores = np.concatenate([self.scores, scores])
        best = _first(of, self.k, -scores, _order(every))
        self.of, self.ids, self.scores = of[best], every[best], scores[best]
        full = np.bincount(self.of, minlength=len(self.asked)) >= self.k
        least = np.full(len(self.asked), np.inf)
        np.minimum.at(least, self.of, self.scores)
        self.least = np.where(full, least, -np.inf)


def centroids(vectors: DataFrame, key: str) -> DataFrame:
    """(key, i, value): the mean of each group's unit vectors, at length 1, by dimension."""
    parts = vectors.select(key, F.posexplode(V.unit(F.col("v"))).alias("i", "x")).groupBy(key, "i").agg(F.avg("x").alias("x"))
    length = parts.groupBy(key).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("n"))
    return parts.join(length, key).select(key, "i", F.when(F.col("n") == 0, F.col("x")).otherwise(F.col("x") / F.col("n")).alias("value"))


def fold_subtrees(vectors: DataFrame, ancestors: DataFrame, how: str = "MEAN") -> DataFrame:
    """(anc, i, value): subtree vectors by dimension from (id, v) and the ancestor closure (id, anc)."""
    agg = {"MEAN": F.avg, "MAX": F.max}[how]
    return ancestors.join(vectors, "id").select("anc", F.posexplode(V.unit(F.col("v"))).alias("i", "x")).groupBy("anc", "i").agg(agg("x").alias("value"))


def facet_votes(facets: DataFrame) -> DataFrame:
    """(id, i, value): a node's vector as the mean of its facets' unit vectors (one vote a facet, whatever its
    length), at length 1, from rows (id, v)."""
    return centroids(facets, "id")


def baseline(spark: SparkSession, files: DataFrame, symbol: str) -> DataFrame:
    """What a text search for a symbol gives: the types declared in files that mention its simple name."""
    simple = symbol.split(".")[-1].split("#")[0]
    types = F.regexp_extract_all("text", F.lit(r"\b(?:class|interface|enum|record)\s+([A-Z]\w*)"), F.lit(1))
    return mentions(files, simple, "path").join(files.select("path", F.array_distinct(types).alias("types")), "path")
