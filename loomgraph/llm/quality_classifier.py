"""Quality classifier: supervised subword embeddings. Hashed word and character n-gram vectors, and one vector for
repeated word 2-grams (an addition to the method, with its measured share in the README), are learned together with
a softmax output by stochastic gradient descent in numpy; a document is the average of its words' vectors.

The driver fits on at most `sample` labelled documents (those whose ids have the smallest hashes), whole
texts, which the tasks turn into bags of buckets. As everything up to the softmax is linear, scoring needs one
number a bucket: the fitted vectors are multiplied out, each distinct word of a slice is scored once, and a
document costs one sum over its words. Scoring is one pass in Arrow batches without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import pieces, table
from loomgraph.llm.subwords import averages, bagged

LENGTHS = (2, 3, 4)
BUCKETS, DIM, EPOCHS, RATE = 1 << 17, 12, 5, 0.5
#: The most labelled documents that the model is fitted on.
SAMPLE = 6000


def fit(rows: list[tuple], labels: list[int], epochs: int = EPOCHS, rate: float = RATE, seed: int = 5):
    """(one logit a bucket, bias) from the bags (buckets, weights) of documents: positive means label 1. Without both
    labels it knows only their share."""
    import numpy as np

    rng = np.random.default_rng(seed)
    y = np.array(labels, dtype=np.int64)
    share = (y.sum() + 1) / (len(y) + 2)
    if len(set(labels)) < 2:
        return np.zeros(BUCKETS + 1), float(np.log(share / (1 - share)))
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS + 1, DIM))
    output, bias = rng.normal(0, 0.1, (DIM, 2)), np.log(np.array([1 - share, share]))
    steps, step = epochs * len(rows), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            lr = rate * (1 - step / steps)
            step += 1
            ids, weights = rows[i]
            if not len(ids):
                continue
            hidden = weights @ vectors[ids]
            z = hidden @ output + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = output @ p
            output -= lr * np.outer(hidden, p)
            bias -= 0.02 * lr * p
            # Each weight is about one over the features of a document, so the step is scaled up to reach them.
            vectors[ids] -= (lr * 20) * weights[:, None] * back
    return vectors @ (output[:, 1] - output[:, 0]), float(bias[1] - bias[0])


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, text, quality) of at most `sample` labelled documents that aren't held out. A document whose labels
    clash isn't learned from."""
    own = labels.where(F.col("quality").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 3 != 1))
    own = own.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most and doc_id is not null")
    chosen = own.select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # `sample` rows of two numbers: a size that is known beforehand.
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "quality")


def classify(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, score, predicted of every document. A null or empty text has no words: its score is that of
    the bias. Repeated rows get equal scores; other columns are not read."""
    logits, bias = model

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for part in pieces(batch, "t"):
                mean, _ = averages(part.column("t").to_pylist(), logits[:, None], LENGTHS, fold=False)
                score = 1 / (1 + np.exp(-np.clip(mean[:, 0] + bias, -500, 500)))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(score)], ["id", "score"])

    slim = docs.select(docs[id_col].alias("id"), docs[text_col].alias("t"))
    out = slim.mapInArrow(run, f"id {dict(slim.dtypes)['id']}, score double")
    return out.select(F.col("id").alias(id_col), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    rows = bagged(training_rows(docs, labels, sample), "quality", LENGTHS, BUCKETS, fold=False)
    return fit([(ids, weights) for _, ids, weights in rows], [int(q == 1) for q, _, _ in rows])


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: held_out, score, predicted."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = classify(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 3 == 1).alias("held_out"), "score", "predicted")
