"""Language identification in two steps: the family first, by linear machines over families, then one-versus-one
linear support vector machines between the languages of that family.

Features are hashed words and character n-grams (1 to 3 code points, lower case), averaged over a document's
words. The machines are fitted on the driver, in numpy, by stochastic subgradient steps on the hinge loss,
over at most `sample` documents. Scoring is one pass in Arrow batches: a machine is one weight a bucket, and
each distinct word of a slice is worked out once for all machines.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import cut, pieces, table
from loomgraph.llm.subwords import averages, bagged

LENGTHS, BUCKETS = (1, 2, 3), 1 << 15
#: The most documents that the machines are fitted on, and the least number of each language.
SAMPLE, LEAST = 5000, 50
#: So many languages with their counts are broadcast.
FEW = 10_000
# Families by ISO 639-1 code; a language that isn't listed is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "nb", "nl", "nn", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "tr", "uz"),
}


def family(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang in langs), lang)


def svm(rows, signs, epochs: int = 6, rate: float = 4.0, decay: float = 1e-6, seed: int = 3):
    """The weights of one linear machine (bias in the last place); signs are 1 or -1."""
    import numpy as np

    rng = np.random.default_rng(seed)
    w = np.zeros(BUCKETS + 1)
    step, steps = 0, epochs * len(rows)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            lr = rate * (1 - step / steps)
            step += 1
            ids, weights = rows[i]
            if signs[i] * (w[ids] @ weights * 10 + w[-1]) < 1:
                w[ids] += lr * signs[i] * 10 * weights
                w[-1] += 0.01 * lr * signs[i]
        w[:-1] *= 1 - decay
    return w


def fit(rows: list[tuple], langs: list[str], **options):
    """The pairs of families and of languages within a family, each with its machine, from the bags (buckets,
    weights) of documents."""
    rows = [(ids[ids < BUCKETS], weights[ids < BUCKETS]) for ids, weights in rows]
    fams = [family(x) for x in langs]
    model = {"families": {f: sorted({x for x in set(langs) if family(x) == f}) for f in sorted(set(fams))}, "machines": {}}

    def learn(tags, names):
        for a, b in combinations(names, 2):
            own = [i for i, t in enumerate(tags) if t in (a, b)]
            model["machines"][a, b] = svm([rows[i] for i in own], [1 if tags[i] == a else -1 for i in own], **options)

    learn([f"family {f}" for f in fams], [f"family {f}" for f in model["families"]])
    for own in model["families"].values():
        learn(langs, own)
    return model


def _vote(names, margins):
    """(index of the winner, its odds) of each row: most duels won, then the larger sum of margins."""
    import numpy as np

    n = len(next(iter(margins.values()))) if margins else 0
    wins, total = np.zeros((len(names), n)), np.zeros((len(names), n))
    for (i, a), (j, b) in combinations(enumerate(names), 2):
        m = margins[a, b]
        wins[i] += m >= 0
        wins[j] += m < 0
        total[i] += m
        total[j] -= m
    best = np.argmax(wins + 0.5 * np.tanh(total) / max(1, len(names)), axis=0)
    least = np.full(n, np.inf)
    for (i, a), (j, b) in combinations(enumerate(names), 2):
        m = margins[a, b]
        least = np.where(best == i, np.minimum(least, m), np.where(best == j, np.minimum(least, -m), least))
    return best, 1 / (1 + np.exp(-np.clip(2 * least, -500, 500)))


def predict(texts: list[str | None], model):
    """(languages, scores); `und` and 0 for texts without a letter."""
    import numpy as np

    pairs = list(model["machines"])
    lettered = np.array([bool(t) and any(map(str.isalpha, t)) for t in texts], dtype=bool)
    langs, scores = np.full(len(texts), "und", dtype=object), np.zeros(len(texts))
    if not model["families"] or not lettered.any():
        return langs, scores
    tables = np.array([np.append(model["machines"][p][:BUCKETS], 0) for p in pairs]).T if pairs else np.zeros((BUCKETS + 1, 0))
    mean, _ = averages(texts, tables, LENGTHS, fold=True)
    margins = {p: mean[:, k] * 10 + model["machines"][p][-1] for k, p in enumerate(pairs)}
    names = list(model["families"])
    if len(names) > 1:
        which, odds = _vote([f"family {f}" for f in names], margins)
    else:
        which, odds = np.zeros(len(texts), dtype=int), np.ones(len(texts))
    for k, f in enumerate(names):
        own, here = model["families"][f], lettered & (which == k)
        if len(own) > 1:
            best, inner = _vote(own, {p: m for p, m in margins.items() if p[0] in own and p[1] in own})
        else:
            best, inner = np.zeros(len(texts), dtype=int), np.ones(len(texts))
        langs[here] = np.array(own, dtype=object)[best[here]]
        scores[here] = (odds * inner)[here]
    return langs, scores


def training_rows(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, text, lang) of at most `sample` documents that aren't held out, about as many of each language, LEAST at
    least: those whose ids have the smallest hashes (nearly always; a language may lack a few of its share). Ids
    are chosen first, so that only the sample's texts travel."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    ids = known.select("doc_id", "lang")
    counts = cut(ids.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "lang-counts")
    languages = counts.count()
    share = max(LEAST, sample // max(1, languages))
    if languages <= FEW:  # so that the documents of a frequent language don't meet in one task
        counts = F.broadcast(counts)
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 11).cast("double") / F.lit(float(1 << 53))
    # Few more than the share are left of a language, however many it has, before they are ranked.
    near = ids.join(counts, "lang").where(place * F.col("n") < 2 * share + 20).select("doc_id", "lang").distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = near.withColumn("rank", rank).where(F.col("rank") <= share).select("doc_id").distinct()
    # About `sample` ids: a size that is known beforehand.
    return known.select("doc_id", "text", "lang").join(F.broadcast(chosen), "doc_id")


def train(docs: DataFrame, sample: int = SAMPLE):
    rows = bagged(training_rows(docs, sample), "lang", LENGTHS, BUCKETS, fold=True)
    return fit([(ids, weights) for _, ids, weights in rows], [lang for lang, _, _ in rows])


def identify(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, lang_pred, score. Null, empty and letterless texts are `und` with score 0, as is every text
    when nothing was learned; repeated rows get equal answers; other columns are not read. Of languages with as
    many duels won the one with the larger margins is told, then the first by name."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in pieces(batch, "t"):
                langs, scores = predict(part.column("t").to_pylist(), model)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(list(langs), pa.string()), pa.array(scores)], ["id", "lang_pred", "score"])

    slim = docs.select(docs[id_col].alias("id"), docs[text_col].alias("t"))
    return slim.mapInArrow(run, f"id {dict(slim.dtypes)['id']}, lang_pred string, score double").withColumnRenamed("id", id_col)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: held_out, lang_pred, score."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = identify(docs, train(docs))
    return out.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"), "lang_pred", "score")
