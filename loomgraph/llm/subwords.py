"""Hashed word and character n-gram features, made for all distinct words of a slice at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import mix64, pieces, word_codes, words_of

#: Texts that bags() takes at a time.
STEP = 200


def word_features(words: list[str], lengths: tuple[int, ...], buckets: int):
    """(features, starts): the bucket numbers of word i are features[starts[i]:starts[i + 1]]. A word has one
    for itself and one for each n-gram of the code points of <word>, of the given lengths."""
    import numpy as np

    if not words:
        return np.zeros(0, dtype=np.int64), np.zeros(1, dtype=np.int64)
    chars = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    owner = np.repeat(np.arange(len(words)), sizes)
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    letters = mix64(chars)
    owners, found = [np.arange(len(words))], []
    with np.errstate(over="ignore"):
        # The word itself: a sum over its characters, each weighed by its place.
        place = np.arange(len(chars)) - first[owner]
        whole = np.add.reduceat(letters * (mix64(place.astype(np.uint64)) | np.uint64(1)), first)
        found.append(mix64(whole ^ np.uint64(0xABCDEF)))
        for n in lengths:
            m = len(chars) - n + 1
            if m <= 0:
                continue
            h = np.full(m, n, dtype=np.uint64)
            for k in range(n):
                h = h * np.uint64(0x100000001B3) + letters[k : k + m]
            inside = owner[:m] == owner[n - 1 :]
            owners.append(owner[:m][inside])
            found.append(mix64(h[inside]))
    owners, found = np.concatenate(owners), np.concatenate(found)
    order = np.argsort(owners, kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(owners, minlength=len(words)))])
    return (found[order] % np.uint64(buckets)).astype(np.int64), starts


def repeated(codes, counts):
    """The share of each text's words that end a word 2-gram which that text has had before."""
    import numpy as np
    import pandas as pd

    n, doc = len(codes), np.repeat(np.arange(len(counts)), counts)
    if n < 2:
        return np.zeros(len(counts))
    with np.errstate(over="ignore"):
        h = mix64(codes[1:].astype(np.uint64)) * np.uint64(31) + mix64(codes[:-1].astype(np.uint64)) + mix64(doc[1:].astype(np.uint64) + np.uint64(1 << 40))
    seen = pd.Series(h).duplicated().to_numpy() & (doc[1:] == doc[:-1])
    return np.bincount(doc[1:], weights=seen, minlength=len(counts)) / np.maximum(counts, 1)


def bags(texts: list[str | None], lengths: tuple[int, ...], buckets: int, fold: bool):
    """For each text its (buckets, weights): the average over words of the average over a word's features.
    Bucket number `buckets` stands for a word 2-gram that the text repeats. Texts are taken a few at a time
    and bags are 32 bits wide, as the driver holds them all."""
    import numpy as np

    if len(texts) > STEP:
        return [x for i in range(0, len(texts), STEP) for x in bags(texts[i : i + STEP], lengths, buckets, fold)]
    if fold:
        texts = [t.lower() if t else t for t in texts]
    flat, counts = words_of(texts)
    codes, distinct = word_codes(flat)
    features, starts = word_features(distinct, lengths, buckets)
    ends, out, again = np.cumsum(counts), [], repeated(codes, counts)
    for i, n in enumerate(counts):
        if not n:
            out.append((np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.float32)))
            continue
        own, often = np.unique(codes[ends[i] - n : ends[i]], return_counts=True)
        size = starts[own + 1] - starts[own]
        at = np.repeat(starts[own] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        ids, back = np.unique(features[at], return_inverse=True)
        weights = np.bincount(back, weights=np.repeat(often / (n * size), size))
        out.append((np.append(ids, buckets).astype(np.int32), np.append(weights, again[i]).astype(np.float32)))
    return out


def bagged(rows: DataFrame, tag: str, lengths: tuple[int, ...], buckets: int, fold: bool):
    """[(tag, buckets, weights)] of rows (doc_id, text, tag) in order of id and tag: the tasks make the bags, so that
    the driver holds no text. Of several texts under one id the one with the least hash counts."""
    import numpy as np

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in pieces(batch, "text"):
                own = bags(part.column("text").to_pylist(), lengths, buckets, fold)
                blobs = (pa.array([x[k].tobytes() for x in own], pa.binary()) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column(tag), *blobs], ["doc_id", tag, "ids", "weights"])

    once = rows.groupBy("doc_id", tag).agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    kinds = dict(rows.dtypes)
    made = once.mapInArrow(run, f"doc_id {kinds['doc_id']}, {tag} {kinds[tag]}, ids binary, weights binary").orderBy("doc_id", tag)
    return [(r[tag], np.frombuffer(r["ids"], dtype=np.int32), np.frombuffer(r["weights"], dtype=np.float32)) for r in made.toLocalIterator()]


def averages(texts: list[str | None], tables, lengths: tuple[int, ...], fold: bool):
    """The matrix [text, column] of the same averages applied to tables [bucket, column], whose last row is the
    repeats': what bags(texts) @
    tables would be, worked out once for each distinct word. Also the words of each text."""
    import numpy as np

    if fold:
        texts = [t.lower() if t else t for t in texts]
    flat, counts = words_of(texts)
    codes, distinct = word_codes(flat)
    out = np.zeros((len(texts), tables.shape[1]))
    if not distinct:
        return out, counts
    features, starts = word_features(distinct, lengths, len(tables) - 1)
    doc, again = np.repeat(np.arange(len(texts)), counts), repeated(codes, counts)
    for c in range(tables.shape[1]):
        value = np.add.reduceat(tables[features, c], starts[:-1]) / np.diff(starts)
        out[:, c] = np.bincount(doc, weights=value[codes], minlength=len(texts)) / np.maximum(counts, 1) + again * tables[-1, c]
    return out, counts
