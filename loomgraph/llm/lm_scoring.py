"""Language-model scoring by cross-entropy difference: a target and a background 2-gram model with the same
order, smoothing and vocabulary; the mean difference of their losses a token scores a document (negative:
closer to the target).

Every word, history and word pair of the corpus has a count of its own, under a 62-bit hash; no slot is shared
and nothing is held whole by a task or the driver. Documents are coded in chunks, one pass over the text. A chunk
sends its distinct words, histories and pairs with their counts, packed by range of hash; a range adds them up
and answers each chunk with the totals of what it asked. There are more ranges where there are more tokens. A
document is scored without its own counts, so that what belongs to the target isn't favoured for having been
counted.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import FOLD, cut, discard, mix64, pieces, table, word_codes, words_of

#: Least vocabulary that the lower order is smoothed over; the distinct words of the corpus if they are more.
WORD_SLOTS = 1 << 17
#: Weight of the lower order in each distribution.
PRIOR = 8.0
#: Tokens of a chunk and of a range of hashes, and the bits of the least number of ranges.
CHUNK, RANGE, LEAST_BITS = 1 << 20, 1 << 22, 8


def _pack(x) -> bytes:
    """An array of 64-bit numbers, compressed byte by byte."""
    import numpy as np
    import pyarrow as pa

    return pa.compress(np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T.tobytes(), codec="zstd", asbytes=True) if len(x) else b""


def _unpack(blob: bytes, n: int, dtype: str = "int64"):
    import numpy as np
    import pyarrow as pa

    if not n:
        return np.zeros(0, dtype=dtype)
    raw = pa.decompress(blob, decompressed_size=8 * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(8, n).T).view(dtype).ravel()


def _chunks(batches):
    """Documents in chunks: their ids, numbers of tokens and whether they are the target's, the sorted hashes of the
    chunk's words and the tokens as places in them."""
    import numpy as np
    import pyarrow as pa
    import xxhash
    from pyspark import TaskContext

    task, made, held, tokens = TaskContext.get().partitionId(), 0, [], 0

    def chunk():
        ids, counts, target = pa.concat_arrays([x[0] for x in held]), np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held])
        vocabulary, codes = np.unique(np.concatenate([x[3] for x in held]), return_inverse=True)
        listed = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        values = (len(ids), len(vocabulary), len(codes), int(counts[target > 0].sum()))
        blobs = (_pack(counts), _pack(target), _pack(vocabulary), _pack(codes.astype(np.int64)))
        columns = [pa.array([task << 32 | made]), listed, *(pa.array([x], pa.int64()) for x in values), *(pa.array([x], pa.binary()) for x in blobs)]
        return pa.RecordBatch.from_arrays(columns, ["chunk", "ids", "docs", "words", "tokens", "target_tokens", "counts", "target", "vocabulary", "codes"])

    for batch in batches:
        for part in pieces(batch, "t"):
            flat, counts = words_of([t.translate(FOLD) if t else t for t in part.column("t").to_pylist()])
            codes, distinct = word_codes(flat)
            hashed = np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in distinct), dtype=np.uint64, count=len(distinct))
            held.append((part.column("id"), counts, part.column("target").to_numpy(zero_copy_only=False).astype(np.int64), hashed[codes]))
            tokens += len(flat)
            if tokens >= CHUNK:
                yield chunk()
                made, held, tokens = made + 1, [], 0
    if held:
        yield chunk()


def _opened(row: dict):
    """(number of tokens and target flag of each document, sorted order of the keys, the keys, places of each token's
    word, history and pair among the keys). The history of a first word is one that no word has."""
    import numpy as np

    docs, size, tokens = row["docs"], row["words"], row["tokens"]
    counts, target = _unpack(row["counts"], docs), _unpack(row["target"], docs)
    vocabulary, codes = _unpack(row["vocabulary"], size, "uint64"), _unpack(row["codes"], tokens)
    before = np.concatenate([[size], codes[:-1]]).astype(np.int64) if tokens else codes
    before[(np.cumsum(counts) - counts)[counts > 0]] = size
    pairs, at = np.unique(before * size + codes, return_inverse=True)
    histories = np.append(vocabulary, np.uint64(0))
    first, second = pairs // max(size, 1), pairs % max(size, 1)
    with np.errstate(over="ignore"):
        paired = mix64(histories[first]) * np.uint64(0x100000001B3) ^ vocabulary[second]
    kinds = [(mix64(x) & ~np.uint64(3)) | np.uint64(k) for k, x in ((1, vocabulary), (2, histories), (3, paired))]
    keys = np.concatenate(kinds)
    return counts, target, np.argsort(keys, kind="stable"), keys, (codes, size + before, 2 * size + 1 + at)


def _ask(bits: int):
    """The keys of chunks and their counts there, a row a range of hashes."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                if not row["tokens"]:
                    continue
                counts, target, order, keys, places = _opened(row)
                own = np.repeat(target, counts) > 0
                in_all = sum(np.bincount(x, minlength=len(keys)) for x in places)[order]
                in_target = sum(np.bincount(x[own], minlength=len(keys)) for x in places)[order]
                keys = keys[order]
                ranges = (keys >> np.uint64(64 - bits)).astype(np.int64)
                starts = np.flatnonzero(np.append(True, ranges[1:] != ranges[:-1]))
                ends = np.append(starts[1:], len(keys))
                blobs = [(_pack(np.diff(keys[i:j], prepend=np.uint64(0))), _pack(in_all[i:j]), _pack(in_target[i:j])) for i, j in zip(starts, ends, strict=True)]
                columns = [pa.array(ranges[starts].astype(np.int32)), pa.array([row["chunk"]] * len(starts), pa.int64()), pa.array((ends - starts).astype(np.int64))]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x, pa.binary()) for x in zip(*blobs, strict=True))], ["range", "chunk", "n", "keys", "in_all", "in_target"])

    return run


def _answer(t):
    """The totals of a range's keys, for each chunk in the order in which it asked; one row has the number of
    distinct words in the range."""
    import numpy as np
    import pyarrow as pa

    n = t.column("n").to_pylist()
    keys = np.concatenate([np.cumsum(_unpack(b, k, "uint64"), dtype=np.uint64) for b, k in zip(t.column("keys").to_pylist(), n, strict=True)])
    distinct, at = np.unique(keys, return_inverse=True)
    ends, blobs = np.cumsum(n), []
    for c in ("in_all", "in_target"):
        counted = np.concatenate([_unpack(b, k) for b, k in zip(t.column(c).to_pylist(), n, strict=True)])
        totals = np.bincount(at, weights=counted, minlength=len(distinct)).astype(np.int64)[at]
        blobs.append(pa.array([_pack(totals[e - k : e]) for e, k in zip(ends, n, strict=True)], pa.binary()))
    words = [int(((distinct & np.uint64(3)) == 1).sum())] + [0] * (len(n) - 1)
    columns = [t.column("range"), t.column("chunk"), t.column("n"), pa.array(words, pa.int64()), *blobs]
    return pa.Table.from_arrays(columns, ["range", "chunk", "n", "new_words", "in_all", "in_target"])


def losses(row: dict, answers: list[dict], totals: tuple[int, int], vocabulary: int):
    """Mean loss (nats) a token of each text of a chunk under the background and the target model, and the tokens."""
    import numpy as np
    import pandas as pd

    counts, target, order, keys, places = _opened(row)
    doc = np.repeat(np.arange(len(counts)), counts)
    own = np.repeat(target, counts) > 0
    answers = sorted(answers, key=lambda a: a["range"])

    def of_document(x):
        codes, _ = pd.factorize(doc.astype(np.int64) << 32 | x)
        return np.bincount(codes)[codes] if len(codes) else codes

    mine = [of_document(x) for x in places]
    out = []
    for c, total, counted in (("in_all", totals[0], np.ones(len(doc), dtype=bool)), ("in_target", totals[1], own)):
        counts_of = np.zeros(len(keys), dtype=np.int64)
        if answers:
            counts_of[order] = np.concatenate([_unpack(a[c], a["n"]) for a in answers])
        w, h, p = (counts_of[x] - np.where(counted, m, 0) for x, m in zip(places, mine, strict=True))
        in_all = total - np.where(counted, np.repeat(counts, counts), 0)
        single = (w + 0.5) / (in_all + 0.5 * vocabulary)
        loss = -np.log((p + PRIOR * single) / (h + PRIOR))
        out.append(np.bincount(doc, weights=loss, minlength=len(counts)) / np.maximum(counts, 1))
    return out[0], out[1], counts


def score(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, target_loss, background_loss, score (their difference). target: the ids whose texts are
    the target corpus; all documents are the background. A null or empty text has no tokens and 0 everywhere.
    Repeated rows count as often as they stand; without a target all texts are far from it alike."""
    spark = docs.sparkSession
    ids = cut(target.select(F.col(id_col).alias("tid")).where("tid is not null").distinct(), "lm-target")
    slim = docs.select(docs[id_col].alias("id"), docs[text_col].alias("t"))
    # The ids grow with the corpus, so they are never broadcast; rows without an id can't be the target's and don't meet.
    known = slim.where("id is not null").join(ids.hint("merge"), F.col("id") == F.col("tid"), "left")
    slim = known.select("id", "t", F.col("tid").isNotNull().alias("target")).union(slim.where("id is null").select("id", "t", F.lit(False)))
    kind = dict(slim.dtypes)["id"]
    schema = f"chunk long, ids array<{kind}>, docs long, words long, tokens long, target_tokens long, counts binary, target binary, vocabulary binary, codes binary"
    chunks = cut(slim.mapInArrow(_chunks, schema), "lm-chunks")
    sums = chunks.agg(F.sum("tokens"), F.sum("target_tokens")).first()
    totals = (sums[0] or 0, sums[1] or 0)
    bits = max(LEAST_BITS, math.ceil(math.log2(max(1, totals[0] / RANGE))))
    asked = chunks.drop("ids").mapInArrow(_ask(bits), "range int, chunk long, n long, keys binary, in_all binary, in_target binary")
    answers = cut(asked.groupBy("range").applyInArrow(_answer, "range int, chunk long, n long, new_words long, in_all binary, in_target binary"), "lm-answers")
    discard(ids)
    vocabulary = max(WORD_SLOTS, answers.agg(F.sum("new_words")).first()[0] or 0)

    def run(chunk, answered):
        import pyarrow as pa

        row = chunk.drop_columns(["ids"]).to_pylist()[0]
        background, wanted, counts = losses(row, answered.to_pylist(), totals, vocabulary)
        found = chunk.column("ids").combine_chunks().flatten()
        return pa.Table.from_arrays([found, *map(pa.array, (counts, wanted, background, wanted - background))], ["id", "n_tokens", "target_loss", "background_loss", "score"])

    out = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk"))
    return out.applyInArrow(run, f"id {kind}, n_tokens long, target_loss double, background_loss double, score double").withColumnRenamed("id", id_col)


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: n_tokens, target_loss, background_loss, score; the target are the documents of good quality."""
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return score(table(spark, sf_dir, "documents"), good)
