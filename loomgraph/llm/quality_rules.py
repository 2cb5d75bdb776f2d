"""Quality rules by repetition coverage: rolling hashes of several n-gram lengths in numpy, measuring the
characters inside repeated n-grams and lines.

One pass over the text in Arrow batches, no shuffle: a document is judged on its own. Within a slice of a
few MB, words get exact codes, codes get random 64-bit numbers, and the hash of every n-gram window rolls
from that of the (n-1)-gram. A window is a repeat if its hash was seen earlier in the same document; the
share of a document's word characters that lie inside repeats is its coverage at n.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm.common import WORD, mix64, pieces, table, word_codes, words_of

#: The largest share of word characters inside repeats that passes, by n-gram length (whitespace words).
LIMITS = {3: 0.35, 5: 0.25, 7: 0.22, 10: 0.20}
#: The same for lines that equal an earlier line of the document.
LINE_LIMIT = 0.30
SYMBOLS = "#*$%&|<>"
_COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, dup_line_share double"


def measure(texts: list[str | None], lengths: tuple[int, ...]):
    """Columns of numpy arrays, one value a text."""
    import numpy as np
    import pandas as pd

    flat, counts = words_of(texts)
    n_docs, n = len(texts), len(flat)
    sizes = np.fromiter(map(len, flat), dtype=np.int64, count=n)
    doc = np.repeat(np.arange(n_docs), counts)
    per_doc = lambda x: np.bincount(doc, weights=x, minlength=n_docs)
    word_chars = per_doc(sizes).astype(np.int64)
    out = {
        "n_words": counts,
        "word_chars": word_chars,
        "n_symbols": np.array([sum(map(t.count, SYMBOLS)) if t else 0 for t in texts], dtype=np.int64),
    }
    dup_lines, dup_chars = np.zeros(n_docs, dtype=np.int64), np.zeros(n_docs, dtype=np.int64)
    for i, t in enumerate(texts):
        if t and "\n" in t:
            lines = pd.Series([x for x in t.split("\n") if WORD.search(x)], dtype=object)
            if again := list(lines[lines.duplicated()]):
                dup_lines[i] = len(again)
                dup_chars[i] = sum(len(w) for w in words_of(again)[0])
    out |= {"n_dup_lines": dup_lines, "dup_line_share": dup_chars / np.maximum(word_chars, 1)}

    token = mix64(word_codes(flat)[0].astype(np.uint64)) if n else np.zeros(0, dtype=np.uint64)
    salt = mix64(np.arange(n_docs, dtype=np.uint64) + np.uint64(1 << 40))[doc]
    base, rolling = np.uint64(0x9E3779B97F4A7C15), np.zeros(n, dtype=np.uint64)
    longest = max(lengths)
    with np.errstate(over="ignore"):
        for k in range(1, longest + 1):
            m = n - k + 1
            if m > 0:
                rolling = rolling[:m] * base + token[k - 1 :]
            if k not in lengths:
                continue
            mask_any, mask_later = np.zeros(n + 1, dtype=np.int64), np.zeros(n + 1, dtype=np.int64)
            if m > 0 and (at := np.flatnonzero(doc[:m] == doc[k - 1 :])).size:
                codes, _ = pd.factorize(rolling[at] ^ salt[at])
                first = np.full(codes.max() + 1, -1, dtype=np.int64)
                first[codes[::-1]] = np.arange(len(codes))[::-1]
                later = first[codes] != np.arange(len(codes))
                often = np.bincount(codes)[codes] > 1
                for mask, hit in ((mask_any, at[often]), (mask_later, at[later])):
                    mask += np.bincount(hit, minlength=n + 1) - np.bincount(hit + k, minlength=n + 1)
            inside = lambda mask: np.cumsum(mask)[:n] > 0
            if k == 3:
                out["n_repeat_words"] = per_doc(inside(mask_any)).astype(np.int64)
            out[f"coverage_{k}"] = per_doc(sizes * inside(mask_later)) / np.maximum(word_chars, 1)
    return out


def judge(docs: DataFrame, text_col: str = "text", limits: dict[int, float] | None = None, line_limit: float = LINE_LIMIT, carry: list[str] | None = None) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, dup_line_share, one coverage_<n>
    for each n-gram length, base_failed and kept; the given columns (those of
    carry, if given) are in the struct `row`.

    base_failed: under 50 words, or more than half of them inside 3-word windows that occur twice or more.
    kept: not base_failed, and no coverage is over its limit. A null or empty text has no words, and fails.
    Repeated rows are judged alike; an empty table gives an empty one; a text of any length is read whole."""
    from pyspark.sql import functions as F

    limits = LIMITS if limits is None else limits
    lengths = tuple(sorted({3, *limits}))
    packed = docs.select(F.struct(*[docs[c] for c in carry] if carry else ["*"]).alias("row"), docs[text_col].alias("t"))
    fields = f"{_COLUMNS}, " + ", ".join(f"coverage_{k} double" for k in lengths)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in pieces(batch, "t", 2 << 20):
                got = measure(part.column("t").to_pylist(), lengths)
                yield pa.RecordBatch.from_arrays([part.column("row"), *map(pa.array, (got[f.split()[0]] for f in fields.split(", ")))], ["row", *(f.split()[0] for f in fields.split(", "))])

    out = packed.mapInArrow(run, f"row {packed.schema['row'].dataType.simpleString()}, {fields}")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    fine = F.col("dup_line_share") <= line_limit
    for k, most in limits.items():
        fine = fine & (F.col(f"coverage_{k}") <= most)
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & fine)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its words, the base measures, base_failed and kept, with the coverages."""
    out = judge(table(spark, sf_dir, "documents").select("doc_id", "text"), carry=["doc_id"])
    return out.select("row.doc_id", *[c for c in out.columns if c != "row"])


def _sql() -> str:
    """The same by windows over words: a gram is a repeat if the document has had it before."""
    grams, joins = [], []
    for k in LIMITS:
        grams.append(f"""
g{k} AS (SELECT doc_id, i, array_to_string(ws[i:i + {k - 1}], ' ') AS g FROM words WHERE i + {k - 1} <= n_words),
r{k} AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id, g ORDER BY i) > 1 AS again, count(*) OVER (PARTITION BY doc_id, g) > 1 AS often FROM g{k}),
p{k} AS (
  SELECT words.doc_id, length(ws[words.i]) AS size, coalesce(bool_or(again) OVER near, false) AS inside, coalesce(bool_or(often) OVER near, false) AS any_inside
  FROM words LEFT JOIN r{k} ON words.doc_id = r{k}.doc_id AND words.i = r{k}.i
  WINDOW near AS (PARTITION BY words.doc_id ORDER BY words.i ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)),
c{k} AS (SELECT doc_id, sum(size) FILTER (WHERE inside) AS chars, count(*) FILTER (WHERE any_inside) AS repeat_words FROM p{k} GROUP BY doc_id)""")
        joins.append(f"LEFT JOIN c{k} USING (doc_id)")
    shares = ", ".join(f"coalesce(c{k}.chars, 0) / greatest(word_chars, 1)::DOUBLE AS coverage_{k}" for k in LIMITS)
    fine = " AND ".join(f"coverage_{k} <= {most}" for k, most in LIMITS.items())
    word = r"[^\x20\x09-\x0D]+"
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{word}') AS ws FROM documents),
base AS (
  SELECT doc_id, ws, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols FROM texts),
words AS (SELECT doc_id, ws, n_words, unnest(range(1, n_words + 1)) AS i FROM base),
split AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS pos FROM texts),
lines AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) > 1 AS again FROM split WHERE regexp_matches(line, '{word}')),
dups AS (
  SELECT doc_id, count(*) AS n_dup_lines, sum(length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g'))) AS dup_chars FROM lines WHERE again GROUP BY doc_id),
{",".join(grams)},
judged AS (
  SELECT doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(c3.repeat_words, 0) AS n_repeat_words,
         coalesce(dup_chars, 0) / greatest(word_chars, 1)::DOUBLE AS dup_line_share, {shares}
  FROM base LEFT JOIN dups USING (doc_id) {" ".join(joins)})
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND dup_line_share <= {LINE_LIMIT} AND {fine} AS kept
FROM judged
"""


OP3_SQL = _sql()


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules keep."""
    return judge(docs).where("kept").select("row.*")
