"""Exact substring dedup with a sparse suffix array that is sorted by bucket-pointer refinement.

Every byte covered by a LENGTH-byte string that also starts earlier (in a smaller document, or earlier in the
same one) is removed; strings are judged on the input. How all suffixes of a corpus are compared without
shuffling all of them:

1. Anchors. The anchor of a string is the place of its least 24-gram hash, the leftmost of equals: equal
   strings have equal anchors at equal places. Neighbouring strings share an anchor, about 39 of them, so a
   document has one row for each run of strings: hash of the anchor's 24-gram, hash of the run's whole bytes.
2. A range sort on (24-gram, run, document, place) shows each run that stood before: all of its strings are
   repeats. The first of its kind is contested if its 24-gram has other runs, which may share some of its
   strings; else it is unique. Ranges may split a hot 24-gram anywhere: what stands at an end is contested.
3. Contested runs get their bytes and are sorted by bucket-pointer refinement, 24-gram by 24-gram: initial
   buckets by 32-gram, each refined by sorting on the bucket numbers of the places 32 and then 36 further on,
   the numbers of one round being the keys of the next. Buckets of one place are final and leave the sort.
   After the rounds a bucket is the strings of LENGTH equal bytes; all but its first are repeats.
4. A hot 24-gram is refined in blocks, whose buckets are then merged by a hash of their string with a
   map-side minimum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import cut, discard, mix64, pieces, table

LENGTH, GRAM = 100, 24
#: Grams of a string, runs of one 24-gram that are refined together.
WINDOW, BLOCK = LENGTH - GRAM + 1, 4096
_B = 0x9E3779B97F4A7C15
_B_INVERSE = pow(_B, -1, 1 << 64)


def _powers(base: int, n: int, known={}):  # noqa: B006  the tables grow once a worker
    import numpy as np

    have = known.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 12)
        with np.errstate(over="ignore"):
            have = np.full(size, base, dtype=np.uint64)
            have[0] = 1
            have = np.multiply.accumulate(have)
        known[base] = have
    return have[:n]


def eight_grams(u):
    """The 8 bytes from each place on, as a number."""
    import numpy as np

    w = u.astype(np.uint64)
    for k in (1, 2, 4):
        w = w[:-k] | (w[k:] << np.uint64(8 * k))
    return w


def runs(data: bytes):
    """(24-gram hash, run hash, place) arrays of a document's runs of strings; a place packs the first
    string's start, the number of strings less 1 and the last string's distance to the anchor."""
    import numpy as np

    n = len(data)
    if n < LENGTH:
        return (np.zeros(0, dtype=np.int64),) * 3
    with np.errstate(over="ignore"):
        v = mix64(eight_grams(np.frombuffer(data, dtype=np.uint8)))
        m = n - GRAM + 1
        gram = v[:m]
        for k in range(8, GRAM, 8):
            gram = mix64(gram * np.uint64(0x100000001B3) + v[k : k + m])
        # The least hash of each window with its place in the low bits, by doubling.
        bits = max(1, int(len(gram)).bit_length())
        least = ((gram >> np.uint64(bits)) << np.uint64(bits)) | np.arange(len(gram), dtype=np.uint64)
        size = 1
        while size * 2 <= WINDOW:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < WINDOW:
            least = np.minimum(least[: len(least) - (WINDOW - size)], least[WINDOW - size :])
        anchor = (least & np.uint64((1 << bits) - 1)).astype(np.int64)
        start = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        stop = np.append(start[1:], len(anchor))  # strings start[i] .. stop[i] - 1
        a, span = anchor[start], stop - start
        # Hash of the run's bytes: its 8-grams' numbers, weighed by their places within it.
        total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(v * _powers(_B, len(v)), dtype=np.uint64)])
        body = (total[stop - 1 + LENGTH - 7] - total[start]) * _powers(_B_INVERSE, len(v) + 1)[start]
        nearest = a - (stop - 1)
        run = mix64(body ^ mix64((span.astype(np.uint64) << np.uint64(8)) | nearest.astype(np.uint64)))
    return gram[a].view(np.int64), run.view(np.int64), (start << 16) | ((span - 1) << 8) | nearest


def _anchors(batches):
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for part in pieces(batch, "t", 2 << 20):
            found = [runs((t or "").encode("utf-8", "surrogatepass")) for t in part.column("t").to_pylist()]
            sizes = np.fromiter((len(x[0]) for x in found), dtype=np.int64, count=len(found))
            doc, th = (np.repeat(part.column(c).to_numpy(zero_copy_only=False), sizes) for c in ("doc", "th"))
            columns = [np.concatenate([x[k] for x in found]) if found else np.zeros(0, dtype=np.int64) for k in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*columns[:2], doc, th, columns[2])], ["gram", "run", "doc", "th", "at"])


def _seen_before(batches):
    """Sorted runs of a range: those that stood before (contested false), and the contested firsts."""
    import numpy as np
    import pyarrow as pa

    def rows(contested, *columns):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), contested)), *map(pa.array, columns)], ["contested", "gram", "doc", "th", "at"])

    last, held, open_group = None, None, True  # the first 24-gram of a range is contested as it may go on before it
    for batch in batches:
        if not batch.num_rows:
            continue
        gram, run, doc, th, at = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        same = np.zeros(len(gram), dtype=bool)
        same[1:] = (gram[1:] == gram[:-1]) & (run[1:] == run[:-1])
        goes_on = last is not None and last[0] == gram[0]
        same[0] = goes_on and last[1] == run[0]
        if same.any():
            yield rows(False, gram[same], doc[same], th[same], at[same])
        last = (gram[-1], run[-1])
        first = ~same
        if held is not None and not goes_on:
            held = None  # a 24-gram with one run only
        if not goes_on and open_group is not True:
            open_group = False
        gram, doc, th, at = gram[first], doc[first], th[first], at[first]
        if not len(gram):
            continue
        starts = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
        sizes = np.diff(np.append(starts, len(gram)))
        contested = np.repeat(sizes > 1, sizes)
        if goes_on or open_group:
            contested[: sizes[0]] = True
            if held is not None:
                yield rows(True, *held)
                held = None
        is_open = goes_on or open_group
        if len(starts) > 1 or not is_open:
            # The last 24-gram of the batch may go on in the next one.
            i = starts[-1]
            if sizes[-1] == 1:
                held, contested[i] = (gram[i:], doc[i:], th[i:], at[i:]), False
                open_group = False
            else:
                open_group = "more"
        if contested.any():
            yield rows(True, gram[contested], doc[contested], th[contested], at[contested])
    if held is not None:
        yield rows(True, *held)


def _segments(batches):
    """The bytes of a document's contested runs."""
    import pyarrow as pa

    for batch in batches:
        for part in pieces(batch, "t", 1 << 20):
            columns: list[list] = [[], [], [], [], [], []]
            for t, doc, th, wanted in zip(*(part.column(c).to_pylist() for c in ("t", "doc", "th", "wanted")), strict=True):
                data = t.encode("utf-8", "surrogatepass")
                for w in wanted:
                    start, more = w["at"] >> 16, (w["at"] >> 8) & 255
                    for c, x in zip(columns, (w["gram"], w["salt"], doc, th, start, data[start : start + more + LENGTH]), strict=True):
                        c.append(x)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            for i in range(0, len(columns[0]), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 20_000], k) for c, k in zip(columns, kinds, strict=True)], ["gram", "salt", "doc", "th", "start", "bytes"])


def refine(text, ends):
    """(places, numbers): the places of text whose string of LENGTH bytes stands there twice or more, and the
    numbers of their buckets; equal numbers are equal strings. ends[place] is where the place's segment ends,
    over which no string goes. Bucket-pointer refinement: the initial buckets are those of the Q-grams, each is
    refined by sorting on the bucket numbers of a later offset, and the numbers so found are the next round's
    keys. A place alone in its bucket is final, as are those whose later place is."""
    import numpy as np

    q, n = 32, len(text)
    bucket = np.full(n, -1, dtype=np.int64)
    if n < LENGTH:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def buckets_of(places, keys):
        """Numbers the keys that are there twice or more, in their order; gives their places and how many."""
        order = np.argsort(keys)
        keys = keys[order]
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        starts = np.flatnonzero(new)
        shared = np.diff(np.append(starts, len(keys))) > 1
        of = np.cumsum(new) - 1
        kept = shared[of]
        places, number = places[order[kept]], (np.cumsum(shared) - 1)[of[kept]]
        bucket.fill(-1)
        bucket[places] = number
        return places, int(shared.sum())

    v = mix64(eight_grams(text))
    m = n - q + 1
    gram = v[:m]
    with np.errstate(over="ignore"):
        for k in range(8, q, 8):
            gram = mix64(gram * np.uint64(0x100000001B3) + v[k : k + m])
    places = np.flatnonzero(np.arange(m) + q <= ends[:m])
    places, many = buckets_of(places, gram[places])
    depth = q
    while depth < LENGTH and len(places):
        step = min(depth, LENGTH - depth)
        places = places[places + depth + step <= ends[places]]
        later = bucket[places + step]
        places, later = places[later >= 0], later[later >= 0]
        if len(places):
            places, many = buckets_of(places, bucket[places] * many + later)
        depth += step
    return places, bucket[places]


def _refined(pdf):
    """Repeats among whole groups of runs, and for salted groups the first of every string with its hash."""
    import numpy as np
    import pyarrow as pa
    import xxhash

    data = pdf.column("bytes").to_pylist()
    sizes = np.fromiter(map(len, data), dtype=np.int64, count=len(data))
    doc, th, start, salt = (pdf.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "th", "start", "salt"))
    text, stops = np.frombuffer(b"".join(data), dtype=np.uint8), np.cumsum(sizes)
    owner = np.repeat(np.arange(len(data)), sizes)
    places, number = refine(text, stops[owner])
    # Equal strings stand at equal distances from their anchors, so the order of runs is that of the strings.
    rank = np.empty(len(data), dtype=np.int64)
    rank[np.lexsort((start, th, doc))] = np.arange(len(data))
    order = np.argsort(number * len(data) + rank[owner[places]])
    places, number = places[order], number[order]
    first = np.concatenate([[True], number[1:] != number[:-1]]) if len(number) else np.zeros(0, dtype=bool)
    gone = np.sort(places[~first])
    own = owner[gone]
    new = np.concatenate([[True], (gone[1:] != gone[:-1] + 1) | (own[1:] != own[:-1])]) if len(gone) else np.zeros(0, dtype=bool)
    cuts = np.flatnonzero(new)
    counts = np.diff(np.append(cuts, len(gone)))
    begin = lambda x: start[owner[x]] + (x - (stops - sizes)[owner[x]])
    at, none = gone[cuts], np.zeros(len(cuts), dtype=np.int64)
    out = [(none, none, doc[owner[at]], th[owner[at]], begin(at), counts, none.astype(bool))]
    if (salt >= 0).any():
        lead = np.flatnonzero((np.arange(len(text)) + LENGTH <= stops[owner]) & (salt[owner] >= 0))
        lead = np.setdiff1d(lead, gone, assume_unique=True)
        raw = text.tobytes()
        digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(raw[p : p + LENGTH]) for p in lead.tolist()), dtype=np.int64).reshape(-1, 2)
        out.append((digests[:, 0], digests[:, 1], doc[owner[lead]], th[owner[lead]], begin(lead), np.ones(len(lead), dtype=np.int64), np.ones(len(lead), dtype=bool)))
    for columns in out:
        if len(columns[0]):
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], ["c1", "c2", "doc", "th", "start", "count", "bucket"])


def _sorted_groups(batches):
    """Refines whole groups: what a batch holds of its last group waits for the next one."""
    import numpy as np
    import pyarrow as pa

    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches(([rest] if rest is not None else []) + [batch]).combine_chunks().to_batches()[0]
        gram, salt = (t.column(c).to_numpy(zero_copy_only=False) for c in ("gram", "salt"))
        changes = np.flatnonzero((gram[1:] != gram[:-1]) | (salt[1:] != salt[:-1]))
        last = int(changes[-1]) + 1 if len(changes) else 0
        if last:
            yield from _refined(t.slice(0, last))
        rest = t.slice(last)
    if rest is not None and rest.num_rows:
        yield from _refined(rest)


def _removed(batches):
    """What is left of each document without its ranges of repeated strings."""
    import hashlib

    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for part in pieces(batch, "t", 2 << 20):
            out: list[list] = [[], [], [], []]
            for t, spans in zip(part.column("t").to_pylist(), part.column("spans").to_pylist(), strict=True):
                data, removed, n_spans = (t or "").encode("utf-8", "surrogatepass"), 0, 0
                kept = data
                if spans:
                    pairs = np.array([(s["start"], s["start"] + s["count"] - 1 + LENGTH) for s in spans], dtype=np.int64)
                    edge = np.zeros(len(data) + 1, dtype=np.int64)
                    np.add.at(edge, pairs[:, 0], 1)
                    np.add.at(edge, pairs[:, 1], -1)
                    gone = np.cumsum(edge)[:-1] > 0
                    removed, n_spans = int(gone.sum()), int((gone & ~np.concatenate([[False], gone[:-1]])).sum())
                    kept = np.frombuffer(data, dtype=np.uint8)[~gone].tobytes()
                for c, x in zip(out, (len(data), removed, n_spans, hashlib.sha256(kept).hexdigest()), strict=True):
                    c.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([part.column("row"), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], ["row", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_strings(slim: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(doc, th, start, count): the count strings of LENGTH bytes from start on in document (doc, th) also start
    earlier; and the tables that this reads. slim has doc, th (together a document) and t."""
    spark = slim.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = cut(slim.mapInArrow(_anchors, "gram long, run long, doc long, th long, at long"), "suffix-runs")
    order = ["gram", "run", "doc", "th", "at"]
    kind = "contested boolean, gram long, doc long, th long, at long"
    judged = cut(found.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_seen_before, kind), "suffix-judged")
    whole = judged.where("not contested").selectExpr("doc", "th", "shiftright(at, 16) as start", "(shiftright(at, 8) & 255) + 1 as count")

    discard(found)
    contested = judged.where("contested").select("gram", "doc", "th", "at")
    hot = cut(judged.where("contested").groupBy("gram").count().where(F.col("count") > BLOCK).selectExpr("gram", f"cast(ceil(count / {BLOCK}) as int) as blocks"), "suffix-hot")
    salted = contested.join(hot, "gram", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("doc", "th", "at"), F.col("blocks")), F.lit(-1)).cast("int"))
    wanted = cut(salted.groupBy("doc", "th").agg(F.collect_set(F.struct("gram", "salt", "at")).alias("wanted")), "suffix-wanted")
    texts = slim.join(wanted, ["doc", "th"]).select("t", "doc", "th", "wanted")
    segments = texts.mapInArrow(_segments, "gram long, salt int, doc long, th long, start long, bytes binary")
    groups = segments.repartition(parts, "gram", "salt").sortWithinPartitions("gram", "salt")
    refined = cut(groups.mapInArrow(_sorted_groups, "c1 long, c2 long, doc long, th long, start long, count long, bucket boolean"), "suffix-refined")
    discard(hot)
    discard(wanted)
    buckets = refined.where("bucket")
    firsts = buckets.groupBy("c1", "c2").agg(F.min(F.struct("doc", "th", "start")).alias("first"))
    late = buckets.join(firsts, ["c1", "c2"]).where("first < struct(doc, th, start)").select("doc", "th", "start", "count")
    return whole.union(refined.where("not bucket").select("doc", "th", "start", "count")).union(late), [judged, refined]


def dedup_strings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns of docs (or of carry) in the struct `row`, n_bytes, n_removed, n_spans and kept_sha256.

    Documents are ordered by id, a null id before all others; rows with equal ids and texts are one document
    and get equal results, rows with equal ids and other texts are ordered by a hash of the text. A null text
    is empty, texts under LENGTH bytes lose nothing, an empty table gives an empty one. Further columns, whatever
    their names, stay inside `row`."""
    row = F.struct(*[docs[c] for c in carry] if carry else ["*"]).alias("row")
    least = F.lit(-(1 << 63)).cast("long")
    ids = docs.select(F.coalesce(docs[id_col].cast("long"), least).alias("doc"))
    twice = ids.groupBy("doc").count().where("count > 1").limit(1).count() > 0
    th = F.xxhash64(docs[text_col]) if twice else F.lit(0).cast("long")
    base = docs.select(row, F.coalesce(docs[id_col].cast("long"), least).alias("doc"), th.alias("th"), docs[text_col].alias("t"))
    slim = base.where(F.octet_length("t") >= LENGTH).select("doc", "th", "t")
    if twice:
        slim = slim.dropDuplicates(["doc", "th"])
    strings, made = repeated_strings(slim)
    spans = strings.groupBy("doc", "th").agg(F.collect_list(F.struct("start", "count")).alias("spans"))
    spans = cut(spans, "suffix-spans")
    for done in made:
        discard(done)
    joined = base.join(spans, ["doc", "th"], "left").select("row", "t", "spans")
    kind = joined.schema["row"].dataType.simpleString()
    return joined.mapInArrow(_removed, f"row {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: n_bytes, n_removed, n_spans, kept_sha256."""
    out = dedup_strings(table(spark, sf_dir, "documents").select("doc_id", "text"), carry=["doc_id"])
    return out.select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
