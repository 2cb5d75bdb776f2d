"""Benchmark decontamination by SimHash of item-sized windows.

A window of a document has as many words as a benchmark item. Its fingerprint is a 256-bit SimHash of its
weighted word 5-shingles, worked out for all windows of a length by running sums. A multi-index over 16 blocks of
16 bits finds every item of that length within a Hamming distance of 63: of 63 differing bits, one of 16 blocks
has 3 at most, so an index of all values within 1 bit of an item's block is looked up at all values within 2 bits
of the window's. The pairs found are verified by the exact weighted similarity: sum of least over sum of greatest
shingle counts, 0.8 or more.

A window that is 0.8 similar to an item has 0.8 of the item's shingles, in any order. So windows are opened at
every place where that many shingles that items of the length have stand within one window, which loses nothing
and leaves nearly all of the text at one look-up a word. One pass over the documents in Arrow batches, no shuffle.
The benchmark is a stated query set: its items go to the tasks in blocks of bounded bytes, one pass a block, of
which the driver holds one at a time.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import cut, mix64, pieces, table, word_codes, words_of

SHINGLE, SIMILARITY = 5, 0.8
BITS, BLOCKS, RADIUS = 256, 16, 63
#: Bits in which an index entry and a look-up may differ from a block: together RADIUS // BLOCKS.
STORED, PROBED = 1, 2
#: Bytes of benchmark text that one pass takes; numbers that running sums of fingerprints may hold at once.
BLOCK_BYTES, CELLS = 4 << 20, 1 << 22
HITS = "array<struct<item_id:bigint,similarity:double,first_word:bigint,n_words:bigint>>"


def normal(word: str) -> str:
    """Lower case, without what isn't a letter or digit at either end."""
    if word.isalnum():
        return word.lower()
    start, end = 0, len(word)
    while start < end and not word[start].isalnum():
        start += 1
    while end > start and not word[end - 1].isalnum():
        end -= 1
    return word[start:end].lower()


def shingle_hashes(ids):
    """A hash of each run of SHINGLE ids (uint64); of all of them, if they are fewer."""
    import numpy as np

    width = min(SHINGLE, len(ids))
    h = np.full(len(ids) - width + 1 if width else 0, width, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(width):
            h = mix64(h * np.uint64(0x100000001B3) + ids[j : j + len(h)].astype(np.uint64))
    return h


def signs(hashes):
    """BITS numbers of 1 or -1 for each shingle."""
    import numpy as np

    words = np.stack([mix64(hashes ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) % 2**64)) for k in range(BITS // 64)], axis=1)
    return 2 * np.unpackbits(np.ascontiguousarray(words).view(np.uint8).reshape(len(hashes), -1), axis=1).astype(np.int32) - 1


def fingerprints(hashes, starts, ends):
    """The SimHash of the shingles [start, end) of each window, packed in bytes. A repeated shingle counts as often
    as it stands; a sum of 0 is a 0 bit."""
    import numpy as np

    sums = np.zeros((len(hashes) + 1, BITS), dtype=np.int32)
    np.cumsum(signs(hashes), axis=0, out=sums[1:])
    return np.packbits(sums[ends] > sums[starts], axis=1)


def within(width: int, bits: int):
    """All masks of up to `bits` of `width` bits."""
    import itertools

    import numpy as np

    return np.array([sum(1 << k for k in at) for n in range(bits + 1) for at in itertools.combinations(range(width), n)], dtype=np.uint16)


class MultiIndex:
    """Fingerprints (rows of bytes), found by any other within RADIUS bits."""

    def __init__(self, prints):
        import numpy as np

        self.prints = prints
        masks = within(BITS // BLOCKS, STORED)
        self.blocks = []
        for block in prints.view(np.uint16).T:
            values = (block[:, None] ^ masks[None, :]).ravel()
            order = np.argsort(values, kind="stable")
            self.blocks.append((values[order], (order // len(masks)).astype(np.int32)))

    def near(self, prints):
        """(row of prints, row of the index) of all pairs within RADIUS bits, each once."""
        import numpy as np

        masks = within(BITS // BLOCKS, PROBED)
        found = [np.zeros(0, dtype=np.int64)]
        for (values, items), block in zip(self.blocks, prints.view(np.uint16).T, strict=True):
            probes = (block[:, None] ^ masks[None, :]).ravel()
            low, high = np.searchsorted(values, probes, "left"), np.searchsorted(values, probes, "right")
            hit = np.flatnonzero(high > low)
            n = (high - low)[hit]
            at = np.repeat(low[hit] - np.cumsum(n) + n, n) + np.arange(n.sum())
            found.append(np.unique(np.repeat(hit // len(masks), n) * len(self.prints) + items[at]))
        pairs = np.unique(np.concatenate(found))
        x, y = pairs // len(self.prints), pairs % len(self.prints)
        fine = np.bitwise_count(prints[x] ^ self.prints[y]).sum(axis=1, dtype=np.int64) <= RADIUS
        return x[fine], y[fine]


class Benchmark:
    """Items by their number of words, each with its shingles and the multi-index of the fingerprints of a length. An
    item of under SHINGLE words has one shingle, the whole of it, and is only looked for as a document of its
    own, as so few words stand in many clean texts. Null items and those without a word have none."""

    def __init__(self, items: list[tuple[int, str | None]]):
        import numpy as np

        self.words: dict[str, int] = {}
        self.items: dict[int, list] = defaultdict(list)  # by length: (item id, distinct shingles, their counts)
        self.short: dict[tuple[str, ...], list[int]] = defaultdict(list)
        prints, lengths_of = defaultdict(list), defaultdict(set)
        for item_id, text in items:
            own = [w for w in map(normal, words_of([text])[0]) if w]
            if len(own) < SHINGLE:
                if own:
                    self.short[tuple(own)].append(item_id)
                continue
            h = shingle_hashes(np.array([self.words.setdefault(w, len(self.words)) for w in own]))
            self.items[len(own)].append((item_id, *np.unique(h, return_counts=True)))
            prints[len(own)].append(fingerprints(h, np.array([0]), np.array([len(h)])))
            for x in set(h.tolist()):
                lengths_of[x].add(len(own))
        self.index = {n: MultiIndex(np.concatenate(x)) for n, x in prints.items()}
        self.hashes = np.array(sorted(lengths_of), dtype=np.uint64)
        self.lengths_of = [sorted(lengths_of[x]) for x in self.hashes.tolist()]

    def windows(self, places, length: int, n: int):
        """(start, end) in shingles of the windows of that many words, of a text of n shingles, that may be similar to an
        item: SIMILARITY of an item's shingles must stand in one, among the places where such shingles stand. A
        window may reach over the ends of the text."""
        import numpy as np

        m = length - SHINGLE + 1
        need = int(np.ceil(SIMILARITY * m - 1e-9))
        if len(places) < need:
            return (np.zeros(0, dtype=np.int64),) * 2
        low, high = places[need - 1 :] - m + 1, places[: len(places) - need + 1]
        fine = low <= high
        low, high = low[fine], high[fine]
        if not len(low):
            return (np.zeros(0, dtype=np.int64),) * 2
        low[1:] = np.maximum(low[1:], np.maximum.accumulate(high)[:-1] + 1)
        sizes = np.maximum(high - low + 1, 0)
        starts = np.repeat(low - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        both = np.unique(np.stack([np.maximum(starts, 0), np.minimum(starts + m, n)], axis=1), axis=0)
        return both[:, 0], both[:, 1]

    def found(self, h, places, length: int):
        """(item id, similarity, first shingle, shingles) of the best window of each item of that length in a text with
        the shingles h; of equal ones the first."""
        import numpy as np

        starts, ends = self.windows(places, length, len(h))
        best: dict[int, tuple] = {}
        at = 0
        while at < len(starts):  # as many windows at once as running sums of bounded size reach
            stop = max(at + 1, int(np.searchsorted(ends, starts[at] + CELLS // BITS)))
            s, e, first = starts[at:stop], ends[at:stop], starts[at]
            w, k = self.index[length].near(fingerprints(h[first : e[-1]], s - first, e - first))
            for x, y in zip(w.tolist(), k.tolist(), strict=True):
                _, theirs, weights = self.items[length][y]
                seen, often = np.unique(h[s[x] : e[x]], return_counts=True)
                _, i, j = np.intersect1d(seen, theirs, assume_unique=True, return_indices=True)
                common = int(np.minimum(often[i], weights[j]).sum())
                similarity = common / (int(often.sum()) + int(weights.sum()) - common)
                if similarity >= SIMILARITY and similarity > best.get(y, (0, 0.0))[1]:
                    best[y] = (self.items[length][y][0], similarity, int(s[x]), int(e[x] - s[x]))
            at = stop
        return best.values()

    def matches(self, texts: list[str | None]):
        """For each text its matches [(item_id, similarity, first word, words)], the best window of an item."""
        import numpy as np

        out: list[list] = [[] for _ in texts]
        flat, counts = words_of(texts)
        codes, distinct = word_codes(flat)
        if not distinct:
            return out
        plain = [normal(w) for w in distinct]
        known = np.fromiter((self.words.get(w, -1) if w else -2 for w in plain), dtype=np.int64, count=len(plain))
        ids, doc = known[codes], np.repeat(np.arange(len(texts)), counts)
        there = ids > -2
        ids, doc, codes = ids[there], doc[there], codes[there]
        first = np.searchsorted(doc, np.arange(len(texts) + 1))
        if self.short:
            for d in np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < SHINGLE)).tolist():
                own = tuple(plain[c] for c in codes[first[d] : first[d + 1]])
                out[d] += [(i, 1.0, 0, len(own)) for i in sorted(self.short.get(own, ()))]
        n = len(ids) - SHINGLE + 1
        if n <= 0 or not len(self.hashes):
            return out
        # Runs of SHINGLE words that the benchmark knows, within one text.
        run = np.convolve(ids >= 0, np.ones(SHINGLE, dtype=np.int64), mode="valid") == SHINGLE
        at = np.flatnonzero(run & (doc[:n] == doc[SHINGLE - 1 :]))
        h = np.full(len(at), SHINGLE, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for j in range(SHINGLE):
                h = mix64(h * np.uint64(0x100000001B3) + ids[at + j].astype(np.uint64))
        place = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = self.hashes[place] == h
        at, place = at[hit], place[hit]
        for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(doc[at])) + 1) if len(at) else []:
            d = int(doc[at[part[0]]])
            by_length = defaultdict(list)
            for p, k in zip((at[part] - first[d]).tolist(), place[part].tolist(), strict=True):
                for length in self.lengths_of[k]:
                    by_length[length].append(p)
            own = ids[first[d] : first[d + 1]]
            # A word that the benchmark lacks stands for itself, apart from all others.
            shingles = shingle_hashes(np.where(own >= 0, own, -1 - np.arange(len(own)) - len(self.words)))
            found = [x for length in sorted(by_length) for x in self.found(shingles, np.array(by_length[length]), length)]
            out[d] += [(i, similarity, start, m + SHINGLE - 1) for i, similarity, start, m in sorted(found)]
        return out


def parts_of(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", most: int | None = None) -> list[DataFrame]:
    """The benchmark in parts of about `most` bytes, each small enough for the driver and the tasks."""
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-size // (most or BLOCK_BYTES)))
    return [items if n == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b) for b in range(n)]


def find_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns of docs (or of carry) in the struct `row`, and `hits`: an array of (item_id, similarity,
    first_word, n_words), empty for a clean document. Words are compared in lower case without punctuation
    at their ends.

    Null and wordless texts are clean; repeated rows have equal hits; equal items are each found; of windows
    equally similar to an item the first is told. An item of under 5 words is found only where it is the whole
    document. An empty benchmark finds nothing, an empty table gives an empty one. Further columns, whatever
    their names, stay inside `row`."""
    rows = docs.select(F.struct(*[docs[c] for c in carry] if carry else ["*"]).alias("row"), docs[text_col].alias("t"))
    parts = parts_of(benchmark)
    held = lambda part: Benchmark([(r["i"], r["t"]) for r in part.orderBy("i", "t").toLocalIterator()])
    if len(parts) == 1:
        kind = rows.schema["row"].dataType.simpleString()
        return rows.select(F.col("row").alias("key"), "t").mapInArrow(_pass(held(parts[0]), True), f"key {kind}, hits {HITS}").withColumnRenamed("key", "row")
    # Several passes: each writes the few texts with hits, by a hash of the text.
    key = F.struct(F.xxhash64("t").alias("h1"), F.xxhash64(F.lit(7), "t").alias("h2"))
    keyed = rows.select(key.alias("key"), "t")
    found = [cut(keyed.mapInArrow(_pass(held(part), False), f"key struct<h1:bigint,h2:bigint>, hits {HITS}").dropDuplicates(["key"]), "leaks") for part in parts]
    hits = found[0]
    for more in found[1:]:
        hits = hits.unionByName(more)
    hits = hits.groupBy("key").agg(F.flatten(F.collect_list("hits")).alias("hits"))
    out = rows.select("row", key.alias("key")).join(hits, "key", "left")
    return out.select("row", F.coalesce("hits", F.array().cast(HITS)).alias("hits"))


def _pass(benchmark: Benchmark, everything: bool):
    """(key, hits) of each row of (key, t); without `everything`, of those with hits."""

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("similarity", pa.float64()), ("first_word", pa.int64()), ("n_words", pa.int64())]))
        names = ("item_id", "similarity", "first_word", "n_words")
        for batch in batches:
            for part in pieces(batch, "t", 2 << 20):
                found = [[dict(zip(names, m, strict=True)) for m in x] for x in benchmark.matches(part.column("t").to_pylist())]
                out = pa.RecordBatch.from_arrays([part.column("key"), pa.array(found, kind)], ["key", "hits"])
                yield out if everything else out.filter(pa.array([bool(x) for x in found], pa.bool_()))

    return run


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item in it: doc_id, item_id, similarity and where."""
    out = find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    return out.select("row.doc_id", F.explode("hits").alias("m")).select("doc_id", "m.item_id", "m.similarity", "m.first_word", "m.n_words")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a benchmark item in them."""
    return find_leaks(docs, table(spark, sf_dir, "benchmark")).where(F.size("hits") == 0).select("row.*")
