"""N-gram Jaccard join by count vectors: shingles are hashed into groups, a document is the point of its group
counts, R-trees over the points bound the overlap by summed coordinate minima, and the pairs that survive are
verified on their shingles.

How a corpus gets to trees that fit a task, without losing a pair:

1. Documents with equal sets are one node (a 64-bit hash of the sorted set).
2. Two linked sets differ in at most D shingles, D following from the sizes. Shingles are dealt to D + 1
   groups and a few more, so at least one group with shingles is equal in both: each node emits one hash a group
   (for its own size class and those just below, whose members it may link with). Equal hashes are a bucket. A passage that many
   documents share makes no bucket, as its shingles mix with others in every group.
3. Buckets are found by a range sort on (hash, node), which splits a hot bucket over tasks. The node that shares
   most places with others is the pivot of a bucket, and every node goes with the foremost of its pivots if
   their count vectors allow a link. These stars join the large groups of near copies with a pair a node.
4. Of the pairs in a bucket that are in different stars, R-trees over the points keep those whose count vectors
   allow a link; a forest of them (a node less than nodes, at most) is enough to tell families.
5. Families get their shingles. Stars are verified, and what they leave apart is looked at by a family's R-tree
   (a pair of blocks at a time, if it is large): likeliest pairs first, verified there and then, and those
   that found links join already are passed over. So a family gives at most a link a node and block, however
   many of its pairs link.
6. Components of all links.

No step emits the pairs of a group, no set or link is collected, and none of the steps is bounded or sampled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import FOLD, cut, discard, mix64, pieces, table, word_codes, words_of
from loomgraph.llm.components import components

#: Least coordinates of a count vector, points in a leaf, boxes in a box above, rows of a block.
AXES, LEAF, FAN, BLOCK = 64, 16, 8, 2048
#: A vector gets four times the coordinates until no more than so many shingles come to each, on average: the
#: counts of unlike sets differ by chance as the root of their size, and what a link may differ in grows with it.
CROWD = 8
#: Shingles of a block, about.
BLOCK_SHINGLES = 1 << 21
#: Each size class reaches to so many times its start.
WIDTH = 1.25


def shingle_sets(texts: list[str | None], k: int):
    """The sorted distinct shingle hashes (uint64) of each text: k words in a row, or all if there are fewer."""
    import numpy as np
    import xxhash

    flat, counts = words_of([t.translate(FOLD) if t else t for t in texts])
    codes, distinct = word_codes(flat)
    token = np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in distinct), dtype=np.uint64, count=len(distinct))[codes]
    ends, out = np.cumsum(counts), []
    with np.errstate(over="ignore"):
        for i, n in enumerate(counts):
            own = token[ends[i] - n : ends[i]]
            if n == 0:
                out.append(own)
                continue
            width = min(k, int(n))
            h = np.full(n - width + 1, width, dtype=np.uint64)
            for j in range(width):
                h = mix64(h * np.uint64(0x100000001B3) + own[j : j + len(h)])
            out.append(np.unique(h))
    return out


class Classes:
    """Size classes and the number of groups of each, for links of 100 * overlap >= percent * union."""

    def __init__(self, percent: int):
        self.percent = percent
        self.tops = [1]
        self.known: dict[int, tuple[int, int]] = {}

    def upto(self, n: int):
        while self.tops[-1] < n:
            low = self.tops[-1] + 1
            self.tops.append(max(low, int(low * WIDTH)))

    def groups(self, c: int) -> tuple[int, int]:
        """(groups, empty ones that don't matter): with so many groups beyond those that may differ, two linked sets
        have an equal group that isn't empty, if one of them has no more empty groups than that."""
        if c not in self.known:
            top, low = self.tops[c], self.tops[c - 1] + 1 if c else 1
            differ = (top + top * 100 // self.percent) * (100 - self.percent) // (100 + self.percent)
            spare = 0
            while differ:  # three deviations over the empty groups that the smallest set of the class may expect
                g = differ + 1 + spare
                empty = g * math.exp(-low / g)
                if spare >= empty + 3 * math.sqrt(empty):
                    break
                if spare > differ:
                    break
                spare += 1
            self.known[c] = (differ + 1 + spare, spare)
        return self.known[c]

    def of(self, n: int) -> list[int]:
        """Its own class and those below with a size that may link with n."""
        import bisect

        self.upto(n)
        own = bisect.bisect_left(self.tops, n)
        least = -(-n * self.percent // 100)
        first = bisect.bisect_left(self.tops, least)
        return list(range(first, own + 1))


def bucket_keys(sets, classes: Classes):
    """One array of hashes for each set: that of every group of every class that it belongs to."""
    import numpy as np

    out = []
    with np.errstate(over="ignore"):
        for s in sets:
            if not len(s):
                out.append(np.zeros(0, dtype=np.int64))
                continue
            mixed, keys = mix64(s ^ np.uint64(0x5DEECE66D)), []
            for c in classes.of(len(s)):
                g, spare = classes.groups(c)
                at = (mixed % np.uint64(g)).astype(np.int64)
                sums = np.zeros(g, dtype=np.uint64)
                np.add.at(sums, at, s)
                own = mix64(sums ^ mix64(np.arange(g, dtype=np.uint64) + np.uint64(c << 40)))
                full = np.bincount(at, minlength=g) > 0
                keys.append(own[full] if g - int(full.sum()) <= spare else own)
            out.append(np.concatenate(keys).view(np.int64))
    return out


def _point(s):
    import numpy as np

    axes = AXES
    while axes * CROWD < len(s):
        axes *= 4
    return np.bincount((s >> np.uint64(65 - axes.bit_length())).astype(np.int64), minlength=axes).astype(np.uint32)


def node_of(s) -> int | None:
    """A hash of the set as a signed number; null if it is empty."""
    import xxhash

    return int.from_bytes(xxhash.xxh3_64_digest(s.tobytes()), "big", signed=True) if len(s) else None


def _signatures(k: int, percent: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        classes = Classes(percent)
        for batch in batches:
            for part in pieces(batch, "t", 2 << 20):
                sets = shingle_sets(part.column("t").to_pylist(), k)
                keys = bucket_keys(sets, classes)
                nodes = [node_of(s) for s in sets]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in keys])]).astype(np.int32)
                values = np.concatenate(keys) if keys else np.zeros(0, dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("th"), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.int64()), pa.array([_point(s).tobytes() for s in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))],
                    ["id", "th", "n", "node", "point", "keys"],
                )

    return run


def _bucket_rows(batches):
    """Rows (key, node), sorted, of one range: those of keys with two nodes or more in it, with the key's first
    node in the range as pivot. Keys at either end of the range may go on elsewhere: `edge` rows tell their
    pivots, for a later look over the ranges. Of buckets with the same members within a batch one is enough."""
    import numpy as np
    import pyarrow as pa

    def batch_of(k, v, p, e):
        return pa.RecordBatch.from_arrays([pa.array(k), pa.array(v), pa.array(p), pa.array(e)], ["key", "node", "pivot", "edge"])

    held = None  # (key, pivot, its row is out, last node) of the group that the next batch may go on with
    first_key, seen = None, set()
    for batch in batches:
        k, v = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        if not len(k):
            continue
        if first_key is None:
            first_key = k[0]
            yield batch_of(k[:1], v[:1], v[:1], np.ones(1, dtype=bool))
        new = np.ones(len(k), dtype=bool)
        new[1:] = (k[1:] != k[:-1]) | (v[1:] != v[:-1])
        if held is not None and k[0] == held[0] and v[0] == held[3]:
            new[0] = False
        k, v = k[new], v[new]
        if not len(k):
            continue
        starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        sizes = np.diff(np.append(starts, len(k)))
        pivot = np.repeat(v[starts], sizes)
        keep = np.repeat(sizes > 1, sizes)
        with np.errstate(over="ignore"):
            content = np.add.reduceat(mix64(v.view(np.uint64)), starts)
        # The first and the last group may be parts of larger ones; the others are whole.
        for i in np.flatnonzero(sizes[1:-1] > 1) + 1:
            if (c := int(content[i])) in seen:
                keep[starts[i] : starts[i] + sizes[i]] = False
            else:
                seen.add(c)
        if len(seen) > 500_000:
            seen.clear()
        if held is not None and k[0] == held[0]:
            own = slice(0, sizes[0])
            pivot[own], keep[own] = held[1], True
            if not held[2]:
                yield batch_of(k[:1], np.array([held[1]]), np.array([held[1]]), np.zeros(1, dtype=bool))
            out_already = True
        else:
            out_already = False
        last = starts[-1]
        held = (k[-1], pivot[last], bool(sizes[-1] > 1 or (len(starts) == 1 and out_already)), v[-1])
        if keep.any():
            yield batch_of(k[keep], v[keep], pivot[keep], np.zeros(int(keep.sum()), dtype=bool))
    if held is not None and held[0] != first_key:
        yield batch_of(np.array([held[0]]), np.array([held[1]]), np.array([held[1]]), np.ones(1, dtype=bool))


def _sets(k: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in pieces(batch, "t", 2 << 20):
                sets = shingle_sets(part.column("t").to_pylist(), k)
                # Another text under the same id isn't this node's.
                own = [(x, s) for x, s in zip(part.column("node").to_pylist(), sets, strict=True) if node_of(s) == x]
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in own], pa.int64()), pa.array([s.tobytes() for _, s in own], pa.binary())], ["node", "set"])

    return run


def _linked(percent: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            a, b = batch.column("set_a"), batch.column("set_b")
            out = np.zeros(batch.num_rows, dtype=bool)
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(c[i].as_buffer(), dtype=np.uint64) for c in (a, b))
                both = len(np.intersect1d(x, y, assume_unique=True))
                out[i] = 100 * both >= percent * (len(x) + len(y) - both)
            mask = pa.array(out)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    return run


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes that link."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("set").alias(f"set_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "set_a", "set_b").mapInArrow(_linked(percent), "a long, b long")


def slack_of(points_a, sizes_a, points_b, sizes_b, percent: int):
    """By how much the summed coordinate minima of each pair reach the overlap that a link of their sizes needs."""
    import numpy as np

    common = np.minimum(points_a, points_b).sum(axis=1, dtype=np.int64)
    return common * (100 + percent) - percent * (sizes_a + sizes_b)


def _points(blobs: list[bytes]):
    """Count vectors as a matrix. Coordinates are leading bits of hashes, so a longer vector becomes a shorter one
    by sums of neighbours; the shortest sets the length."""
    import numpy as np

    rows = [np.frombuffer(x, dtype=np.uint32) for x in blobs]
    axes = min(map(len, rows))
    return np.stack([r if len(r) == axes else r.reshape(axes, -1).sum(axis=1) for r in rows]).astype(np.int32)


def _axes(column):
    """The number of coordinates of each count vector of an Arrow column."""
    import pyarrow.compute as pc

    return pc.binary_length(column).to_numpy(zero_copy_only=False) // 4


def _allowed(percent: int):
    """The pairs (a, b) whose count vectors allow a link."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            n_a, n_b = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n_a", "n_b"))
            a, b = (batch.column(c).to_pylist() for c in ("point_a", "point_b"))
            axes = np.minimum(_axes(batch.column("point_a")), _axes(batch.column("point_b")))
            fine = np.zeros(len(axes), dtype=bool)
            for x in np.unique(axes):
                at = np.flatnonzero(axes == x)
                for part in np.array_split(at, max(1, len(at) * int(x) // (1 << 21))):
                    both = _points([a[k] for k in part] + [b[k] for k in part])
                    fine[part] = slack_of(both[: len(part)], n_a[part], both[len(part) :], n_b[part], percent) >= 0
            mask = pa.array(fine)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    return run


def _forest(a, b):
    """Mask of the pairs that join what earlier ones didn't."""
    import numpy as np

    _, back = np.unique(np.concatenate([a, b]), return_inverse=True)
    above = list(range(back.max() + 1)) if len(back) else []
    keep = np.zeros(len(a), dtype=bool)
    for i, (x, y) in enumerate(zip(back[: len(a)].tolist(), back[len(a) :].tolist(), strict=True)):
        while above[x] != x:
            above[x] = x = above[above[x]]
        while above[y] != y:
            above[y] = y = above[above[y]]
        if x != y:
            above[x] = y
            keep[i] = True
    return keep


def _bucket_forests(percent: int):
    """Rows of buckets, whole and sorted by (key, i, j): a forest of the pairs of different stars whose count vectors
    allow a link. Small buckets are looked at together, pair by pair; large ones through their trees."""

    def pairs_of(t):
        import numpy as np

        key, i, j, blk, node, n, star = (t.column(c).to_numpy(zero_copy_only=False) for c in ("key", "i", "j", "blk", "node", "n", "star"))
        blobs, own_axes = t.column("point").to_pylist(), _axes(t.column("point"))
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
        starts = np.flatnonzero(new)
        sizes, axes = np.diff(np.append(starts, len(key))), np.minimum.reduceat(own_axes, starts)
        out = [(np.zeros(0, dtype=np.int64),) * 2]
        for s, w in {(int(x), int(y)) for x, y in zip(sizes, axes, strict=True) if x > 1}:
            at = starts[(sizes == s) & (axes == w)]
            step = max(1, (1 << 21) // (s * s * w)) if s <= LEAF else 1
            for begin in range(0, len(at), step):
                heads = at[begin : begin + step]
                rows = (heads[:, None] + np.arange(s)).ravel()
                points = _points([blobs[k] for k in rows])
                if s <= LEAF:
                    x, y = (np.arange(len(heads))[:, None] * s + u for u in np.triu_indices(s, 1))
                    x, y = x.ravel(), y.ravel()
                    apart = star[rows[x]] != star[rows[y]]
                    x, y = x[apart], y[apart]
                    fine = slack_of(points[x], n[rows[x]], points[y], n[rows[y]], percent) >= 0
                    out.append((node[rows[x[fine]]], node[rows[y[fine]]]))
                    continue
                a, b = np.flatnonzero(blk[rows] == i[rows[0]]), np.flatnonzero(blk[rows] == j[rows[0]])
                if len(a) and len(b):
                    x, y, _ = tree_pairs(points[a], n[rows[a]], points[b], n[rows[b]], percent)
                    x, y = rows[a[x]], rows[b[y]]
                    apart = star[x] != star[y]
                    out.append((node[x[apart]], node[y[apart]]))
        a, b = (np.concatenate([x[k] for x in out]) for k in (0, 1))
        keep = _forest(a, b)
        return a[keep], b[keep]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches(([rest] if rest is not None else []) + [batch]).combine_chunks().to_batches()[0]
            key, i, j = (t.column(c).to_numpy(zero_copy_only=False) for c in ("key", "i", "j"))
            changes = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))
            last = int(changes[-1]) + 1 if len(changes) else 0
            if last:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in pairs_of(t.slice(0, last))], ["a", "b"])
            rest = t.slice(last)
        if rest is not None and rest.num_rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in pairs_of(rest)], ["a", "b"])

    return run


def loaded(points, sizes, percent: int):
    """R-tree over points of counts, loaded in bulk: rows are halved, by size as long as sizes alone rule out links
    and else between two points far from each other, down to leaves of LEAF; FAN neighbouring boxes are one of the
    level above, up to a root. Gives the order of the rows and the levels, leaves first: of each box the upper
    corner and the least and greatest size."""
    import numpy as np

    order, todo = np.arange(len(points)), [(0, len(points))]
    while todo:
        start, stop = todo.pop()
        if stop - start <= LEAF:
            continue
        rows = order[start:stop]
        by = sizes[rows]
        if by.min() * 100 >= by.max() * percent:
            own = points[rows]
            seed = own[np.abs(own - own[0]).sum(axis=1).argmax()]
            by = own @ (own[np.abs(own - seed).sum(axis=1).argmax()] - seed)
        order[start:stop] = rows[np.argsort(by, kind="stable")]
        half = start + math.ceil((stop - start) / LEAF) // 2 * LEAF
        todo += [(start, half), (half, stop)]
    levels, box, step = [], (points[order], sizes[order], sizes[order]), LEAF
    while True:
        cuts = np.arange(0, len(box[0]), step)
        box = tuple(f.reduceat(x, cuts) for f, x in zip((np.maximum, np.minimum, np.maximum), box, strict=True))
        levels.append(box)
        if len(box[0]) <= 1:
            return order, levels
        step = FAN


def _below(x, y, n: int):
    """The pairs (child of x, y) of boxes, where the level below that of x has n boxes."""
    import numpy as np

    x, y = (x[:, None] * FAN + np.arange(FAN)).ravel(), np.repeat(y, FAN)
    return x[x < n], y[x < n]


def may_link(boxes_a, x, boxes_b, y, percent: int):
    """Mask of the pairs (x, y) of boxes in which points may link: the minima of the upper corners bound the overlap
    of all their points, and a link needs sizes near each other."""
    import numpy as np

    (top_a, low_a, high_a), (top_b, low_b, high_b) = boxes_a, boxes_b
    least = np.maximum(low_a[x], -(-low_b[y] * percent // 100)) + np.maximum(low_b[y], -(-low_a[x] * percent // 100))
    fine = (high_a[x] * 100 >= low_b[y] * percent) & (high_b[y] * 100 >= low_a[x] * percent)
    at = np.flatnonzero(fine)
    for part in np.array_split(at, max(1, len(at) * top_a.shape[1] >> 20)):
        bound = np.minimum(top_a[x[part]], top_b[y[part]]).sum(axis=1, dtype=np.int64)
        fine[part] = bound * (100 + percent) >= percent * least[part]
    return fine


def tree_pairs(points_a, sizes_a, points_b, sizes_b, percent: int):
    """(i, j, slack) of the points whose summed coordinate minima reach the overlap that a link of their sizes
    needs, by how much. Both trees are descended at once, from the roots; pairs of boxes that hold no link go."""
    import numpy as np

    oa, tree_a = loaded(points_a, sizes_a, percent)
    ob, tree_b = loaded(points_b, sizes_b, percent)
    x = y = np.zeros(1, dtype=np.int64)
    for level in reversed(range(max(len(tree_a), len(tree_b)))):
        if level + 1 < len(tree_a):
            x, y = _below(x, y, len(tree_a[level][0]))
        if level + 1 < len(tree_b):
            y, x = _below(y, x, len(tree_b[level][0]))
        fine = may_link(tree_a[min(level, len(tree_a) - 1)], x, tree_b[min(level, len(tree_b) - 1)], y, percent)
        x, y = x[fine], y[fine]
    found = [(np.zeros(0, dtype=np.int64),) * 3]
    for k in np.unique(x):
        a = oa[k * LEAF : (k + 1) * LEAF]
        b = (y[x == k][:, None] * LEAF + np.arange(LEAF)).ravel()
        b = ob[b[b < len(ob)]]
        for part in np.array_split(b, max(1, len(b) * points_a.shape[1] // (1 << 18))):
            common = np.minimum(points_a[a][:, None, :], points_b[part][None, :, :]).sum(axis=2)
            slack = common * (100 + percent) - percent * (sizes_a[a][:, None] + sizes_b[part][None, :])
            i, j = np.nonzero(slack >= 0)
            found.append((a[i], part[j], slack[i, j]))
    return tuple(np.concatenate(z) for z in zip(*found, strict=True))


def _family_links(percent: int):
    """Links between what the verified stars of a family, or of two blocks of one, leave apart; pairs that links
    found here join already are passed over."""

    def run(pdf):
        import numpy as np
        import pandas as pd

        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        pdf = pdf.drop_duplicates(["node"])
        points = _points(list(pdf["point"]))
        sizes, nodes, block = (pdf[c].to_numpy() for c in ("n", "node", "blk"))
        _, back = np.unique(np.concatenate([nodes, pdf["star"].to_numpy()]), return_inverse=True)
        above = list(range(back.max() + 1))

        def top(x):
            while above[x] != x:
                above[x] = x = above[above[x]]
            return x

        of = back[: len(nodes)].tolist()
        for x, y in zip(of, back[len(nodes) :].tolist(), strict=True):
            above[top(x)] = top(y)
        star = np.array([top(x) for x in of])
        sets = [np.frombuffer(x, dtype=np.uint64) for x in pdf["set"]]
        a, b = np.flatnonzero(block == i), np.flatnonzero(block == j)
        if not len(a) or not len(b):
            return pd.DataFrame({"a": [], "b": []}, dtype=np.int64)
        x, y, slack = tree_pairs(points[a], sizes[a], points[b], sizes[b], percent)
        x, y = a[x], b[y]
        keep = star[x] != star[y]
        if i == j:
            keep &= x < y
        x, y = x[keep], y[keep]
        order = np.argsort(-slack[keep], kind="stable")
        out = []
        for p, q in zip(x[order].tolist(), y[order].tolist(), strict=True):
            s, t = top(of[p]), top(of[q])
            if s == t:
                continue
            u, v = (sets[p], sets[q]) if len(sets[p]) >= len(sets[q]) else (sets[q], sets[p])
            at = np.searchsorted(u, v)
            at[at == len(u)] = 0
            both = int((u[at] == v).sum())
            if 100 * both >= percent * (len(u) + len(v) - both):
                above[s] = t
                out.append((nodes[p], nodes[q]))
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    return run


def dealt(rows: DataFrame, by: str, n: Column) -> DataFrame:
    """rows (by, node, star...) with blk, i and j: pairs of blocks (i, j) in which every two nodes of different stars of
    a group meet. Groups with one star go. In a large group the nodes of its largest star meet only the others, so
    it is linear in that star; n is what a node adds to the shingles of a block."""
    per = rows.groupBy(by, "star").agg(F.count(F.lit(1)).alias("m"), F.sum(n).alias("s"))
    whole = per.groupBy(by).agg(F.sum("m").alias("m"), F.sum("s").alias("s"), F.max(F.struct("m", "s", "star")).alias("top"), F.count(F.lit(1)).alias("stars")).where("stars > 1")
    blocks = lambda m, s: F.greatest(F.ceil(m / BLOCK), F.ceil(s / BLOCK_SHINGLES)).cast("int")
    one = blocks(F.col("m"), F.col("s")) == 1
    few = F.when(one, F.lit(1)).otherwise(blocks(F.col("m") - F.col("top.m"), F.col("s") - F.col("top.s")))
    whole = whole.select(by, F.when(~one, F.col("top.star")).alias("largest"), few.alias("others"), F.when(one, F.lit(0)).otherwise(blocks(F.col("top.m"), F.col("top.s"))).alias("own"))
    rows = rows.join(whole, by).withColumn("large", F.coalesce(F.col("star") == F.col("largest"), F.lit(False)))
    blk = F.when(F.col("large"), F.col("others") + F.pmod(F.xxhash64("node"), F.col("own"))).otherwise(F.pmod(F.xxhash64("node"), F.col("others")))
    rows = rows.withColumn("blk", blk.cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("others") + F.when(F.col("large"), F.lit(0)).otherwise(F.col("own")) - 1)))
    return rows.withColumn("i", F.least("blk", "o")).withColumn("j", F.greatest("blk", "o")).drop("o", "large", "largest", "others", "own")


def forests(buckets: DataFrame, points: DataFrame, star: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that tell families: of every bucket (key, node) with nodes of different stars a forest of the
    pairs whose count vectors allow a link. star: (node, star) of those that have one."""
    parts = int(buckets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = dealt(buckets.join(star, "node", "left").select("key", "node", F.coalesce("star", "node").alias("star")), "key", F.lit(0)).join(points, "node")
    rows = rows.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j").select("key", "i", "j", "blk", "node", "n", "star", "point")
    return rows.mapInArrow(_bucket_forests(percent), "a long, b long").distinct()


def family_links(families: DataFrame, points: DataFrame, sets: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """Links within families (node, root) beyond the verified stars `links` (a, b), as far as they join more. A node
    is of the star of its pivot's pivot, so that stars which a link joins are one."""
    further = links.select(F.col("a").alias("b"), F.col("b").alias("c"))
    stars = links.join(further, "b", "left").select(F.col("a").alias("node"), F.coalesce("c", "b").alias("star"))
    pivots = links.select(F.col("b").alias("node")).distinct().join(links.select(F.col("a").alias("node")), "node", "left_anti").select("node", F.col("node").alias("star"))
    one = families.withColumnRenamed("root", "family").join(stars.union(pivots), "node", "left")
    one = dealt(one.withColumn("star", F.coalesce("star", "node")).join(points, "node"), "family", F.col("n")).join(sets, "node")
    one = one.select("family", "i", "j", "blk", "node", "n", "star", "point", "set")
    return one.groupBy("family", "i", "j").applyInPandas(_family_links(percent), "a long, b long")


def _joined(docs: DataFrame, k: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, th (a hash of its text), n, component_id and root, the hash that tells its component; null without
    a word. The tables on the way are deleted."""
    spark = docs.sparkSession
    slim = docs.select(docs[id_col].alias("id"), docs[text_col].alias("t")).withColumn("th", F.xxhash64("t"))
    kind = dict(slim.dtypes)["id"]
    signed_keys = cut(slim.mapInArrow(_signatures(k, percent), f"id {kind}, th long, n long, node long, point binary, keys array<long>"), "join-signed")
    members = cut(signed_keys.select("id", "th", "n", "node"), "join-members")
    points = signed_keys.where("node is not null").select("id", "node", "n", "point")
    reps = cut(members.where("node is not null").groupBy("node").agg(F.min("id").alias("id")).where("id is not null"), "join-reps")
    chosen = signed_keys.select("id", "node", "keys").join(reps, ["id", "node"], "left_semi")
    keys = chosen.select(F.explode("keys").alias("key"), "node")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = cut(keys.repartitionByRange(parts, "key", "node").sortWithinPartitions("key", "node").mapInArrow(_bucket_rows, "key long, node long, pivot long, edge boolean"), "join-buckets")
    points = cut(points.join(reps, ["id", "node"], "left_semi").dropDuplicates(["node"]).select("node", "n", "point"), "join-points")
    discard(signed_keys)
    del keys, chosen

    # Keys that go on over several ranges may have told some of their nodes as ends only.
    edges = buckets.where("edge").select("key", "node").distinct()
    split = edges.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("key")
    whole = cut(buckets.where("not edge").select("key", "node").union(edges.join(split, "key").select("key", "node")), "join-whole")
    discard(buckets)
    # The pivot of a bucket is the node with the most company over all of its buckets.
    company = whole.join(whole.groupBy("key").agg(F.count(F.lit(1)).alias("m")), "key").groupBy("node").agg(F.sum("m").alias("m"))
    weighed = cut(whole.join(company, "node").select("key", F.struct("m", "node").alias("w")), "join-weighed")
    pivots = weighed.groupBy("key").agg(F.max("w").alias("pivot"))
    star = weighed.join(pivots, "key").where("w.node <> pivot.node").groupBy("w.node").agg(F.max("pivot").alias("pivot"))
    star = star.select(F.col("node").alias("a"), F.col("pivot.node").alias("b"))
    side = lambda x: points.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("point").alias(f"point_{x}"))
    star = star.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "point_a", "point_b")
    star = cut(star.mapInArrow(_allowed(percent), "a long, b long"), "join-star")
    discard(weighed)
    close = cut(forests(whole, points, star.select(F.col("a").alias("node"), F.col("b").alias("star")), percent), "join-close")
    discard(whole)
    families = components(star.union(close))
    discard(close)

    wanted = cut(reps.join(families.select("node"), "node", "left_semi"), "join-wanted")  # a table, so that its size is known
    texts = slim.join(wanted, "id").select("node", "t")
    sets = cut(texts.mapInArrow(_sets(k), "node long, set binary"), "join-sets")
    if sets.count() > sets.select("node").distinct().count():  # repeated rows
        once = cut(sets.dropDuplicates(["node"]), "join-sets")
        discard(sets)
        sets = once
    links = cut(verify(star, sets, percent), "join-links")
    more = cut(family_links(families, points, sets, links, percent), "join-links")
    for done in (families, points, sets, star, wanted):
        discard(done)
    roots = components(links.union(more))
    of_node = reps.join(roots, "node", "left").select("node", "id", F.coalesce("root", "node").alias("root"))
    least = of_node.groupBy("root").agg(F.min("id").alias("component_id"))
    named = of_node.join(least, "root").select("node", "component_id", "root")
    out = members.join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.when(F.col("id").isNotNull(), F.col("component_id")))
    out = cut(out.select("id", "th", "n", component.alias("component_id"), "root"), "join-found")
    for done in (members, reps, links, more, roots):
        discard(done)
    return out


def join_ngrams(docs: DataFrame, k: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id of every row: the least id that links lead to, links being 100 * overlap >=
    percent * union of the shingle sets (A-Z in lower case; k words, or the whole of fewer).

    Null and wordless texts have 0 shingles and their own id. A row without an id takes no part: its
    component_id is null. Repeated rows are one group; an empty table gives an empty one. Further columns,
    whatever their names, aren't read."""
    out = _joined(docs, k, percent, id_col, text_col)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: n_shingles and the component of links at 3 words and 90 %."""
    return join_ngrams(table(spark, sf_dir, "documents"))


OP8_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')) END) AS s FROM words),
sizes AS (SELECT doc_id, count(s) AS n FROM documents LEFT JOIN shingles USING (doc_id) GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared >= 90 * (x.n + y.n - shared)),
reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION SELECT doc_id, CASE WHEN a = other THEN b ELSE a END FROM reach JOIN links ON a = other OR b = other)
SELECT doc_id, n AS n_shingles, min(other) AS component_id FROM reach JOIN sizes USING (doc_id) GROUP BY doc_id, n
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (5 words, 80 %): the one with the least id. Documents without
    a word have no copies and stay, as do those without an id. Of equal rows one stays; different texts under one
    id are documents of their own."""
    found = _joined(docs, 5, 80)
    keep = found.where("root is not null and id is not null").groupBy("root").agg(F.min(F.struct("id", "th")).alias("first")).select("first.id", "first.th")
    keep = keep.union(found.where("root is null and id is not null").select("id", "th").distinct())
    keep = cut(keep.select(F.col("id").alias("kept_id"), F.col("th").alias("kept_th")), "join-keep")
    rows = docs.select(F.struct("*").alias("row"))
    same = (F.col("row.doc_id") == F.col("kept_id")) & (F.xxhash64("row.text") == F.col("kept_th"))
    kept = rows.join(keep, same, "left_semi")
    if found.where("id is not null").groupBy("id", "th").count().where("count > 1").limit(1).count():
        kept = kept.withColumn("id", F.col("row.doc_id")).withColumn("th", F.xxhash64("row.text")).dropDuplicates(["id", "th"])
    discard(found)
    return kept.select(*[F.col(f"row.`{c}`") for c in docs.columns]).union(docs.where("doc_id is null"))
