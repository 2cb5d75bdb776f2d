"""Mixing sources to target weights by pivotal dependent rounding. DataFrame functions only.

Every document of a source is to be copied target / source size times on average. The whole part is given
at once; the fractions are rounded by pairs: of two documents, mass moves from one to the other at random,
in either direction with the odds that keep both expectations, until one of them is whole. Mass is
weighed by the documents' sizes, so each step keeps the source's words exactly and only the last residual
of a source is rounded alone, to the nearer side: the words taken differ from the target by half of that one
document at most.

The pairing runs as a reduction tree. Documents are dealt by a hash of their id to blocks of about BLOCK
documents of one source; a block is folded to one residual, residuals are dealt to blocks again, and so
on: log64(documents) rounds, none of which has a task that grows with a source. The random numbers are
hashes of ids and seed, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import WORD_SQL, cut, table

#: Documents that one fold takes, on average.
BLOCK = 64
#: A source is never taken more than so many times.
MOST = 3.0


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_SQL)), F.lit(0)).cast("long")


def running(df: DataFrame, order: list[Column], sums: dict[str, Column], label: str) -> DataFrame:
    """df with the sums of the rows before each one in that order, which must be total. The rows are dealt to tasks by
    range, and the sums of whole ranges are added to those within one, so no task sorts them all."""
    dealt = cut(df.select("*", *[c.alias(k) for k, c in sums.items()]).repartitionByRange(*order).withColumn("part", F.spark_partition_id()), label)
    ranges = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a task
    offsets = dealt.groupBy("part").agg(*[F.sum(k).alias(f"in_{k}") for k in sums]).select("part", *[F.coalesce(F.sum(f"in_{k}").over(ranges), F.lit(0)).alias(f"to_{k}") for k in sums])
    within = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = {k: F.coalesce(F.sum(k).over(within), F.lit(0)) for k in sums}
    out = dealt.select(*[c for c in dealt.columns if c not in sums], *[c.alias(f"own_{k}") for k, c in own.items()]).join(offsets, "part")
    return out.select(*df.columns, *[(F.col(f"own_{k}") + F.col(f"to_{k}")).alias(k) for k in sums])


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = MOST) -> DataFrame:
    """source, n_docs, source_size, target, from rows (source, size). Sources by code point, null last, get
    the weights in turn; the targets share all sizes by weight, none over `most` times its source's size:
    what is cut off goes to the others by weight, until none is above. The level at which that ends is found
    in one pass over the sources sorted by size per weight (those that are capped come first)."""
    per = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    by_name = [F.col("source").isNull(), F.col("source")]
    per = running(per, by_name, {"place": F.lit(1).cast("long")}, "mix-sources")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("w", w).withColumn("most", F.col("source_size") * F.lit(float(most))).drop("place")
    per = cut(running(per, [F.col("most") / F.col("w"), *by_name], {"most_before": F.col("most"), "w_before": F.col("w")}, "mix-levels"), "mix-levels")
    whole = per.agg(F.sum("source_size"), F.sum("w")).first()
    level = (F.lit(float(whole[0] or 0)) - F.col("most_before")) / (F.lit(float(whole[1] or 1)) - F.col("w_before"))
    first = per.withColumn("level", level).where(F.col("level") * F.col("w") < F.col("most"))
    final = first.agg(F.min(F.struct(F.col("most") / F.col("w"), F.col("source").isNull(), "source", "level"))["level"]).first()[0]
    return per.select("source", "n_docs", F.col("source_size").cast("long").alias("source_size"), F.least("most", F.lit(float(final or 0.0)) * F.col("w")).alias("target"))


def _chance(*parts: Column | str, seed: int) -> Column:
    """A number in [0, 1) that depends on the parts and the seed alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *parts), 11).cast("double") / F.lit(float(1 << 53))


def _bind(value: Column, then):
    """then(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _pair(first: Column, second: Column, seed: int) -> Column:
    """struct(done, rest): one of the two documents with a whole share, the other with what is left."""
    share = lambda d, p: F.struct(*[d[c].alias(c) for c in ("k", "h", "id", "size", "times", "extra")], p.alias("p"))
    step = F.struct(first.alias("a"), second.alias("b"), (second["size"] / first["size"]).alias("r"))

    def move(x: Column) -> Column:
        a, b, r = x["a"], x["b"], x["r"]
        return F.struct(
            a.alias("a"), b.alias("b"), r.alias("r"), _chance(a["h"], b["h"], seed=seed).alias("u"),
            (F.lit(1.0) - a["p"]).alias("room"), (b["p"] * r).alias("give"), a["p"].alias("have"), ((F.lit(1.0) - b["p"]) * r).alias("take"),
        )

    def choose(x: Column) -> Column:
        a, b, r = x["a"], x["b"], x["r"]
        up, down = F.least(x["room"], x["give"]), F.least(x["have"], x["take"])
        rises = x["u"] * (up + down) < down
        whole = lambda p: F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))
        return (
            F.when(rises & (x["room"] <= x["give"]), F.struct(share(a, F.lit(1.0)).alias("done"), share(b, whole(b["p"] - up / r)).alias("rest")))
            .when(rises, F.struct(share(b, F.lit(0.0)).alias("done"), share(a, whole(a["p"] + up)).alias("rest")))
            .when(x["have"] <= x["take"], F.struct(share(a, F.lit(0.0)).alias("done"), share(b, whole(b["p"] + down / r)).alias("rest")))
            .otherwise(F.struct(share(b, F.lit(1.0)).alias("done"), share(a, whole(a["p"] - down)).alias("rest")))
        )

    return _bind(_bind(step, move), choose)


def _fold(items: Column, item_type: str, seed: int) -> Column:
    """struct(done array, rest): the block's documents taken pair by pair. The largest come first (k is the
    negative size), so that what is left over in the end is a small one."""
    start = F.struct(F.array().cast(f"array<{item_type}>").alias("done"), F.element_at(items, 1).alias("rest"))
    merge = lambda acc, d: _bind(_pair(acc["rest"], d, seed), lambda x: F.struct(F.concat(acc["done"], F.array(x["done"])).alias("done"), x["rest"].alias("rest")))
    return F.aggregate(F.slice(items, F.lit(2), F.greatest(F.size(items) - 1, F.lit(0))), start, merge)


def mix(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = MOST, seed: int = 17, block: int = BLOCK) -> DataFrame:
    """Rows (id, source, size) with source_size, target and copies (long): how often the mix takes the row.

    Nulls: a null id is an id like others, a null source a source of its own, last; a null size is 0. Rows
    of size 0 carry nothing and get the whole part of their copies. Equal rows are one counted group: the whole
    part of their fractions is given to as many of them, the residual takes part in the pairing, so however many
    rows share an id, they are one item there. An empty table gives an empty one."""
    slim = sizes.select("id", "source", F.coalesce("size", F.lit(0)).cast("long").alias("size"))
    slim = cut(slim.groupBy("id", "source", "size").agg(F.count(F.lit(1)).alias("times")), "mix-sizes")
    targets = cut(source_targets(slim.select("source", (F.col("size") * F.col("times")).alias("size")), weights, most), "mix-targets")
    t = targets.select(F.col("source").alias("t_source"), "n_docs", "source_size", "target")
    rows = slim.join(t, slim["source"].eqNullSafe(t["t_source"]), "left").drop("t_source")
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    rows = rows.withColumn("rate", rate).withColumn("whole", F.floor("rate")).withColumn("p", F.col("rate") - F.col("whole"))
    rows = rows.withColumn("extra", F.floor(F.col("p") * F.col("times"))).withColumn("p", F.col("p") * F.col("times") - F.col("extra"))
    keep = ["source", "source_size", "target", "whole"]
    own = ["id", "size", "times", "extra"]
    fractional = (F.col("size") > 0) & (F.col("p") > 0)
    lone = F.when(F.col("size") > 0, F.col("extra")).otherwise(F.lit(0)).cast("long")
    settled = [rows.where(~fractional).select("id", "size", "times", lone.alias("extra"), *keep, F.lit(0.0).alias("p"))]

    item_type = f"struct<k:bigint,h:bigint,id:{dict(slim.dtypes)['id']},size:bigint,times:bigint,extra:bigint,p:double>"
    blocks = F.greatest(F.ceil(F.col("n_docs") / block), F.lit(1)).cast("long")
    level = rows.where(fractional).select(
        *keep, blocks.alias("blocks"), F.pmod(F.xxhash64(F.lit(seed), "id", "size"), blocks).alias("block"),
        F.struct((-F.col("size")).alias("k"), F.xxhash64(F.lit(seed + 1), "id", "size").alias("h"), *own, "p").cast(item_type).alias("item"),
    )
    most_docs = targets.agg(F.max("n_docs")).first()[0] or 0
    left = max(1, -(-most_docs // block))
    while True:
        folded = cut(
            level.groupBy(*keep, "blocks", "block")
            .agg(F.array_sort(F.collect_list("item")).alias("items"))
            .select(*keep, "blocks", "block", _fold(F.col("items"), item_type, seed + 2).alias("f")),
            "mix-level",
        )
        settled.append(folded.select(*keep, F.explode("f.done").alias("d")).select(*[f"d.{c}" for c in own], *keep, "d.p"))
        if left == 1:
            break
        left = -(-left // block)
        fewer = F.greatest(F.ceil(F.col("blocks") / block), F.lit(1)).cast("long")
        level = folded.select(*keep, fewer.alias("blocks"), F.pmod(F.xxhash64(F.lit(seed), "block"), fewer).alias("block"), F.col("f.rest").alias("item"))
    last = folded.select(*keep, F.col("f.rest").alias("d"))
    settled.append(last.select(*[f"d.{c}" for c in own], *keep, (F.col("d.p") >= 0.5).cast("double").alias("p")))
    out = settled[0].select(*own, *keep, "p")
    for part in settled[1:]:
        out = out.unionByName(part)
    # Of equal rows, the first `more` are taken once more than the others.
    out = out.withColumn("more", F.col("extra") + F.round("p").cast("long")).withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return out.select("id", "source", "size", "source_size", "target", (F.col("whole") + (F.col("nth") <= F.col("more")).cast("long")).cast("long").alias("copies"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """mix() over documents, sized by their words (a null text has none)."""
    return mix(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size")), **options)


def _report(docs: DataFrame) -> DataFrame:
    out = mix_documents(docs)
    return out.select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its size, its source's size and target, and the words that the mix takes of it."""
    return _report(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the documents that the earlier stages kept, one row per document."""
    return _report(docs)
