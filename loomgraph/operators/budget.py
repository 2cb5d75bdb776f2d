"""Selections under a budget: what fits is taken in order, what doesn't is skipped."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIGEST_BUDGET = 240


def knapsack(items: DataFrame, budget: int, group: str | None = None) -> DataFrame:
    """Rows (group, ord, id, cost) with `taken`: in order, an item is taken if it still fits, and skipped, not
    stopped at, if it doesn't. Of one cost only the first budget / cost items can ever fit, so no more than those
    (budget * log(budget) at most, whatever the group has) come to the one task that goes through them in order."""
    keys = [group] if group else []
    base = items.select(*keys, "ord", "id", F.col("cost").cast("long").alias("cost"))
    nth = F.row_number().over(Window.partitionBy(*keys, "cost").orderBy("ord", "id"))
    ranked = base.where(f"cost > 0 and cost <= {budget}").withColumn("_n", nth)
    able = ranked.where(F.col("_n") * F.col("cost") <= budget).drop("_n")
    listed = able.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ord", "id", "cost"))).alias("xs"))

    @F.pandas_udf("array<boolean>")
    def fits(costs: pd.Series) -> pd.Series:
        def one(xs):
            out, used = [], 0
            for x in xs:
                out.append(bool(used + x <= budget))
                used += x if out[-1] else 0
            return out

        return costs.map(one)

    judged = listed.withColumn("t", fits(F.transform("xs", lambda x: x["cost"])))
    judged = judged.select(*keys, F.explode(F.arrays_zip(F.col("xs").alias("x"), F.col("t").alias("t"))).alias("z")).select(*keys, "z.x.ord", "z.x.id", "z.x.cost", F.col("z.t").alias("taken"))
    late = ranked.where(F.col("_n") * F.col("cost") > budget).drop("_n").withColumn("taken", F.lit(False))
    sure = base.where(f"cost <= 0 or cost > {budget} or cost is null").withColumn("taken", F.coalesce(F.col("cost") <= 0, F.lit(False)))
    return judged.unionByName(late).unionByName(sure)


def compress(callers: DataFrame, evidence: DataFrame, fixed: DataFrame, budget: int) -> DataFrame:
    """(seed, callers_kept, evidence_kept, tokens): how much of each packet fits the budget. callers (seed, ord,
    tokens) go from the tail while there are more of them than endpoints, then evidence (seed, ord, tokens) from
    its tail, one at least staying. fixed: (seed, tokens, endpoints) of what always stays. Both phases are the
    longest prefix that fits, so prefix sums say it without a loop."""
    sums = Window.partitionBy("seed").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    c = callers.select("seed", F.row_number().over(Window.partitionBy("seed").orderBy("ord")).alias("n"), F.sum("tokens").over(sums).alias("s"))
    e = evidence.select("seed", F.row_number().over(Window.partitionBy("seed").orderBy("ord")).alias("n"), F.sum("tokens").over(sums).alias("s"))
    ct = c.groupBy("seed").agg(F.max("n").alias("c_n"), F.max_by("s", "n").alias("c_s"))
    et = e.groupBy("seed").agg(F.max("n").alias("e_n"), F.max_by("s", "n").alias("e_s"))
    zero = F.lit(0).cast("long")
    p = fixed.join(ct, "seed", "left").join(et, "seed", "left").select(
        "seed", F.col("tokens").alias("f"), "endpoints", *[F.coalesce(x, zero).cast("long").alias(x) for x in ("c_n", "c_s", "e_n", "e_s")]
    )
    # Callers: the most that fit with all evidence, but not fewer than the endpoints.
    fit_c = p.join(c, "seed").where(F.col("f") + F.col("e_s") + F.col("s") <= budget).groupBy("seed").agg(F.max("n").alias("fit"))
    p = p.join(fit_c, "seed", "left")
    fits = F.col("f") + F.col("c_s") + F.col("e_s") <= budget
    kept_c = F.when(fits, F.col("c_n")).otherwise(F.greatest(F.coalesce("fit", zero), F.least("c_n", "endpoints")))
    p = p.withColumn("callers_kept", kept_c.cast("long"))
    cs = p.join(c.select("seed", F.col("n").alias("callers_kept"), F.col("s").alias("c_kept")), ["seed", "callers_kept"], "left").withColumn("c_kept", F.coalesce("c_kept", zero))
    fit_e = cs.join(e, "seed").where(F.col("f") + F.col("c_kept") + F.col("s") <= budget).groupBy("seed").agg(F.max("n").alias("fit_e"))
    cs = cs.join(fit_e, "seed", "left")
    all_fit = F.col("f") + F.col("c_kept") + F.col("e_s") <= budget
    kept_e = F.when(all_fit, F.col("e_n")).otherwise(F.greatest(F.coalesce("fit_e", zero), F.least("e_n", F.lit(1))))
    cs = cs.withColumn("evidence_kept", kept_e.cast("long"))
    done = cs.join(e.select("seed", F.col("n").alias("evidence_kept"), F.col("s").alias("e_kept")), ["seed", "evidence_kept"], "left")
    return done.select("seed", "callers_kept", "evidence_kept", (F.col("f") + F.col("c_kept") + F.coalesce("e_kept", zero)).cast("long").alias("tokens"))


def digest(phrases: list[str | None], budget: int = DIGEST_BUDGET) -> str:
    """Phrases that add the most new words, joined by `; ` within the budget; of equals the first in order. One
    that doesn't fit is skipped; when none adds a word it ends."""
    left = sorted({p.strip() for p in phrases if p and p.strip()})
    said: set[str] = set()
    chosen, used = [], 0
    while left:
        gain = [sum(w not in said for w in p.split(" ")) for p in left]
        best = max(range(len(left)), key=lambda i: (gain[i], -i))
        if not gain[best]:
            break
        phrase = left.pop(best)
        if used + len(phrase) + 2 > budget:
            continue
        chosen.append(phrase)
        used += len(phrase) + 2
        said.update(phrase.split(" "))
    return "; ".join(chosen)


def digests(phrases: Column, budget: int = DIGEST_BUDGET) -> Column:
    """digest() of an array column, in Arrow batches."""

    @F.pandas_udf("string")
    def run(xs: pd.Series) -> pd.Series:
        return xs.map(lambda x: digest(list(x) if x is not None else [], budget))

    return run(phrases)


def candidates(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Enrichment candidates (id, score): references in, 2.5 for each doubtful edge (confidence under 0.95) out
    of or into them, 8 if exposed, less 3 if annotated; over 0, two decimals."""
    ins = edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("ins"), F.max((F.col("kind") == "EXPOSES").cast("int")).alias("exposed"))
    doubt = edges.where("confidence < 0.95")
    doubts = doubt.select(F.col("src").alias("id")).union(doubt.select("dst")).groupBy("id").agg(F.count(F.lit(1)).alias("doubts"))
    n = nodes.join(ins, "id", "left").join(doubts, "id", "left").na.fill(0, ["ins", "exposed", "doubts"])
    annotated = F.when(F.coalesce(F.col("attributes")["annotations"], F.lit("")) != "", 3.0).otherwise(0.0) if "attributes" in nodes.columns else F.lit(0.0)
    raw = F.col("ins") + 2.5 * F.col("doubts") + 8.0 * F.col("exposed") - annotated
    return n.select("id", "kind", "name", (F.floor(raw * 100 + 0.5) / 100).alias("score")).where("score > 0")
