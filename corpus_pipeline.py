"""A corpus pipeline over `documents`: rules, lines, near copies, leaks, mix. Each stage is written as Parquet
and read again as the next one's documents; all but the last keep the columns of `documents`.

Null, empty and wordless texts fail the rules of the first stage and go. Of equal rows, and of near copies, the one
with the least id stays; documents without an id pass the near-copy stage as they are. Different texts under one id are
documents of their own. Further columns, whatever their names, are kept up to the mix; an empty table gives an empty
mix. What is random or a tie is settled by hashes of ids, so reruns agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import decontaminate, line_dedup, mixing, ngram_join, quality_rules
from loomgraph.llm.common import cut, table

STAGES = [
    ("quality rules", quality_rules.stage),
    ("line dedup", line_dedup.stage),
    ("n-gram join", ngram_join.stage),
    ("decontamination", decontaminate.stage),
    ("mixing", mixing.stage),
]

#: The mix is random and near copies need components, which SQL doesn't give in one statement.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of what the stages keep, a row a document: doc_id, source, size, source_size, target, taken, copies."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
