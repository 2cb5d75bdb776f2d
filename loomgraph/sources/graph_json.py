"""Graphs and trees as JSON of a known version, questions and claims as text."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.model import EDGE_COLUMNS, NODE_COLUMNS, SCHEMA_VERSION, TREE_VERSION, Graph

_PROVENANCE = "struct<resolver:string,confidence:double,file:string,line:int,column:int>"
_GRAPH = (
    f"version string, nodes array<struct<id:string,kind:string,name:string,attributes:map<string,string>,provenance:{_PROVENANCE}>>, "
    f"edges array<struct<from:string,to:string,kind:string,attributes:map<string,string>,provenance:{_PROVENANCE}>>"
)


class NotAGraph(ValueError):
    """The file is no graph, of another version, or cut off."""


def _checked(df: DataFrame, what: str, version: str) -> DataFrame:
    first = df.select("version", "_bad").first()
    if first is None or not (first["version"] or "").strip():
        raise NotAGraph(f"not a {what}: it has no version" if first is None or not first["_bad"] else f"a truncated {what}")
    if first["version"] != version:
        raise NotAGraph(f"a {what} of version {first['version']}; this reads {version}")
    return df


def read(spark: SparkSession, path: str) -> Graph:
    """A graph file. The version is looked at first; another one is refused."""
    raw = spark.read.schema(f"{_GRAPH}, _bad string").option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").json(path)
    raw = _checked(raw, "graph", SCHEMA_VERSION)
    p = ["r.provenance.resolver", "r.provenance.confidence", "r.provenance.file", "r.provenance.line", F.col("r.provenance.column").alias("col"), "seq"]
    nodes = raw.select(F.posexplode("nodes").alias("seq", "r")).select("r.id", "r.kind", "r.name", "r.attributes", *p)
    edges = raw.select(F.posexplode("edges").alias("seq", "r")).select(F.col("r.from").alias("src"), F.col("r.to").alias("dst"), "r.kind", "r.attributes", *p)
    fit = lambda df: df.withColumn("seq", F.col("seq").cast("long"))
    return Graph(fit(nodes).select(*NODE_COLUMNS), fit(edges).select(*EDGE_COLUMNS))


def read_tree(spark: SparkSession, path: str, fingerprint: str | None = None) -> tuple[DataFrame, DataFrame, str]:
    """(nodes, links, fingerprint) of a tree file; with a fingerprint given, a tree of another graph is refused."""
    schema = "version string, fingerprint string, nodes array<struct<id:string,kind:string,name:string,graphIds:array<string>,children:array<string>,facts:map<string,string>>>, _bad string"
    raw = _checked(spark.read.schema(schema).option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").json(path), "tree", TREE_VERSION)
    own = raw.select("fingerprint").first()[0]
    if fingerprint is not None and own != fingerprint:
        raise NotAGraph("the tree was derived from another graph")
    rows = raw.select(F.explode("nodes").alias("n")).select("n.*")
    return rows.drop("children"), rows.select(F.col("id").alias("parent"), F.posexplode("children").alias("ord", "child")), own


def questions(spark: SparkSession, path: str) -> DataFrame:
    """A question set: tab-separated rows of eight fields or nine, lists by |; blank and # lines are skipped."""
    rows = spark.read.text(path).where("trim(value) <> '' and value not like '#%'")
    f = F.split("value", "\t")
    cols = [f.getItem(i).alias(n) for i, n in enumerate(("id", "repository", "question", "kind", "subject"))]
    listed = lambda i: F.filter(F.split(f.getItem(i), r"\|"), lambda x: F.trim(x) != "")
    return rows.where(F.size(f) >= 8).select(
        *cols, listed(5).alias("expected"), listed(6).alias("locations"), f.getItem(7).cast("double").alias("min_confidence"),
        F.coalesce(F.lower(F.trim(F.get(f, F.lit(8)))).isin("true", "exhaustive", "yes"), F.lit(False)).alias("exhaustive"),
    )


CLAIM_KINDS = ("SUMMARY", "NAME", "CAPABILITY", "RISK", "DISPUTE")


def claims(text: str) -> list[dict]:
    """Claims of a JSON array (or of its `claims`): unknown kinds are skipped, confidence is 0.5 if it isn't said
    and 0.80 at most."""
    data = json.loads(text)
    found = []
    for i, c in enumerate(data.get("claims", []) if isinstance(data, dict) else data):
        if str(c.get("kind", "")).upper() not in CLAIM_KINDS:
            continue
        cites = [(x.get("from"), x.get("to"), x.get("kind")) for x in c.get("citations", [])]
        found.append({"claim_id": f"c{i}", "ord": i, "subject": c.get("subject"), "kind": c["kind"].upper(), "value": c.get("value"), "confidence": min(0.80, float(c.get("confidence", 0.5))), "citations": cites})
    return found
