"""Graphs as JSON, GraphML, DOT, Cytoscape, SARIF, a page, and reports.

Lines are made by expressions and written by Spark; only the single-file forms, which a person opens, pass
through the driver, a row at a time.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from html import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.model import SCHEMA_VERSION, TREE_VERSION, Graph, induced
from loomgraph.operators.analytics import degrees

VIEW_NODES = 500


def _sorted(attributes: str) -> Column:
    return F.map_from_entries(F.array_sort(F.map_entries(F.coalesce(attributes, F.create_map().cast("map<string,string>")))))


def _provenance() -> Column:
    return F.struct("resolver", "confidence", "file", "line", F.col("col").alias("column")).alias("provenance")


def node_lines(g: Graph) -> DataFrame:
    return g.nodes.select("seq", "id", F.to_json(F.struct("id", "kind", "name", _sorted("attributes").alias("attributes"), _provenance())).alias("value"))


def edge_lines(g: Graph) -> DataFrame:
    return g.edges.select("seq", "src", F.to_json(F.struct(F.col("src").alias("from"), F.col("dst").alias("to"), "kind", _sorted("attributes").alias("attributes"), _provenance())).alias("value"))


def write_json(g: Graph, path: str) -> None:
    """One canonical file: rows in order, attributes by key."""
    with open(path, "w", encoding="utf-8") as f:
        f.write(f'{{\n  "version": "{SCHEMA_VERSION}",\n  "nodes": [')
        _rows(f, node_lines(g).orderBy("seq", "id"))
        f.write('\n  ],\n  "edges": [')
        _rows(f, edge_lines(g).orderBy("seq", "src", "value"))
        f.write("\n  ]\n}\n")


def _rows(f, lines: DataFrame) -> None:
    for i, row in enumerate(lines.select("value").toLocalIterator()):
        f.write(("," if i else "") + "\n    " + row["value"])


def write_table(g: Graph, path: str) -> None:
    """The form for large graphs: Parquet, edges by target, so that backward hops read few files."""
    g.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    g.edges.repartitionByRange("dst").sortWithinPartitions("dst").write.mode("overwrite").parquet(f"{path}/edges")


def write_tree(nodes: DataFrame, links: DataFrame, fingerprint: str, path: str) -> None:
    below = links.groupBy("parent").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "child"))), lambda x: x["child"]).alias("children"))
    rows = nodes.join(below, nodes["id"] == below["parent"], "left").withColumn("children", F.coalesce("children", F.array().cast("array<string>")))
    value = F.to_json(F.struct("id", "kind", "name", F.col("graph_ids").alias("graphIds"), "children", _sorted("facts").alias("facts")))
    with open(path, "w", encoding="utf-8") as f:
        f.write(f'{{\n  "version": "{TREE_VERSION}",\n  "fingerprint": {json.dumps(fingerprint)},\n  "nodes": [')
        _rows(f, rows.select("id", value.alias("value")).orderBy("id"))
        f.write("\n  ]\n}\n")


def _xml(c: str) -> Column:
    col = F.col(c)
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        col = F.replace(col, F.lit(raw), F.lit(safe))
    return col


def graphml(g: Graph) -> DataFrame:
    """(part, value): the lines of a GraphML document, to be written in order of part."""
    key = lambda n, t: f'  <key id="{n}" for="{t}" attr.name="{n}" attr.type="{ {"line": "int", "confidence": "double"}.get(n, "string") }"/>'
    head = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', *[key(n, "node") for n in ("name", "kind", "file", "line")], *[key(n, "edge") for n in ("relation", "resolver", "confidence", "evidence")], '  <graph id="repository" edgedefault="directed">']
    data = lambda k, v: F.concat(F.lit(f'<data key="{k}">'), v, F.lit("</data>"))
    n = g.nodes.select(F.lit(1).alias("part"), F.concat(F.lit('    <node id="'), _xml("id"), F.lit('">'), data("name", _xml("name")), data("kind", F.col("kind")), data("file", _xml("file")), data("line", F.col("line").cast("string")), F.lit("</node>")).alias("value"))
    e = g.edges.select(F.lit(2).alias("part"), F.concat(F.lit('    <edge source="'), _xml("src"), F.lit('" target="'), _xml("dst"), F.lit('">'), data("relation", F.col("kind")), data("resolver", _xml("resolver")), data("confidence", F.col("confidence").cast("string")), data("evidence", F.concat_ws(":", _xml("file"), F.col("line").cast("string"))), F.lit("</edge>")).alias("value"))
    return _framed(g, "\n".join(head), n.union(e), "  </graph>\n</graphml>")


def _framed(g: Graph, head: str, rows: DataFrame, tail: str) -> DataFrame:
    ends = g.spark.createDataFrame([(0, head), (9, tail)], "part int, value string")
    return ends.union(rows)


def _quoted(c: str) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(F.col(c), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def dot(g: Graph) -> DataFrame:
    """DOT lines; edges under 0.95 are dashed."""
    n = g.nodes.select(F.lit(1).alias("part"), F.concat(F.lit("  "), _quoted("id"), F.lit(" [label="), F.regexp_replace(_quoted("name"), '"$', ""), F.lit("\\n"), "kind", F.lit('"];')).alias("value"))
    style = F.when(F.col("confidence") < 0.95, F.lit(", style=dashed")).otherwise(F.lit(""))
    e = g.edges.select(F.lit(2).alias("part"), F.concat(F.lit("  "), _quoted("src"), F.lit(" -> "), _quoted("dst"), F.lit(' [label="'), "kind", F.lit('"'), style, F.lit("];")).alias("value"))
    return _framed(g, "digraph repository {\n  rankdir=LR;\n  node [shape=box];", n.union(e), "}")


def cytoscape(g: Graph) -> DataFrame:
    """Cytoscape elements, one JSON line each."""
    n = g.nodes.select(F.lit(1).alias("part"), F.to_json(F.struct(F.struct("id", F.col("name").alias("label"), "kind").alias("data"))).alias("value"))
    e = g.edges.select(F.lit(2).alias("part"), F.to_json(F.struct(F.struct(F.concat_ws("|", "src", "dst", "kind", F.col("line").cast("string"), F.col("col").cast("string")).alias("id"), F.col("src").alias("source"), F.col("dst").alias("target"), F.col("kind").alias("label"), "confidence").alias("data"))).alias("value"))
    return n.union(e)


def sarif(impacted: DataFrame, nodes: DataFrame, tool: str = "impact") -> DataFrame:
    """SARIF results (seed, id, value) of an impact, at line 1 or later."""
    place = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), F.struct(F.greatest(F.lit(1), "line").alias("startLine")).alias("region")).alias("physicalLocation"))
    text = F.concat("id", F.lit(" is affected by "), "seed", F.lit(" at depth "), F.col("depth").cast("string"))
    row = F.struct(F.lit(tool).alias("ruleId"), F.lit("note").alias("level"), F.struct(text.alias("text")).alias("message"), F.array(place).alias("locations"))
    return impacted.join(nodes.select("id", "file", "line"), "id").select("seed", "id", F.to_json(row).alias("value"))


def view(g: Graph, title: str, most: int = VIEW_NODES) -> str:
    """A page that shows the nodes with the most references and the edges between them: `most` bounds what the
    driver gets."""
    d = degrees(g.edges).select("id", (F.col("in_degree") + F.col("out_degree")).alias("degree"))
    top = g.nodes.join(d, "id", "left").orderBy(F.coalesce("degree", F.lit(0)).desc(), "id").limit(most)
    small = induced(g, top)
    nodes = [r.asDict() for r in top.select("id", "name", "kind").orderBy("id").collect()]
    edges = [r.asDict() for r in small.edges.select("src", "dst", "kind", "confidence").orderBy("src", "dst", "kind").collect()]
    data = json.dumps({"nodes": nodes, "edges": edges}).replace("</", "<\\/")
    rows = "".join(f"<tr><td>{escape(n['kind'])}</td><td>{escape(n['name'])}</td><td>{escape(n['id'])}</td></tr>" for n in nodes)
    return f'<!doctype html><meta charset="utf-8"><title>{escape(title)}</title><h1>{escape(title)}</h1><p>{len(nodes)} nodes, {len(edges)} edges</p><table>{rows}</table><script type="application/json" id="graph">{data}</script>\n'


def report(title: str, rows: DataFrame, most: int = 50) -> str:
    """A text report of the first rows, which says how many more there are."""
    lines = [title]
    for r in rows.limit(most).collect():
        lines.append("  " + "  ".join(f"{k}={v}" for k, v in r.asDict().items()))
    if len(lines) > most and (more := rows.count() - most):
        lines.append(f"  ... and {more} more")
    return "\n".join(lines) + "\n"


def gate(impacted: DataFrame, most: int) -> int:
    """The number of impacted nodes; raises if there are more than `most`."""
    n = impacted.select("id").distinct().count()
    if n > most:
        raise RuntimeError(f"{n} nodes are affected; at most {most} may be")
    return n


BRIEFING = (
    "Describe each subject from its facts and citable edges alone.\n"
    "Every claim cites at least one of the edges given, and says nothing that they don't show.\n"
    "A claim is a SUMMARY, a NAME, a CAPABILITY, a RISK or a DISPUTE; its confidence is 0.80 at most.\n"
)


def packet_markdown(packets: Iterable[dict], repository: str) -> str:
    """Work packets (rows of answers.packets) for an author of claims."""
    out = [f"# Work packets for {repository}", "", BRIEFING]
    for p in packets:
        out += [f"## {p['name']} ({p['kind']})", "", f"`{p['id']}`", ""]
        out += [f"- {c['src']} {c['kind']} {c['dst']}" for c in p["citable"] or []] + [""]
    return "\n".join(out)


def claims_json(claims: DataFrame) -> DataFrame:
    """Claims in order of subject, kind and value, one JSON line each."""
    return claims.orderBy("subject", "kind", "value").select(F.to_json(F.struct("subject", "kind", "value", "confidence")).alias("value"))
