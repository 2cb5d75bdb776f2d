"""Star-schema tables seen as a property graph.

region, nation, customer, supplier, part, order are nodes; an order line is a member `order:k#n` of its order,
as a method is one of its type. Containment runs region > nation > customer and supplier; dependencies follow
the foreign keys; a line calls its part and consumes its supplier, with the line's discount as doubt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.model import Graph

_CERTAIN = "'key' AS resolver, 1.0D AS confidence, '' AS file, 0 AS line, 0 AS col"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def star_graph(spark: SparkSession, sf_dir: str) -> Graph:
    t = {n: table(spark, sf_dir, n) for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")}

    def nodes(df, prefix, key, kind, name):
        return df.selectExpr(f"concat('{prefix}:', {key}) AS id", f"'{kind}' AS kind", f"{name} AS name")

    def edges(df, src, dst, kind, where=_CERTAIN):
        return df.selectExpr(f"{src} AS src", f"{dst} AS dst", f"'{kind}' AS kind", *where.split(", "))

    n = nodes(t["region"], "region", "r_regionkey", "MODULE", "r_name")
    for part in (
        nodes(t["nation"], "nation", "n_nationkey", "TYPE", "n_name"),
        nodes(t["customer"], "customer", "c_custkey", "SERVICE", "c_name"),
        nodes(t["supplier"], "supplier", "s_suppkey", "EXTERNAL_SERVICE", "s_name"),
        nodes(t["part"], "part", "p_partkey", "DATABASE_TABLE", "p_name"),
        nodes(t["orders"], "order", "o_orderkey", "ENDPOINT", "o_orderpriority"),
        t["lineitem"].selectExpr("concat('order:', l_orderkey, '#', l_linenumber) AS id", "'METHOD' AS kind", "concat('line ', l_linenumber) AS name").distinct(),
    ):
        n = n.union(part)
    line = "l_returnflag AS resolver, round(1 - l_discount; 2) AS confidence, 'lineitem' AS file, cast(l_orderkey as int) AS line, l_linenumber AS col"
    of = [
        (t["nation"], "concat('region:', n_regionkey)", "concat('nation:', n_nationkey)", "CONTAINS"),
        (t["customer"], "concat('nation:', c_nationkey)", "concat('customer:', c_custkey)", "CONTAINS"),
        (t["supplier"], "concat('nation:', s_nationkey)", "concat('supplier:', s_suppkey)", "CONTAINS"),
        (t["nation"], "concat('nation:', n_nationkey)", "concat('region:', n_regionkey)", "DEPENDS_ON"),
        (t["customer"], "concat('customer:', c_custkey)", "concat('nation:', c_nationkey)", "DEPENDS_ON"),
        (t["supplier"], "concat('supplier:', s_suppkey)", "concat('nation:', s_nationkey)", "DEPENDS_ON"),
        (t["orders"], "concat('order:', o_orderkey)", "concat('customer:', o_custkey)", "DEPENDS_ON"),
    ]
    e = None
    for df, src, dst, kind in of:
        x = edges(df, src, dst, kind)
        e = x if e is None else e.union(x)
    member = "concat('order:', l_orderkey, '#', l_linenumber)"
    for src, dst, kind in (("concat('order:', l_orderkey)", member, "DECLARES"), (member, "concat('part:', l_partkey)", "CALLS"), (member, "concat('supplier:', l_suppkey)", "CONSUMES")):
        where = [x.replace(";", ",") for x in line.split(", ")]
        e = e.union(t["lineitem"].selectExpr(f"{src} AS src", f"{dst} AS dst", f"'{kind}' AS kind", *where))
    return Graph(n, e)


def as_graph_rows(g: Graph) -> Graph:
    """The same with the columns a stored graph has (attributes, places and a total order)."""
    empty = F.create_map().cast("map<string,string>")
    nodes = g.nodes.select("id", "kind", "name", empty.alias("attributes"), F.lit("key").alias("resolver"), F.lit(1.0).alias("confidence"), F.lit("").alias("file"), F.lit(0).alias("line"), F.lit(0).alias("col"), F.xxhash64("id").alias("seq"))
    edges = g.edges.select("src", "dst", "kind", empty.alias("attributes"), "resolver", "confidence", "file", "line", "col", F.xxhash64("src", "dst", "kind", "line", "col", "resolver", "confidence").alias("seq"))
    return Graph(nodes, edges)


def part_supplier_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): supplier and part of every order line."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(F.concat(F.lit("supplier:"), "l_suppkey").alias("src"), F.concat(F.lit("part:"), "l_partkey").alias("dst"))
