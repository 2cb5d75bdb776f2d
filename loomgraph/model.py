"""The property graph: two DataFrames whose every row says where it comes from.

nodes: id, kind, name, attributes, resolver, confidence, file, line, col, seq
edges: src, dst, kind, attributes, resolver, confidence, file, line, col, seq
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_VERSION, TREE_VERSION = "0.3", "0.1"

# The kinds of nodes and of relations.
ENTITY_KINDS = (
    "REPOSITORY", "FILE", "PACKAGE", "TYPE", "INTERFACE", "METHOD", "FIELD", "CONTROLLER", "SERVICE", "REPOSITORY_COMPONENT",
    "ENTITY", "CONFIGURATION", "ENDPOINT", "TOPIC", "DATABASE_TABLE", "TRANSACTION", "WORKFLOW", "BUSINESS_CAPABILITY",
    "SECURITY_GUARD", "EXTERNAL_SERVICE", "CONFIGURATION_PROPERTY", "MODULE", "EXTERNAL_SYMBOL",
)
RELATION_KINDS = (
    "CONTAINS", "DECLARES", "IMPORTS", "EXTENDS", "IMPLEMENTS", "OVERRIDES", "CALLS", "READS", "WRITES", "CREATES", "THROWS",
    "CATCHES", "EXPOSES", "PERSISTS", "PUBLISHES", "CONSUMES", "CONFIGURES", "PARTICIPATES_IN", "DEPENDS_ON",
)
# Relations that carry an impact backwards, that make structure, and that are effects.
IMPACT_RELATIONS = (
    "CALLS", "CREATES", "IMPORTS", "EXTENDS", "IMPLEMENTS", "OVERRIDES", "EXPOSES", "PERSISTS", "PUBLISHES", "CONSUMES",
    "CONFIGURES", "DEPENDS_ON", "PARTICIPATES_IN",
)
STRUCTURAL = ("CALLS", "DEPENDS_ON", "EXTENDS", "IMPLEMENTS", "OVERRIDES")
EFFECTS = ("PERSISTS", "PUBLISHES", "CONSUMES", "WRITES")
FORWARD = ("CALLS", "EXPOSES", "DECLARES")

_WHERE = "resolver string, confidence double, file string, line int, col int, seq long"
NODE_SCHEMA = f"id string, kind string, name string, attributes map<string,string>, {_WHERE}"
EDGE_SCHEMA = f"src string, dst string, kind string, attributes map<string,string>, {_WHERE}"
NODE_COLUMNS = ["id", "kind", "name", "attributes", "resolver", "confidence", "file", "line", "col", "seq"]
EDGE_COLUMNS = ["src", "dst", "kind", "attributes", "resolver", "confidence", "file", "line", "col", "seq"]


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame

    @property
    def spark(self):
        return self.nodes.sparkSession


def owner(node_id: Column | str) -> Column:
    """The type that a member id belongs to: what stands before `#`, else before `.field:`, else the id."""
    c = F.col(node_id) if isinstance(node_id, str) else node_id
    return (
        F.when(F.instr(c, "#") > 1, F.substring_index(c, "#", 1))
        .when(F.instr(c, ".field:") > 1, F.substring_index(c, ".field:", 1))
        .otherwise(c)
    )


def canonical(attributes: Column | str) -> Column:
    """A map as JSON with its keys in order: maps can't be compared, grouped or hashed."""
    entries = F.map_entries(attributes)
    return F.to_json(F.map_from_entries(F.array_sort(entries)))


def upsert_nodes(emissions: DataFrame, *order: str) -> DataFrame:
    """One row an id from emissions with `declared` (boolean): the last declaration if there is one, else the
    first reference that isn't external, else the first reference. order is a total order of emissions."""
    rank = F.when(F.col("declared"), 0).when(F.col("kind") != "EXTERNAL_SYMBOL", 1).otherwise(2)
    late = Window.partitionBy("id").orderBy(*[F.col(c).desc() for c in order])
    early = Window.partitionBy("id").orderBy(*order)
    ranked = emissions.withColumn("_rank", rank).withColumn("_best", F.min(rank).over(Window.partitionBy("id"))).where("_rank = _best")
    ranked = ranked.withColumn("_n", F.when(F.col("declared"), F.row_number().over(late)).otherwise(F.row_number().over(early)))
    return ranked.where("_n = 1").drop("_rank", "_best", "_n")


def dedup_edges(edges: DataFrame, *order: str) -> DataFrame:
    """The first edge (in the given total order) of each (src, dst, kind, file, line, col)."""
    w = Window.partitionBy("src", "dst", "kind", "file", "line", "col").orderBy(*order)
    return edges.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


#: Ids of types, without those of their members.
TYPE_ID = "id like 'type:%' and instr(id, '#') = 0 and instr(id, '.field:') = 0"


def repository_types(g: Graph) -> DataFrame:
    """Nodes of types declared here: an id of `type:` without member part, not external, that something declares."""
    declared = g.edges.where("kind = 'DECLARES'").select(F.col("dst").alias("id"))
    own = g.nodes.where("id like 'type:%' and instr(id, '#') = 0 and instr(id, '.field:') = 0 and kind <> 'EXTERNAL_SYMBOL'")
    return own.join(declared, "id", "left_semi")


OPERATIONAL = (
    "ENDPOINT", "TOPIC", "DATABASE_TABLE", "WORKFLOW", "BUSINESS_CAPABILITY", "SECURITY_GUARD", "EXTERNAL_SERVICE",
    "CONFIGURATION_PROPERTY", "MODULE",
)


def declared_here(g: Graph) -> DataFrame:
    """Operational nodes, and nodes that something declares or contains."""
    held = g.edges.where("kind in ('DECLARES', 'CONTAINS')").select(F.col("dst").alias("id"))
    return g.nodes.where(F.col("kind").isin(*OPERATIONAL)).unionByName(g.nodes.where(~F.col("kind").isin(*OPERATIONAL)).join(held, "id", "left_semi"))


def lifted(g: Graph, kinds: tuple[str, ...] = STRUCTURAL, types: DataFrame | None = None) -> DataFrame:
    """Structural edges between owning types (src, dst), parallel ones kept, loops and foreign ends dropped."""
    ids = (types if types is not None else repository_types(g)).select("id")
    e = g.edges.where(F.col("kind").isin(*kinds)).select(owner("src").alias("src"), owner("dst").alias("dst")).where("src <> dst")
    return e.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")


def scope(g: Graph, kinds: list[str]) -> Graph:
    """The subgraph of nodes of the kinds, with edges that keep both ends."""
    nodes = g.nodes.where(F.col("kind").isin(*kinds))
    return induced(g, nodes)


def induced(g: Graph, nodes: DataFrame) -> Graph:
    ids = nodes.select("id")
    edges = g.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return Graph(nodes, edges.select(*g.edges.columns))


def node_type() -> T.StructType:
    return T._parse_datatype_string(NODE_SCHEMA)


def edge_type() -> T.StructType:
    return T._parse_datatype_string(EDGE_SCHEMA)
