"""The table of contents of a graph: capabilities, and modules with packages, types and members, few to a branch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.model import Graph, repository_types
from loomgraph.operators.architecture import packages
from loomgraph.operators.tree import FAN_OUT, grouped, top_members
from loomgraph.store import cut

ROOT = "index:root"
LEAVES = {"ENDPOINT": "ENDPOINT", "TOPIC": "TOPIC", "DATABASE_TABLE": "TABLE", "ENTITY": "TYPE"}


def derive(g: Graph, fan_out: int = FAN_OUT, members: int = FAN_OUT) -> tuple[DataFrame, DataFrame]:
    """(nodes (id, kind, name, graph_ids, facts), links (parent, child, ord)). A module with one package shows its
    types at once; types without a module stand under the repository's."""
    known, every = entries(g, members)
    tree = cut(grouped(every.distinct().withColumn("ord", F.col("child")), fan_out), "tree")
    groups = tree.where("child like 'group/%'").select("child", "name").distinct()
    known = known.unionByName(_plain(groups, F.col("child"), "GROUP", F.col("name")))
    return known.dropDuplicates(["id"]), tree.select("parent", "child", "ord").distinct()


def _plain(df: DataFrame, i, kind: str, name) -> DataFrame:
    return df.select(i.alias("id"), F.lit(kind).alias("kind"), name.alias("name"), F.array().cast("array<string>").alias("graph_ids"), F.create_map().cast("map<string,string>").alias("facts"))


def entries(g: Graph, members: int = FAN_OUT) -> tuple[DataFrame, DataFrame]:
    """(nodes, links (parent, child, name)) of the table of contents before groups make it narrow."""
    n = g.nodes.select("id", "kind", "name", "attributes", "file", "line")
    facts = F.map_concat(F.coalesce("attributes", F.create_map().cast("map<string,string>")), F.create_map(F.lit("declaredAt"), F.concat_ws(":", "file", F.col("line").cast("string"))))

    def as_index(df, kind):
        return df.select(F.concat(F.lit("index:"), "id").alias("id"), kind.alias("kind"), "name", F.array("id").alias("graph_ids"), facts.alias("facts"))

    part = g.edges.where("kind = 'PARTICIPATES_IN' and src like 'capability:%'").select("src", "dst").distinct()
    leaf_kind = F.create_map(*[F.lit(x) for kv in LEAVES.items() for x in kv])[F.col("kind")]
    leaves = n.where(F.col("kind").isin(*LEAVES)).join(part.select(F.col("dst").alias("id")).distinct(), "id", "left_semi")
    under_capability = part.join(leaves.select(F.col("id").alias("dst"), "name"), "dst").select(F.concat(F.lit("index:"), "src").alias("parent"), F.concat(F.lit("index:"), "dst").alias("child"), "name")

    types = repository_types(g).select("id", "kind", "name", "attributes", "file", "line")
    held = g.edges.where("kind = 'CONTAINS' and src like 'module:%'").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("module"))
    placed = cut(types.join(held, "id", "left").join(packages(g).withColumnRenamed("type", "id"), "id", "left").select("id", "name", F.coalesce("module", F.lit("module:<repository>")).alias("module"), F.coalesce("package", F.lit("<default>")).alias("package")), "placed")
    several = placed.groupBy("module").agg(F.countDistinct("package").alias("n")).where("n > 1").select("module")
    split = placed.join(several, "module", "left_semi")
    package_id = F.concat_ws("/", F.concat(F.lit("index:"), "module"), "package")
    index = lambda c: F.concat(F.lit("index:"), c)
    links = [
        under_capability,
        split.select(index("module").alias("parent"), package_id.alias("child"), F.col("package").alias("name")).distinct(),
        split.select(package_id.alias("parent"), index("id").alias("child"), "name"),
        placed.join(several, "module", "left_anti").select(index("module").alias("parent"), index("id").alias("child"), "name"),
    ]
    methods = g.nodes.where("kind = 'METHOD'").select("id", F.substring_index("id", "#", 1).alias("owner")).join(types.select(F.col("id").alias("owner")), "owner", "left_semi")
    chosen = cut(top_members(methods, g.edges, members), "members")
    own = chosen.join(n.select("id", "name"), "id")
    links.append(own.select(index("owner").alias("parent"), index("id").alias("child"), "name"))
    capabilities = n.where("kind = 'BUSINESS_CAPABILITY'")
    modules = placed.select(F.col("module").alias("id")).distinct()
    links.append(capabilities.select(F.lit(ROOT).alias("parent"), index("id").alias("child"), "name"))
    links.append(modules.select(F.lit(ROOT).alias("parent"), index("id").alias("child"), F.col("id").alias("name")))
    every = links[0]
    for x in links[1:]:
        every = every.unionByName(x)

    known = as_index(capabilities, F.lit("CAPABILITY")).unionByName(as_index(types, F.lit("TYPE"))).unionByName(as_index(n.join(chosen.select("id"), "id", "left_semi"), F.lit("MEMBER")))
    known = known.unionByName(as_index(leaves.join(types.select("id"), "id", "left_anti"), leaf_kind))
    named = modules.join(n.select("id", "name", "attributes", "file", "line"), "id", "left").withColumn("name", F.coalesce("name", F.substring_index("id", ":", -1)))
    known = known.unionByName(as_index(named, F.lit("MODULE"))).unionByName(_plain(split.select("module", "package").distinct(), package_id, "PACKAGE", F.col("package")))
    root = g.spark.createDataFrame([(ROOT,)], "id string")
    known = known.unionByName(_plain(root, F.col("id"), "ROOT", F.lit("repository")))
    return known, every


def statistics(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("entries"))
