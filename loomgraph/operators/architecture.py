"""Modules, coupling, workflows and capabilities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import text as X
from loomgraph.model import EDGE_COLUMNS, EFFECTS, FORWARD, NODE_COLUMNS, Graph, owner, repository_types
from loomgraph.operators.traverse import reach
from loomgraph.store import cut, is_empty

WORKFLOW_DEPTH = 8


def declaring_files(g: Graph, types: DataFrame | None = None) -> DataFrame:
    """(type, file): the file that holds each type (types: those of the graph, written), up through enclosing types (16 at
    most). Nearly all types stand in a file directly, and only the others are traversed from."""
    up = g.edges.where("kind = 'DECLARES'").select(F.col("dst").alias("at"), F.col("src").alias("to"))
    types = (types if types is not None else repository_types(g)).select(F.col("id").alias("type"))
    direct = cut(up.where("to like 'file:%'").groupBy(F.col("at").alias("type")).agg(F.min("to").alias("file")).join(types, "type", "left_semi"), "held")
    inner = cut(types.join(direct, "type", "left_anti"), "inner")
    if is_empty(inner):
        return direct
    found = reach(inner.select(F.col("type").alias("seed"), F.col("type").alias("id")), up, 17)
    w = Window.partitionBy("seed").orderBy("depth", "id")
    far = found.where("id like 'file:%'").withColumn("_n", F.row_number().over(w)).where("_n = 1").select(F.col("seed").alias("type"), F.col("id").alias("file"))
    return direct.unionByName(far)


def packages(g: Graph, types: DataFrame | None = None) -> DataFrame:
    """(type, package): what the declaring file declares, else the lower-case beginning of the name. types: those of the
    graph, written."""
    types = types if types is not None else cut(repository_types(g).select("id", "name"), "types")
    of_file = g.edges.where("kind = 'DECLARES' and src like 'file:%' and dst like 'package:%'").groupBy(F.col("src").alias("file")).agg(F.max(F.substring_index("dst", ":", -1)).alias("package"))
    known = declaring_files(g, types).join(of_file, "file").select("type", "package")
    return types.select(F.col("id").alias("type"), "name").join(known, "type", "left").select("type", F.coalesce("package", X.package_from_name(F.col("name"))).alias("package"))


def modules(g: Graph) -> DataFrame:
    """(type, module): the source root if there are several, else the package."""
    file = F.col("file")
    root = F.when(F.instr(file, "/src/") > 1, F.substring_index(file, "/src/", 1)).otherwise(F.lit("<root>"))
    types = cut(repository_types(g).select("id", "name", root.alias("root")), "types")
    many = types.agg(F.countDistinct("root")).first()[0] > 1
    return types.select(F.col("id").alias("type"), F.col("root").alias("module")) if many else packages(g, types).select("type", F.col("package").alias("module"))


def coupling(edges: DataFrame, module_of: DataFrame) -> DataFrame:
    """(src, dst, weight): references between different modules; edges (src, dst) of ids, module_of (type, module)."""
    e = edges.select(owner("src").alias("s"), owner("dst").alias("d"))
    e = e.join(module_of.select(F.col("type").alias("s"), F.col("module").alias("src")), "s").join(module_of.select(F.col("type").alias("d"), F.col("module").alias("dst")), "d")
    return e.where("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))


def detect_modules(g: Graph) -> Graph:
    """The graph with its MODULE nodes, what they contain, and their weighted dependencies."""
    of = cut(modules(g), "modules")
    pairs = cut(coupling(g.edges.where("kind in ('CALLS', 'DEPENDS_ON')"), of), "coupling")
    out = pairs.groupBy(F.col("src").alias("module")).agg(F.sum("weight").alias("efferent"))
    n = of.groupBy("module").agg(F.count(F.lit(1)).alias("types")).join(out, "module", "left")
    attributes = F.create_map(F.lit("types"), F.col("types").cast("string"), F.lit("efferentCoupling"), F.coalesce("efferent", F.lit(0)).cast("string"))
    nodes = _nodes(n, F.concat(F.lit("module:"), "module"), "MODULE", F.col("module"), attributes, "module-detector", 1.0)
    holds = _edges(of, F.concat(F.lit("module:"), "module"), F.col("type"), "CONTAINS", F.create_map(F.lit("resolution"), F.lit("module-layout")), "module-detector", 1.0)
    weight = F.create_map(F.lit("weight"), F.col("weight").cast("string"), F.lit("resolution"), F.lit("module-coupling"))
    depends = _edges(pairs, F.concat(F.lit("module:"), "src"), F.concat(F.lit("module:"), "dst"), "DEPENDS_ON", weight, "module-detector", 1.0)
    return added(g, nodes, holds.unionByName(depends))


def workflows(g: Graph, depth: int = WORKFLOW_DEPTH) -> DataFrame:
    """(workflow, entry, id, role): what each endpoint or topic leads to. Steps are methods reached forwards; a
    topic starts at its listeners; effects are those of every step, and of its type. All entries in one run."""
    entries = g.nodes.where("kind in ('ENDPOINT', 'TOPIC')").select(F.col("id").alias("seed"), "id", "kind")
    listeners = g.edges.where("kind = 'CONSUMES'").select(F.col("dst").alias("id"), F.col("src").alias("listener"))
    heard = entries.where("kind = 'TOPIC'").join(listeners, "id").select("seed", F.col("listener").alias("id"))
    forward = g.edges.where(F.col("kind").isin(*FORWARD)).select(F.col("src").alias("at"), F.col("dst").alias("to"))
    methods = g.nodes.where("kind = 'METHOD'").select("id")
    found = cut(reach(entries.select("seed", "id").union(heard), forward, depth, known=methods).select("seed", "id").distinct(), "workflow")
    effects = g.edges.where(F.col("kind").isin(*EFFECTS)).select("src", "dst").distinct()
    sources = found.select("seed", F.col("id").alias("src")).union(found.select("seed", owner("id"))).distinct()
    touched = sources.join(effects, "src").select("seed", F.col("dst").alias("id"), F.lit("effect").alias("role")).distinct()
    steps = found.where("seed <> id").select("seed", "id", F.lit("step").alias("role"))
    rows = steps.union(touched)
    alive = rows.select("seed").distinct()
    rows = rows.union(alive.select("seed", F.col("seed").alias("id"), F.lit("entry-point").alias("role")))
    return rows.select(F.concat(F.lit("workflow:"), "seed").alias("workflow"), F.col("seed").alias("entry"), "id", "role")


def detect_workflows(g: Graph, depth: int = WORKFLOW_DEPTH) -> Graph:
    rows = cut(workflows(g, depth), "workflows")
    steps = rows.groupBy("workflow", "entry").agg(F.sum((F.col("role") == "step").cast("int")).alias("steps"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("role") == "effect", F.col("id")))), ",").alias("touches"))
    names = g.nodes.select(F.col("id").alias("entry"), "name")
    attributes = F.create_map(F.lit("entryPoint"), F.col("entry"), F.lit("steps"), F.col("steps").cast("string"), F.lit("touches"), F.col("touches"))
    nodes = _nodes(steps.join(names, "entry"), F.col("workflow"), "WORKFLOW", F.col("name"), attributes, "workflow-discovery", 0.9)
    edges = _edges(rows, F.col("workflow"), F.col("id"), "PARTICIPATES_IN", F.create_map(F.lit("role"), F.col("role")), "workflow-discovery", 0.9)
    return added(g, nodes, edges)


def capabilities(g: Graph) -> DataFrame:
    """(capability, id, role): entry points by the first telling segment of their route or topic, and the tables,
    entities and topics that their workflows touch."""
    name = F.when(F.col("kind") == "ENDPOINT", X.capability_of_path(F.coalesce(F.col("attributes")["path"], F.lit("")))).otherwise(X.capability_of_topic(F.col("name")))
    entries = g.nodes.where("kind in ('ENDPOINT', 'TOPIC')").select("id", name.alias("capability")).where("capability is not null")
    effects = g.edges.where("kind = 'PARTICIPATES_IN'").where(F.col("attributes")["role"] == "effect").select("src", "dst")
    data = g.nodes.where("kind in ('DATABASE_TABLE', 'ENTITY', 'TOPIC')").select(F.col("id").alias("dst"))
    touched = entries.join(effects, F.concat(F.lit("workflow:"), entries["id"]) == effects["src"]).join(data, "dst", "left_semi").select("capability", F.col("dst").alias("id"), F.lit("entity").alias("role"))
    return entries.select("capability", "id", F.lit("entry-point").alias("role")).union(touched.distinct())


def detect_capabilities(g: Graph) -> Graph:
    rows = cut(capabilities(g), "capabilities")
    n = rows.groupBy("capability").agg(F.sum((F.col("role") == "entry-point").cast("int")).alias("entries"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("role") == "entity", F.col("id")))), ",").alias("entities"))
    attributes = F.create_map(F.lit("entryPoints"), F.col("entries").cast("string"), F.lit("entities"), F.col("entities"))
    nodes = _nodes(n, F.concat(F.lit("capability:"), "capability"), "BUSINESS_CAPABILITY", F.col("capability"), attributes, "capability-detector", 0.85)
    edges = _edges(rows, F.concat(F.lit("capability:"), "capability"), F.col("id"), "PARTICIPATES_IN", F.create_map(F.lit("role"), F.col("role")), "capability-detector", 0.85)
    return added(g, nodes, edges)


def _place(resolver: str, confidence: float):
    return [F.lit(resolver).alias("resolver"), F.lit(confidence).alias("confidence"), F.lit("").alias("file"), F.lit(0).alias("line"), F.lit(0).alias("col")]


def _nodes(df, node_id, kind, name, attributes, resolver, confidence) -> DataFrame:
    return df.select(node_id.alias("id"), F.lit(kind).alias("kind"), name.alias("name"), attributes.alias("attributes"), *_place(resolver, confidence), F.xxhash64(node_id).alias("seq")).select(*NODE_COLUMNS)


def _edges(df, src, dst, kind, attributes, resolver, confidence) -> DataFrame:
    return df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("kind"), attributes.alias("attributes"), *_place(resolver, confidence), F.xxhash64(src, dst, F.lit(kind)).alias("seq")).select(*EDGE_COLUMNS)


def added(g: Graph, nodes: DataFrame, edges: DataFrame) -> Graph:
    """g with a layer: its nodes, which are written, replace those of the same id, its edges are added. What is there
    already is not written again."""
    nodes = cut(nodes, "layer")
    kept = g.nodes.join(nodes.select("id"), "id", "left_anti").select(*NODE_COLUMNS)
    return Graph(kept.unionByName(nodes), g.edges.select(*EDGE_COLUMNS).unionByName(edges))
