"""A session over a source tree: what is published belongs together, and a change of the sources rebuilds it."""

from __future__ import annotations

import json
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.model import Graph
from loomgraph.plans.repository import Layers, build
from loomgraph.sources.java_source import source_files

OPEN_DESCENTS = 32


def sources_fingerprint(files: DataFrame) -> str:
    """SHA-256 over paths and contents in order of path, never over times; hashes by file, then in two levels."""
    h = files.select(F.sha2(F.concat_ws("\0", "path", F.sha2("text", 256)), 256).alias("h"), "path")
    parts = h.groupBy(F.substring(F.sha2("path", 256), 1, 3).alias("p")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "h"))), lambda x: x["h"]), ""), 256).alias("h"))
    return parts.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "h"))), lambda x: x["h"]), ""), 256)).first()[0]


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change) between two listings (path, hash)."""
    both = before.withColumnRenamed("hash", "was").join(after.withColumnRenamed("hash", "now"), "path", "full")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "changed")
    return both.select("path", change.alias("change")).where("change is not null")


@dataclass
class Session:
    """Graph and fingerprint are published together; indexes are made on first use and go with a rebuild."""

    spark: SparkSession
    root: str
    layers: Layers = Layers()
    graph: Graph | None = None
    fingerprint: str = ""
    derived: dict = field(default_factory=dict)
    descents: OrderedDict = field(default_factory=OrderedDict)

    def refresh(self) -> bool:
        """Rebuilds if the sources changed; whether it did. A failed build changes nothing."""
        now = sources_fingerprint(source_files(self.spark, self.root, self.layers.tests))
        if now == self.fingerprint:
            return False
        graph = build(self.spark, self.root, self.layers)
        self.graph, self.fingerprint, self.derived, self.descents = graph, now, {}, OrderedDict()
        return True

    def index(self, name: str, make: Callable[[Graph], object]):
        if self.graph is None:
            self.refresh()
        if name not in self.derived:
            self.derived[name] = make(self.graph)
        return self.derived[name]

    def open(self, key: str, navigation: Navigation) -> None:
        self.descents[key] = navigation
        self.descents.move_to_end(key)
        while len(self.descents) > OPEN_DESCENTS:
            self.descents.popitem(last=False)


@dataclass
class Navigation:
    """A descent that a reader steers: each step shows the children of the frontier, and only what was shown can
    be chosen. It is over when the frontier is empty."""

    question: str
    fingerprint: str
    frontier: list[str]
    anchors: list[str] = field(default_factory=list)
    visited: list[str] = field(default_factory=list)
    step: int = 0

    def presented(self, links: DataFrame, nodes: DataFrame) -> list[dict]:
        shown = links.where(F.col("parent").isin(*self.frontier)).select(F.col("child").alias("id")).distinct() if self.frontier else links.limit(0).select(F.col("child").alias("id"))
        return [r.asDict() for r in nodes.join(shown, "id").select("id", "kind", "name", "graph_ids").orderBy("id").collect()]

    def choose(self, ids: list[str], links: DataFrame, nodes: DataFrame) -> None:
        shown = {x["id"]: x for x in self.presented(links, nodes)}
        if strange := [i for i in ids if i not in shown]:
            raise ValueError(f"not shown: {', '.join(strange)}")
        inner = {r["parent"] for r in links.where(F.col("parent").isin(*ids)).select("parent").distinct().collect()} if ids else set()
        self.visited += self.frontier
        self.anchors += [g for i in ids if i not in inner for g in shown[i]["graph_ids"]]
        self.frontier = [i for i in ids if i in inner]
        self.step += 1

    @property
    def complete(self) -> bool:
        return not self.frontier

    def write(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            json.dump(self.__dict__, f, ensure_ascii=False, sort_keys=True)

    @classmethod
    def read(cls, path: str, fingerprint: str) -> Navigation:
        with open(path, encoding="utf-8") as f:
            found = cls(**json.load(f))
        if found.fingerprint != fingerprint:
            raise ValueError("the session belongs to another tree")
        return found
