"""The entry point for users: a project's graph and columns behind one object."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import storage
from tracewell.operators import closure, columns, gaps, impact, select, subgraph
from tracewell.project import build, scan
from tracewell.sources import manifest


class LineageEngine:
    """nodes, edges and, where there is SQL, models; every method returns DataFrames."""

    def __init__(self, spark: SparkSession, nodes: DataFrame, edges: DataFrame, models: DataFrame | None = None, dialect: str | None = None) -> None:
        self.spark, self.nodes, self.edges, self.models, self.dialect = spark, nodes, edges, models, dialect
        self._slots: DataFrame | None = None

    @classmethod
    def from_manifest(cls, spark: SparkSession, path: str, dialect: str | None = None) -> LineageEngine:
        m = manifest.read(spark, path)
        adapter = m.select("metadata.adapter_type").first()
        return cls(spark, storage.stored(manifest.nodes(m), "nodes"), storage.stored(manifest.edges(m), "edges"), manifest.models(m), dialect or (adapter[0] if adapter else None))

    @classmethod
    def from_project(cls, spark: SparkSession, root: str, dialect: str | None = None) -> LineageEngine:
        """From a project's SQL and YAML files. Templates aren't rendered, so there are no models to trace columns in."""
        p = build.build(spark, scan.files(spark, root))
        e = cls(spark, p.nodes, p.edges, None, dialect)
        e.reasons = p.reasons
        return e

    def register(self) -> None:
        """Temporary views nodes, edges and, with models, slots."""
        self.nodes.createOrReplaceTempView("nodes")
        self.edges.createOrReplaceTempView("edges")
        if self.models is not None:
            self.slots().createOrReplaceTempView("slots")

    def ids(self, names: list[str]) -> DataFrame:
        """(node) for names that stand for a node; ValueError if none does."""
        found = select.lookup(self.nodes, self.spark.createDataFrame([(n,) for n in names], "name string")).select(F.col("unique_id").alias("node"))
        if not found.limit(1).count():
            raise ValueError(f"no node is called {', '.join(names)}")
        return found

    def graph(self, names: list[str] | None = None, up: int | None = None, down: int | None = None, selectors: str | None = None, kinds: list[str] | None = None, through: bool = True, collapse: str | None = None) -> tuple[DataFrame, DataFrame]:
        """The part around the names (all without any) that the selectors take, of the kinds wanted, collapsed to its endpoints or focal nodes; ValueError for a cycle."""
        if cycle := closure.find_cycle(self.edges):
            raise ValueError("the graph has a cycle: " + " -> ".join(cycle))
        focus = self.ids(names) if names else None
        keep = closure.window(self.edges, focus, up, down) if focus is not None else self.nodes.select(F.col("unique_id").alias("node"))
        if selectors:
            keep = keep.join(select.selected(self.nodes, selectors), "node", "left_semi")
        nodes, edges = subgraph.transitive(self.nodes, self.edges, keep) if through else subgraph.induced(self.nodes, self.edges, keep)
        nodes, edges = subgraph.by_type(nodes, edges, kinds, through)
        if collapse == "endpoints":
            return subgraph.endpoints(nodes, edges, focus)
        return subgraph.focal(nodes, edges, focus) if collapse == "focal" else (nodes, edges)

    def impact(self, name: str) -> DataFrame:
        return impact.impact(self.nodes, self.edges, self.ids([name]))

    def list(self, kinds: list[str] | None = None, patterns: list[str] | None = None) -> DataFrame:
        nodes = self.nodes if kinds is None else self.nodes.where(F.lower("node_type").isin([k.lower() for k in kinds]))
        return nodes.join(select.search(nodes, patterns).withColumnRenamed("node", "unique_id"), "unique_id", "left_semi") if patterns else nodes

    def summary(self) -> DataFrame:
        return select.summary(self.nodes, self.edges)

    def slots(self) -> DataFrame:
        if self._slots is None:
            self._slots = columns.slots(self.models, self.dialect)
        return self._slots

    def column_paths(self, model: str, names: list[str] | None = None, direction: str = "up") -> DataFrame:
        """(root, node, path, transform) of a model's columns, by id or short name; ValueError where it can't be told."""
        if self.models is None:
            raise ValueError("columns need a compiled manifest")
        hits = [r.uid for r in self.models.where((F.col("uid") == model) | F.col("uid").endswith("." + model)).select("uid").distinct().limit(10).collect()]
        hits = [model] if model in hits else hits
        if len(hits) != 1:
            raise ValueError(f"{model} stands for {len(hits)} models: {', '.join(sorted(hits))}")
        roots = self.slots().where((F.col("uid") == hits[0]) & F.col("key").isNotNull())
        roots = roots if not names else roots.where(F.lower("key").isin([n.lower() for n in names]))
        return gaps.paths(self.slots(), roots.select(columns.node().alias("node")).distinct(), direction)

    def column_upstream(self, uid: str, column: str | None = None) -> DataFrame:
        roots = self.slots().where((F.col("uid") == uid) & F.col("key").isNotNull())
        roots = roots if column is None else roots.where(F.lower("key") == column.lower())
        return columns.upstream(self.slots(), self.models, roots.select(columns.node().alias("node")))

    def column_downstream(self, uid: str, column: str) -> DataFrame:
        return columns.downstream(self.slots(), self.spark.createDataFrame([(f"{uid}#{column.lower()}",)], "node string"))
