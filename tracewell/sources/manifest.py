"""A compiled project manifest (JSON) as DataFrames of nodes, edges and models."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import schema

_COLUMNS = "map<string,struct<name:string,quote:boolean>>"
_DEPENDS = "struct<nodes:array<string>>"
_NODE = f"struct<unique_id:string,name:string,alias:string,package_name:string,resource_type:string,description:string,original_file_path:string,path:string,database:string,schema:string,relation_name:string,compiled_code:string,depends_on:{_DEPENDS},config:struct<materialized:string,tags:array<string>>,columns:{_COLUMNS}>"
_SOURCE = f"struct<unique_id:string,name:string,source_name:string,identifier:string,package_name:string,description:string,original_file_path:string,path:string,database:string,schema:string,relation_name:string,tags:array<string>,columns:{_COLUMNS}>"
_EXPOSURE = f"struct<unique_id:string,name:string,label:string,type:string,url:string,maturity:string,description:string,original_file_path:string,path:string,owner:struct<name:string,email:string>,depends_on:{_DEPENDS},tags:array<string>>"
_SEMANTIC = f"struct<unique_id:string,name:string,label:string,description:string,original_file_path:string,path:string,depends_on:{_DEPENDS}>"
#: Maps, so that every project has the same schema; unknown keys are passed over.
MANIFEST = f"metadata struct<project_name:string,adapter_type:string,dbt_schema_version:string,dbt_version:string>, nodes map<string,{_NODE}>, sources map<string,{_SOURCE}>, exposures map<string,{_EXPOSURE}>, semantic_models map<string,{_SEMANTIC}>, metrics map<string,{_SEMANTIC}>, saved_queries map<string,{_SEMANTIC}>"
KINDS = ("model", "seed", "snapshot", "test")


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row for each manifest file at the path."""
    return spark.read.schema(MANIFEST).json(path, multiLine=True)


def _each(m: DataFrame, what: str) -> DataFrame:
    return m.select(F.explode(what).alias("uid", "n"))


def _tail(uid: str = "uid") -> F.Column:
    """The id without its kind and project."""
    return F.regexp_replace(uid, r"^[^.]+\.[^.]+\.", "")


def nodes(m: DataFrame) -> DataFrame:
    """Nodes of all kinds; rows of unknown kinds are left out. The project-free id stays as an alias."""
    empty = F.array().cast("array<string>")
    alias = F.array(F.regexp_replace("uid", r"^([^.]+)\.[^.]+\.", "$1."))
    none = F.lit(None).cast(schema.EXPOSURE)
    path = F.coalesce("n.original_file_path", "n.path")

    def row(df: DataFrame, label, kind, materialized=None, tags=None, columns=None, exposure=None) -> DataFrame:
        null = F.lit(None).cast("string")
        return df.select(F.col("uid").alias("unique_id"), label.alias("label"), kind.alias("node_type"), path.alias("file_path"), F.col("n.description").alias("description"), (materialized if materialized is not None else null).alias("materialization"), F.coalesce(tags if tags is not None else empty, empty).alias("tags"), F.coalesce(columns if columns is not None else empty, empty).alias("columns"), alias.alias("aliases"), (exposure if exposure is not None else none).alias("exposure"))

    names = F.map_keys("n.columns")
    out = row(_each(m, "nodes").where(F.col("n.resource_type").isin(*KINDS)), F.col("n.name"), F.col("n.resource_type"), F.col("n.config.materialized"), F.col("n.config.tags"), names)
    out = out.unionByName(row(_each(m, "sources"), F.concat_ws(".", "n.source_name", "n.name"), F.lit("source"), None, F.col("n.tags"), names))
    exposure = F.struct(F.coalesce("n.label", "n.name").alias("label"), F.col("n.type").alias("exposure_type"), F.col("n.url").alias("url"), F.col("n.maturity").alias("maturity"), F.col("n.owner").alias("owner")).cast(schema.EXPOSURE)
    out = out.unionByName(row(_each(m, "exposures"), F.col("n.name"), F.lit("exposure"), None, F.col("n.tags"), None, exposure))
    for what, kind in (("semantic_models", "semantic_model"), ("metrics", "metric"), ("saved_queries", "saved_query")):
        out = out.unionByName(row(_each(m, what), F.col("n.name"), F.lit(kind)))
    return out


def edges(m: DataFrame) -> DataFrame:
    """Edges from depends_on; those to nodes that aren't there are dropped. A test's edges are test edges, an exposure's
    exposure edges, others by the kind of what they start from. Repeats are kept: the graph is a multigraph."""
    dep = lambda what: _each(m, what).select(F.explode("n.depends_on.nodes").alias("src"), F.col("uid").alias("dst"))
    e = dep("nodes")
    for what in ("exposures", "semantic_models", "metrics", "saved_queries"):
        e = e.unionByName(dep(what))
    kinds = nodes(m).select("unique_id", "node_type")
    e = e.join(kinds.select(F.col("unique_id").alias("src")), "src", "left_semi").join(kinds.select(F.col("unique_id").alias("dst"), "node_type"), "dst")
    kind = F.when(F.col("node_type") == "test", "test").when(F.col("node_type") == "exposure", "exposure").when(F.col("src").startswith("source."), "source").otherwise("ref")
    return e.select("src", "dst", kind.alias("edge_type")).withColumn("edge_rank", schema.edge_rank("edge_type")).withColumn("collapsed_through", F.lit(None).cast("int"))


def models(m: DataFrame) -> DataFrame:
    """(uid, kind, relation, columns, sql, depends_on) of everything that has columns: models, seeds, snapshots, sources."""
    parts = lambda name: F.filter(F.array("n.database", "n.schema", name), lambda x: x.isNotNull() & (x != ""))
    n = _each(m, "nodes").where(F.col("n.resource_type").isin("model", "seed", "snapshot"))
    a = n.select("uid", F.col("n.resource_type").alias("kind"), parts(F.coalesce("n.alias", "n.name")).alias("relation"), F.coalesce(F.map_keys("n.columns"), F.array().cast("array<string>")).alias("columns"), F.col("n.compiled_code").alias("sql"), F.coalesce("n.depends_on.nodes", F.array().cast("array<string>")).alias("depends_on"))
    b = _each(m, "sources").select("uid", F.lit("source").alias("kind"), parts(F.coalesce("n.identifier", "n.name")).alias("relation"), F.coalesce(F.map_keys("n.columns"), F.array().cast("array<string>")).alias("columns"), F.lit(None).cast("string").alias("sql"), F.array().cast("array<string>").alias("depends_on"))
    return a.unionByName(b)


#: The kinds of node, the sections a manifest has, and the newest schema that is known.
SECTIONS = {"nodes": {"model", "seed", "snapshot", "test", "analysis", "operation", "sql_operation", "rpc", "unit_test"}, "sources": {"source"}, "exposures": {"exposure"}, "semantic_models": {"semantic_model"}, "metrics": {"metric"}, "saved_queries": {"saved_query"}}
NEWEST = 12


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of each manifest file at the path."""
    return spark.read.format("binaryFile").load(path).select("path", F.decode("content", "UTF-8").alias("text"))


def diagnostics(texts: DataFrame) -> DataFrame:
    """(path, level, what, why, hint) of manifests (path, text): unreadable JSON and a missing section are errors; a newer
    schema, kinds that aren't known, entries without an id and dependencies that aren't there are warnings."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, *x) for p, t in zip(b["path"], b["text"], strict=True) for x in _diagnosed(t)]
            yield pd.DataFrame(rows, columns=["path", "level", "what", "why", "hint"])

    return texts.mapInPandas(run, "path string, level string, what string, why string, hint string")


def _diagnosed(text: str) -> list[tuple[str, str, str, str]]:
    try:
        m = json.loads(text)
    except ValueError as e:
        return [("error", "manifest", f"not JSON: {e}", "compile the project again")]
    if not isinstance(m, dict):
        return [("error", "manifest", "not an object", "compile the project again")]
    out = []
    version = re.search(r"/v(\d+)\.json", str((m.get("metadata") or {}).get("dbt_schema_version", "")))
    if version and int(version[1]) > NEWEST:
        out.append(("warning", "metadata", f"schema v{version[1]} is newer than v{NEWEST}", "fields that are not known are passed over"))
    ids = {k for s in SECTIONS for k in (m.get(s) or {})}
    for section, kinds in SECTIONS.items():
        if section in ("nodes", "sources") and section not in m:
            out.append(("error", section, "missing", "compile the project again"))
        for uid, n in (m.get(section) or {}).items():
            if not isinstance(n, dict):
                out.append(("warning", uid, "not an object", "the entry is left out"))
                continue
            kind = n.get("resource_type", uid.split(".")[0])
            if kind not in kinds:
                out.append(("warning", uid, f"unknown kind {kind}", "the entry is left out"))
            if "name" not in n:
                out.append(("warning", uid, "no name", "the entry is shown by its id"))
            out += [("warning", uid, f"depends on {d}, which isn't there", "the edge is left out") for d in (n.get("depends_on") or {}).get("nodes") or [] if d not in ids]
    return out


def strict(spark: SparkSession, path: str) -> DataFrame:
    """The manifest as `read` gives it; ValueError for anything diagnostics finds."""
    found = diagnostics(read_text(spark, path)).limit(20).collect()
    if found:
        raise ValueError("; ".join(f"{r.what}: {r.why}" for r in found))
    return read(spark, path)
