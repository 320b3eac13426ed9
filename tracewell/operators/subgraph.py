"""Subgraphs: induced, and with edges that stand for paths through removed nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions import schema, storage

_EDGE = ["src", "dst", "edge_type", "edge_rank", "collapsed_through"]


def induced(nodes: DataFrame, edges: DataFrame, keep: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) whose ends are all in keep (one column, node)."""
    ids = keep.select("node").distinct()
    kept = nodes.join(ids.withColumnRenamed("node", "unique_id"), "unique_id", "left_semi")
    e = edges.join(ids.withColumnRenamed("node", "src"), "src", "left_semi").join(ids.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return kept, e.select(*_EDGE)


def transitive(nodes: DataFrame, edges: DataFrame, keep: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As induced, and an edge for each pair of kept nodes that only removed nodes connect.

    collapsed_through counts the removed nodes on the shortest such path; its type is the most specialised one on that
    path, and on equally short paths the most specialised of theirs. Pairs with an edge of their own get no other.
    """
    spark = edges.sparkSession
    ids = storage.stored(keep.select("node").distinct(), "kept")
    kept, direct = induced(nodes, edges, ids)
    kept_dst, kept_src = ids.withColumnRenamed("node", "dst"), ids.withColumnRenamed("node", "src")
    inner = storage.stored(edges.join(kept_src, "src", "left_anti").select(F.col("src").alias("cur"), F.col("dst").alias("next"), F.col("edge_rank").alias("r")), "from-removed")
    seed = edges.join(kept_src, "src", "left_semi").join(kept_dst, "dst", "left_anti")
    seed = seed.groupBy(F.col("src").alias("start"), F.col("dst").alias("cur")).agg(F.max("edge_rank").alias("rank"))
    walked = storage.Levels(spark, "start string, cur string, rank int, through int", "walked")
    arrived = storage.Levels(spark, "start string, dst string, rank int, through int", "arrived")
    front, n = walked.add(seed.select("start", "cur", "rank", F.lit(1).alias("through")))
    at = 1
    while n:
        step = storage.stored(inner.join(storage.small(front, n), "cur").groupBy("start", "next").agg(F.max(F.greatest("rank", "r")).alias("rank")), "step")
        arrived.add(step.join(ids.withColumnRenamed("node", "next"), "next", "left_semi").select("start", F.col("next").alias("dst"), "rank", F.lit(at).alias("through")))
        go = step.join(ids.withColumnRenamed("node", "next"), "next", "left_anti").select("start", F.col("next").alias("cur"), "rank")
        at += 1
        go = go.join(walked.all().select("start", "cur"), ["start", "cur"], "left_anti")
        front, n = walked.add(go.select("start", "cur", "rank", F.lit(at).alias("through")))
    best = arrived.all().where("start <> dst").groupBy("start", "dst").agg(F.min(F.struct("through", (-F.col("rank")).alias("r"))).alias("b"))
    best = best.select(F.col("start").alias("src"), "dst", (-F.col("b.r")).alias("edge_rank"), F.col("b.through").alias("collapsed_through"))
    best = best.join(direct.select("src", "dst").distinct(), ["src", "dst"], "left_anti").withColumn("edge_type", schema.edge_type("edge_rank"))
    return kept, direct.select(*_EDGE).unionByName(best.select(*_EDGE))


def by_type(nodes: DataFrame, edges: DataFrame, kinds: list[str] | None = None, through: bool = True) -> tuple[DataFrame, DataFrame]:
    """Only nodes of these kinds (any case; by default all but phantoms), with or without edges through the others."""
    wanted = [k.lower() for k in (kinds if kinds is not None else schema.OUTPUT_KINDS)]
    keep = nodes.where(F.lower("node_type").isin(wanted)).select(F.col("unique_id").alias("node"))
    return (transitive if through else induced)(nodes, edges, keep)


def endpoints(nodes: DataFrame, edges: DataFrame, preserve: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Only nodes with nothing before or nothing after them, and those in preserve, with edges through the others."""
    ids = nodes.select(F.col("unique_id").alias("node"))
    inside = edges.select(F.col("src").alias("node")).distinct().join(edges.select(F.col("dst").alias("node")).distinct(), "node", "left_semi")
    keep = ids.join(inside, "node", "left_anti")
    return transitive(nodes, edges, keep.union(preserve.select("node")) if preserve is not None else keep)


def focal(nodes: DataFrame, edges: DataFrame, focus: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Only sources, exposures and the focus, with edges through the others."""
    keep = nodes.where(F.col("node_type").isin("source", "exposure")).select(F.col("unique_id").alias("node"))
    return transitive(nodes, edges, keep.union(focus.select("node")) if focus is not None else keep)
