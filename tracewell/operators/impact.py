"""What is affected when a node changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewell.functions import schema, storage
from tracewell.operators.closure import on_cycles, reach

#: Paths kept for each exposure: a report's limit.
PATHS = 10
#: Open paths from which on those that can't be wanted are dropped.
MANY = 1000


def severity() -> Column:
    """Rank of a node's severity: an exposure is critical, a test low, a built or mart model high, all else medium."""
    built = F.coalesce(F.col("materialization").isin("table", "incremental"), F.lit(False)) | F.coalesce(F.col("file_path").contains("mart"), F.lit(False))
    return F.when(F.col("node_type") == "exposure", 3).when(F.col("node_type") == "test", 0).when((F.col("node_type") == "model") & built, 2).otherwise(1)


def impact(nodes: DataFrame, edges: DataFrame, start: DataFrame) -> DataFrame:
    """(unique_id, label, node_type, file_path, distance, severity_rank, severity) of all nodes after the start, without it."""
    hit = reach(edges, start).where("distance > 0").withColumnRenamed("node", "unique_id")
    rows = nodes.join(hit, "unique_id").withColumn("severity_rank", severity())
    return rows.select("unique_id", "label", "node_type", "file_path", "distance", "severity_rank", schema.severity_label("severity_rank").alias("severity"))


def counts(rows: DataFrame) -> DataFrame:
    """One row: affected models, tests and exposures, and the worst severity ('low' where nothing is affected)."""
    n = lambda k: F.count(F.when(F.col("node_type") == k, 1))
    return rows.agg(n("model").alias("affected_models"), n("test").alias("affected_tests"), n("exposure").alias("affected_exposures"), schema.severity_label(F.coalesce(F.max("severity_rank"), F.lit(0))).alias("overall_severity"))


def ordered(rows: DataFrame, by_distance: bool = False) -> DataFrame:
    """Worst first, then nearest, then by id; or nearest first."""
    far, bad = F.col("distance"), F.col("severity_rank").desc()
    return rows.orderBy(*((far, bad) if by_distance else (bad, far)), "unique_id")


def exposure_paths(nodes: DataFrame, edges: DataFrame, start: DataFrame, most: int = PATHS) -> tuple[DataFrame, DataFrame]:
    """((exposure, path, rank), (exposure, truncated)): simple paths from the start to each exposure, shortest first, then
    by their text, `most` of each at most; truncated says that so many were reached.

    Paths only walk nodes from which an exposure can be reached, and end at it. Without cycles, whatever follows a node
    follows each path to it, so that of the paths of one length to a node only the first `most` can be wanted: the rest
    goes at once, and a layered graph keeps few. With cycles all simple paths are followed.
    """
    spark = edges.sparkSession
    goals = nodes.where("node_type = 'exposure'").select(F.col("unique_id").alias("node"))
    useful = storage.stored(reach(edges, goals, "up").select("node"), "useful")
    hops = edges.select("src", "dst").distinct().join(useful.withColumnRenamed("node", "src"), "src", "left_semi").join(useful.withColumnRenamed("node", "dst"), "dst", "left_semi")
    hops = storage.stored(hops.join(goals.withColumnRenamed("node", "src"), "src", "left_anti"), "path-edges")
    done = storage.Levels(spark, "node string, path array<string>", "paths")
    front = storage.stored(start.select("node", F.array("node").alias("path")), "path-front")
    n, acyclic = front.count(), None
    first = Window.partitionBy("node").orderBy(F.array_join("path", ">"))
    while n:
        if n > MANY and acyclic is None:
            acyclic = not on_cycles(hops).limit(1).count()
        if n > MANY and acyclic:
            front = storage.stored(front.withColumn("k", F.row_number().over(first)).where(F.col("k") <= most).drop("k"), "path-front")
            n = front.count()
        step = storage.small(front, n).join(hops, F.col("node") == F.col("src")).where(~F.array_contains("path", F.col("dst")))
        step = step.select(F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        step = storage.stored(step, "path-front")
        done.add(step.join(goals, "node", "left_semi"))
        front = storage.stored(step.join(goals, "node", "left_anti"), "path-front")
        n = front.count()
    text = F.array_join("path", ">")
    ranked = done.all().select(F.col("node").alias("exposure"), text.alias("path"), F.size("path").alias("n"))
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("exposure").orderBy("n", "path"))).where(F.col("rank") <= most)
    return ranked.select("exposure", "path", "rank"), ranked.groupBy("exposure").agg((F.max("rank") >= most).alias("truncated"))
