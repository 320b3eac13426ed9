"""Choosing nodes: by name, tag, path, kind and text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewell.functions import schema
from tracewell.functions.patterns import glob_regex, is_glob


#: Names that are compared with every id's end.
FEW = 50


def selector(text: str) -> Column:
    """One selector as a condition on nodes: tag:x, path:p or a name; each may be a glob.

    A path without glob characters is a prefix. A name stands for a label, a unique id or an alias.
    """
    kind, _, value = text.strip().partition(":")
    if kind == "tag" and value:
        return F.exists("tags", lambda t: t.rlike(glob_regex(value, False)) if is_glob(value) else t == value)
    if kind == "path" and value:
        path = F.coalesce(F.col("file_path"), F.lit(""))
        return path.rlike(glob_regex(value)) if is_glob(value) else path.startswith(value) & F.col("file_path").isNotNull()
    name = text.strip()
    same = (lambda c: c.rlike(glob_regex(name, False))) if is_glob(name) else (lambda c: c == name)
    return same(F.col("label")) | same(F.col("unique_id")) | F.exists("aliases", same)


def selected(nodes: DataFrame, selectors: str) -> DataFrame:
    """(node): nodes that any of the comma-separated selectors takes."""
    parts = [selector(s) for s in selectors.split(",") if s.strip()]
    return nodes.where(reduce(lambda a, b: a | b, parts, F.lit(False))).select(F.col("unique_id").alias("node"))


def lookup(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """(name, stage, unique_id, candidates) for each name (one column) that stands for a node.

    Stages, of which the first that finds anything counts: unique id, alias or bare model name, label, and end of the
    unique id after a dot (not for phantoms). Of several nodes the smallest id is chosen. Each stage is an equi-join; a few
    names are compared with the ends of ids instead of cutting every id at its dots.
    """
    few = names.select("name").distinct().limit(FEW + 1).collect()
    n = nodes.select("unique_id", "label", "node_type", "aliases")
    parts = F.split("unique_id", r"\.")
    keys = [
        n.select(F.lit(1).alias("stage"), F.col("unique_id").alias("name"), "unique_id"),
        n.select(F.lit(2), F.explode("aliases"), "unique_id"),
        n.where(F.col("node_type") == "model").select(F.lit(2), F.element_at(parts, -1), "unique_id"),
        n.select(F.lit(3), "label", "unique_id"),
        n.where(F.col("node_type") != "phantom").select(F.lit(4), F.explode(F.filter(F.array(*[F.lit(r.name) for r in few]), lambda x: F.col("unique_id").endswith(F.concat(F.lit("."), x)))), "unique_id")
        if 0 < len(few) <= FEW
        else n.where(F.col("node_type") != "phantom").select(F.lit(4), F.explode(F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))), "unique_id"),
    ]
    hits = reduce(DataFrame.union, keys).join(names.select("name").distinct(), "name").distinct()
    best = hits.groupBy("name").agg(F.min("stage").alias("stage"))
    return hits.join(best, ["name", "stage"]).groupBy("name", "stage").agg(F.min("unique_id").alias("unique_id"), F.count("*").alias("candidates"))


def search(nodes: DataFrame, patterns: list[str], ignore_case: bool = True) -> DataFrame:
    """(node): nodes whose label or description each of the patterns matches somewhere."""
    cond = F.lit(True)
    for p in patterns:
        p = f"(?i){p}" if ignore_case else p
        cond = cond & (F.col("label").rlike(p) | F.coalesce(F.col("description").rlike(p), F.lit(False)))
    return nodes.where(cond).select(F.col("unique_id").alias("node"))


def substring(nodes: DataFrame, text: str) -> DataFrame:
    """Nodes with the text, in any case, in their name, description, a tag or their path."""
    t = text.lower()
    has = lambda c: F.coalesce(F.lower(c).contains(t), F.lit(False))
    return nodes.where(has(F.col("label")) | has(F.col("unique_id")) | has(F.col("description")) | F.exists("tags", lambda x: has(x)) | has(F.col("file_path")))


def page(df: DataFrame, order: list[str], limit: int, after: int = 0) -> DataFrame:
    """Rows after+1 to after+limit in the order, numbered from 1; limit is kept between 1 and 100."""
    limit = min(max(limit, 1), 100)
    top = df.orderBy(*order).limit(after + limit)  # a bounded top-k, not a global sort
    return top.withColumn("position", F.row_number().over(Window.orderBy(*order))).where(F.col("position") > after)


def summary(nodes: DataFrame, edges: DataFrame | None = None, variables: dict | None = None) -> DataFrame:
    """(node_type, n): every kind, also those with no node, and total; with edges and variables, their numbers too."""
    got = nodes.groupBy("node_type").agg(F.count("*").alias("n"))
    kinds = nodes.sparkSession.createDataFrame([(k,) for k in schema.NODE_KINDS], "node_type string")
    per = kinds.join(got, "node_type", "left").select("node_type", F.coalesce("n", F.lit(0)).alias("n"))
    out = per.union(per.agg(F.lit("total"), F.sum("n")))
    if edges is not None:
        out = out.union(edges.agg(F.lit("edges"), F.count("*")))
    return out if variables is None else out.union(nodes.sparkSession.createDataFrame([("vars", len(variables))], "node_type string, n long"))
