"""How sure an answer about columns is: what a search may have missed, and whether "nothing is affected" is proven."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions import storage
from tracewell.operators import closure, columns

#: Reasons for which a whole model could not be analysed.
FAILED = ("analysis_failed", "missing_definition")


def downstream_map(models: DataFrame) -> DataFrame:
    """(src, dst) between models and snapshots, by their declared dependencies."""
    built = models.where("kind in ('model', 'snapshot')")
    deps = built.select(F.explode("depends_on").alias("src"), F.col("uid").alias("dst")).distinct()
    return deps.join(models.where("kind in ('model', 'snapshot', 'seed', 'source')").select(F.col("uid").alias("src")), "src", "left_semi")


def behind(models: DataFrame, starts: DataFrame) -> DataFrame:
    """(input, uid): the models that come after each input column's owner (starts: one column, node)."""
    owner = starts.select(F.col("node").alias("input"), F.substring_index("node", "#", 1).alias("owner"))
    pairs = closure.reach_pairs(downstream_map(models), owner.select(F.col("owner").alias("node")).distinct(), "down")
    return owner.join(pairs.where("distance > 0"), F.col("owner") == F.col("root")).select("input", F.col("node").alias("uid"))


def relevance(asked: DataFrame, models: DataFrame, reached: DataFrame) -> DataFrame:
    """(input, relation, relevance) for (input, relation) pairs: whether a relation, as written, could be one that depends
    on the input. It is relevant if it names one model that does or is the input's own, unrelated if all it may name do
    not, or nothing of the project has that name; unknown if some of several do.
    """
    ends = F.transform(F.sequence(F.lit(1), F.size("relation")), lambda i: F.lower(F.array_join(F.slice("relation", i, F.size("relation")), ".")))
    names = models.select("uid", F.explode(ends).alias("name")).distinct()
    own = reached.select("input", F.substring_index("input", "#", 1).alias("uid")).union(reached.select("input", "uid")).distinct().withColumn("after", F.lit(True))
    hit = asked.select("input", "relation").distinct().withColumn("name", F.lower("relation")).join(names, "name", "left").join(own, ["input", "uid"], "left")
    n, m = F.count("uid"), F.count("after")
    said = F.when(m == 0, "unrelated").when(m == n, F.when(n == 1, "relevant").otherwise("unknown")).otherwise("unknown")
    return hit.groupBy("input", "relation").agg(said.alias("relevance"))


def gaps(slots: DataFrame, models: DataFrame, starts: DataFrame) -> DataFrame:
    """(input, gap, at, detail) for what the search from each input column (starts: one column, node) may have missed.

    unresolved_lineage: a slot behind the input has a part that isn't proven unrelated; analysis_failed: a model behind it
    could not be analysed; open_output: it has columns that aren't enumerated, from a relation not proven unrelated;
    ambiguous_input: a slot reads a name that several outputs of the input's model have; ambiguous_model: it reads a
    relation that several models may be; cycle: a confirmed path comes back; unidentified_input: the input isn't one output.
    """
    starts = storage.stored(starts.select("node").distinct(), "starts")
    reached = storage.stored(behind(models, starts), "behind")
    near = storage.stored(reached.join(slots, "uid"), "slots-behind")
    at = columns.node()
    reasons = near.where("not complete and star is null").select("input", at.alias("at"), F.explode("reasons").alias("r")).select("input", "at", "r.kind", "r.payload")
    failed = reasons.where(F.col("kind").isin(*FAILED)).select("input", F.lit("analysis_failed").alias("gap"), F.substring_index("at", "#", 1).alias("at"), F.col("kind").alias("detail")).distinct()
    lost = near.where("star is not null").where(F.exists("reasons", lambda r: r["kind"].isin(*FAILED))).select("input", F.lit("analysis_failed"), "uid", F.col("reasons")[0]["kind"]).distinct()
    loose = reasons.where(~F.col("kind").isin(*FAILED))
    stars = near.where("star is not null").where(~F.exists("reasons", lambda r: r["kind"].isin(*FAILED))).select("input", F.col("uid").alias("at"), "star")
    asked = loose.where("kind = 'behind_star'").select("input", F.col("payload").alias("relation")).union(stars.select("input", F.col("star")))
    known = storage.stored(relevance(asked, models, reached), "relevance")
    free = known.where("relevance = 'unrelated'").select("input", "relation")
    unresolved = loose.join(free, (loose["input"] == free["input"]) & (F.col("kind") == "behind_star") & (F.col("payload") == F.col("relation")), "left_anti").select("input", F.lit("unresolved_lineage"), "at", F.concat_ws(" ", "kind", "payload"))
    open_ = stars.join(free.withColumnRenamed("relation", "star"), ["input", "star"], "left_anti").select("input", F.lit("open_output"), "at", "star")
    many = slots.where("key is not null and star is null").groupBy("uid", "key").agg(F.count("*").alias("n"))
    reads = near.where("key is not null").select("input", at.alias("at"), F.explode("sources").alias("s")).select("input", "at", "s.uid", "s.relation", F.col("s.column").alias("key"))
    twice = reads.join(many.where("n > 1"), ["uid", "key"]).where(F.concat_ws("#", "uid", "key") == F.col("input")).select("input", F.lit("ambiguous_input"), "at", "input")
    unsure = relevance(reads.where("uid is null").select("input", "relation"), models, reached).where("relevance = 'unknown'")
    several = reads.where("uid is null").join(unsure, ["input", "relation"]).select("input", F.lit("ambiguous_model"), "at", "relation")
    back = closure.on_cycles(columns.graph(slots).select("src", "dst"))
    cyclic = columns.downstream(slots, starts).join(back.select(F.col("src").alias("node")).distinct(), "node", "left_semi").select(F.col("root").alias("input"), F.lit("cycle"), F.col("node").alias("at"), F.lit(""))
    one = starts.select(F.col("node").alias("input"), F.substring_index("node", "#", 1).alias("uid"), F.substring_index("node", "#", -1).alias("key")).join(many, ["uid", "key"], "left")
    unidentified = one.where("n is null or n > 1").select("input", F.lit("unidentified_input"), F.col("uid").alias("at"), F.concat(F.coalesce("n", F.lit(0)).cast("string"), F.lit(" outputs")))
    out = failed
    for df in (lost, unresolved, open_, twice, several, cyclic, unidentified):
        out = out.union(df)
    return out.distinct()


def exploration(slots: DataFrame, models: DataFrame, starts: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(input, confirmed, possible, gaps, status, no_impact): "no impact" holds where nothing is confirmed or possible
    and the search is complete."""
    found = storage.stored(gaps(slots, models, starts) if found is None else found, "gaps")
    sure = columns.downstream(slots, starts).groupBy(F.col("root").alias("input")).agg(F.count("*").alias("confirmed"))
    loose = found.where("gap = 'unresolved_lineage'").groupBy("input").agg(F.count_distinct("at").alias("possible"))
    n = found.groupBy("input").agg(F.count("*").alias("gaps"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = starts.select(F.col("node").alias("input")).distinct().join(sure, "input", "left").join(loose, "input", "left").join(n, "input", "left")
    out = out.select("input", zero("confirmed").alias("confirmed"), zero("possible").alias("possible"), zero("gaps").alias("gaps"))
    return out.withColumn("status", F.when(F.col("gaps") == 0, "complete").otherwise("incomplete")).withColumn("no_impact", (F.col("confirmed") == 0) & (F.col("possible") == 0) & (F.col("gaps") == 0))


def paths(slots: DataFrame, starts: DataFrame, direction: str = "up") -> DataFrame:
    """(root, node, path, transform): every simple path of confirmed dependencies from each start, and the strongest
    transform on it. Grows with the paths it returns; up ends at columns that nothing feeds, down at every column."""
    spark = slots.sparkSession
    rank = F.create_map(*[F.lit(x) for i, t in enumerate(("direct", "expression", "conditional", "aggregation")) for x in (t, i)])
    e = columns.graph(slots).select("src", "dst", F.coalesce(F.try_element_at(rank, F.col("transform")), F.lit(0)).alias("t")).groupBy("src", "dst").agg(F.max("t").alias("t"))
    a, b = ("dst", "src") if direction == "up" else ("src", "dst")
    hops = storage.stored(e.select(F.col(a).alias("node"), F.col(b).alias("next"), "t"), "path-hops")
    levels = storage.Levels(spark, "root string, node string, path array<string>, t int", "column-paths")
    front, n = levels.add(starts.select(F.col("node").alias("root"), "node", F.array("node").alias("path"), F.lit(0).alias("t")).distinct())
    while n:
        step = front.join(hops.withColumnRenamed("t", "u"), "node").where(~F.array_contains("path", F.col("next")))
        front, n = levels.add(step.select("root", F.col("next").alias("node"), F.concat("path", F.array("next")).alias("path"), F.greatest("t", "u").alias("t")))
    out = levels.all().where(F.size("path") > 1)
    if direction == "up":
        out = out.join(hops.select("node").distinct(), "node", "left_anti")
    names = F.array(*map(F.lit, ("direct", "expression", "conditional", "aggregation")))
    return out.select("root", "node", F.array_join("path", ">").alias("path"), F.element_at(names, F.col("t") + 1).alias("transform"))


def adopted(sql: DataFrame, header: DataFrame, declared: DataFrame) -> DataFrame:
    """(uid, columns, basis) of three tables (uid, columns): what the SQL gives, else a seed's header where nothing is
    declared, else what is declared."""
    x = declared.select("uid", F.col("columns").alias("d")).join(sql.select("uid", F.col("columns").alias("s")), "uid", "full").join(header.select("uid", F.col("columns").alias("h")), "uid", "full")
    said = F.when(F.col("s").isNotNull(), "sql").when(F.col("h").isNotNull() & (F.size(F.coalesce("d", F.array().cast("array<string>"))) == 0), "header").otherwise("declared")
    return x.select("uid", F.coalesce("s", F.when(said == "header", F.col("h")), "d").alias("columns"), said.alias("basis"))


def conflicts(claims: DataFrame) -> DataFrame:
    """(relation, status, columns, ordered, evidence) of claims (relation, columns, exhaustive, ordered, evidence).

    The same claim again unites the evidence; one that only adds a proven order refines; any other contradicts, and a
    contradicted relation has no schema.
    """
    claim = F.struct(F.sort_array("columns").alias("c"), "exhaustive")
    order = F.collect_set(F.when(F.col("ordered"), F.col("columns")))
    x = claims.groupBy("relation").agg(F.count_distinct(claim).alias("n"), F.size(order).alias("orders"), F.max("ordered").alias("ordered"), F.min("ordered").alias("all_ordered"), F.max_by("columns", F.struct("ordered", "evidence")).alias("columns"), F.sort_array(F.collect_set("evidence")).alias("evidence"))
    bad = (F.col("n") > 1) | (F.col("orders") > 1)
    status = F.when(bad, "conflicted").when(F.col("ordered") & ~F.col("all_ordered"), "refined").otherwise("agreed")
    return x.select("relation", status.alias("status"), F.when(~bad, F.col("columns")).alias("columns"), (F.col("ordered") & ~bad).alias("ordered"), "evidence")


def evidence(cited: DataFrame, derived: DataFrame) -> DataFrame:
    """(id): the cited records (id) and all they were derived from, over (id, from)."""
    return closure.reach(derived.select(F.col("id").alias("src"), F.col("from").alias("dst")), cited.select(F.col("id").alias("node"))).select(F.col("node").alias("id"))


def freshness(files: DataFrame, referenced: DataFrame, built_at: F.Column, project: str | None, manifest_project: str | None) -> DataFrame:
    """(path, state) of what a compiled manifest may be out of date for: files (path, modified) of the project, referenced
    (package, path) from the manifest, and when it was built.

    stale: changed since; deleted: referenced and gone; unverified: a path that leaves its package, a package that isn't
    the project, no project, or another one. No rows: verified.
    """
    spark = files.sparkSession
    if project is None or manifest_project is not None and manifest_project != project:
        return spark.createDataFrame([(None, "unverified:project_unavailable" if project is None else "unverified:project_mismatch")], "path string, state string")
    stale = files.where(F.col("modified").isNull() | (F.col("modified") > built_at)).select("path", F.lit("stale").alias("state"))
    mine = referenced.where(F.col("package").isNull() | (F.col("package") == project))
    bad = mine.where(F.col("path").startswith("/") | F.col("path").rlike(r"(^|/)\.\.(/|$)"))
    gone = mine.join(bad.select("path"), "path", "left_anti").join(files, "path", "left_anti").select("path", F.lit("deleted").alias("state"))
    other = referenced.where(F.col("package") != project).select(F.col("package").alias("path"), F.lit("unverified:package").alias("state")).distinct()
    return stale.union(gone).union(bad.select("path", F.lit("unverified:invalid_resource_path"))).union(other).distinct()
