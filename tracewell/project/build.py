"""The project graph from scanned files: nodes, edges, and why a node's dependencies aren't sure."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewell.functions import schema, storage
from tracewell.project import scan

def _none() -> F.Column:
    return F.lit(None).cast("string")


@dataclass
class Project:
    nodes: DataFrame  # schema.NODES
    edges: DataFrame  # schema.EDGES
    reasons: DataFrame  # unique_id, kind, detail
    gaps: DataFrame  # path, detail: files that could not be read


def _id(kind: str, *parts: F.Column | str) -> F.Column:
    return F.concat_ws(".", F.lit(kind), *parts)


def _nodes(df: DataFrame, uid, label, kind: str, **x) -> DataFrame:
    empty = F.array().cast("array<string>")
    get = lambda name, otherwise: x.get(name) if x.get(name) is not None else otherwise
    return df.select(uid.alias("unique_id"), label.alias("label"), F.lit(kind).alias("node_type"), get("path", _none()).alias("file_path"), get("description", _none()).alias("description"), get("materialization", _none()).alias("materialization"), F.coalesce(get("tags", empty), empty).alias("tags"), F.coalesce(get("columns", empty), empty).alias("columns"), get("aliases", empty).alias("aliases"), get("exposure", F.lit(None)).cast(schema.EXPOSURE).alias("exposure"))


def _asks(df: DataFrame, uid: str = "uid") -> DataFrame:
    """(uid, what, a, b): a reference's name and version, or a source's two names."""
    refs = df.select(F.col(uid).alias("uid"), F.explode("refs").alias("r")).select("uid", F.lit("ref").alias("what"), F.col("r.name").alias("a"), F.col("r.version").alias("b"))
    return refs.unionByName(df.select(F.col(uid).alias("uid"), F.explode("sources").alias("s")).select("uid", F.lit("source").alias("what"), F.col("s.source").alias("a"), F.col("s.table").alias("b")))


def versions(yaml: DataFrame) -> DataFrame:
    """(name, version, latest, stem, uid) of declared model versions."""
    return yaml.where("entry = 'version'").select("name", "version", (F.col("version") == F.col("latest")).alias("latest"), "stem", F.concat(F.lit("model."), F.col("name"), F.lit(".v"), F.col("version")).alias("uid"))


def lookup(models: DataFrame, versions_: DataFrame, seeds: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(a, b, target, candidates): what a reference to a name and version means. Models come before seeds, seeds before
    snapshots; of models of one name the last by path; a versioned model's plain name is its latest version."""
    plain = models.join(versions_.select("stem"), "stem", "left_anti").select(F.col("stem").alias("a"), _none().alias("b"), F.col("uid").alias("target"), F.lit(0).alias("rank"), "path")
    of = models.select("stem", "path").join(versions_, "stem")
    plain = plain.unionByName(of.select(F.col("name").alias("a"), F.col("version").alias("b"), F.col("uid").alias("target"), F.lit(0).alias("rank"), "path"))
    plain = plain.unionByName(of.where("latest").select(F.col("name").alias("a"), _none().alias("b"), F.col("uid").alias("target"), F.lit(0).alias("rank"), "path"))
    for rank, df in ((1, seeds), (2, snapshots)):
        plain = plain.unionByName(df.select(F.col("stem").alias("a"), _none().alias("b"), F.col("uid").alias("target"), F.lit(rank).alias("rank"), "path"))
    # min_by over (rank, latest path): paths are compared backwards by taking the greatest within the least rank
    best = plain.groupBy("a", "b", "rank").agg(F.max_by("target", "path").alias("target"), F.count("*").alias("n"))
    return best.groupBy("a", "b").agg(F.min_by("target", "rank").alias("target"), F.sum("n").alias("candidates"))


def build(spark: SparkSession, files: DataFrame) -> Project:
    """The graph of a project's files (path, content).

    Parse work is done once and stored; references are resolved by joins. Names that nothing has become phantoms, with a
    reason on each that asks for them; exposures make none.
    """
    config = scan.settings(files)
    found = storage.stored(scan.discovered(files, config), "project-files")
    macros = scan.macros_of(found)
    sql = storage.stored(scan.sql_rows(found, macros, config["vars"]), "project-sql")
    yaml = storage.stored(scan.yaml_rows(found, macros, config["vars"]), "project-yaml")

    vs = versions(yaml)
    props = lambda entry: yaml.where(F.col("entry") == entry).groupBy("name").agg(F.max_by("description", "path").alias("p_description"), F.max_by("columns", "path").alias("p_columns"), F.max_by("materialization", "path").alias("p_materialization"), F.max_by("tags", "path").alias("p_tags"))
    models = sql.where("kind = 'model'").join(vs.select("stem", F.col("uid").alias("v_uid"), F.col("name").alias("v_name")), "stem", "left")
    models = models.withColumn("uid", F.coalesce("v_uid", _id("model", "stem"))).withColumn("name", F.coalesce("v_name", "stem"))
    tests = sql.where("kind = 'test'").withColumn("uid", _id("test", "stem"))
    snaps = sql.where("kind = 'snapshot'").select("path", "stem", "refs", "sources", "materialization", "tags", "reasons", "columns")
    snaps = snaps.unionByName(yaml.where("entry = 'snapshot' and stem = 'yes'").select("path", F.col("name").alias("stem"), "refs", "sources", "materialization", "tags", "reasons", "columns")).withColumn("uid", _id("snapshot", "stem"))
    seeds = found.where("kind = 'seed'").select("path", "stem").withColumn("uid", _id("seed", "stem"))
    sources = yaml.where("entry = 'source'").withColumn("uid", _id("source", "parent", "name"))
    exposures = yaml.where("entry = 'exposure'").withColumn("uid", _id("exposure", "name"))

    j = models.join(props("model"), "name", "left")
    columns = F.when(F.size(F.coalesce("p_columns", F.array().cast("array<string>"))) > 0, F.col("p_columns")).otherwise(F.col("columns"))
    both = F.array_distinct(F.concat("tags", F.coalesce("p_tags", F.array().cast("array<string>"))))
    nodes = _nodes(j, F.col("uid"), F.coalesce(F.when(F.col("v_uid").isNotNull(), F.regexp_replace("uid", "^model[.]", "")), F.col("stem")), "model", path=F.col("path"), description=F.col("p_description"), materialization=F.coalesce("materialization", "p_materialization"), tags=both, columns=columns, aliases=F.array("name"))
    nodes = nodes.unionByName(_nodes(seeds.join(props("seed"), F.col("stem") == F.col("name"), "left"), F.col("uid"), F.col("stem"), "seed", path=F.col("path"), description=F.col("p_description"), columns=F.col("p_columns")))
    nodes = nodes.unionByName(_nodes(snaps, F.col("uid"), F.col("stem"), "snapshot", path=F.col("path"), materialization=F.col("materialization"), tags=F.col("tags"), columns=F.col("columns")))
    nodes = nodes.unionByName(_nodes(tests, F.col("uid"), F.col("stem"), "test", path=F.col("path"), tags=F.col("tags")))
    nodes = nodes.unionByName(_nodes(sources, F.col("uid"), _id("", "parent", "name").substr(F.lit(2), F.lit(10_000)), "source", path=F.col("path"), description=F.col("description"), tags=F.col("tags"), columns=F.col("columns")))
    nodes = nodes.unionByName(_nodes(exposures, F.col("uid"), F.col("name"), "exposure", path=F.col("path"), description=F.col("description"), tags=F.col("tags"), exposure=F.col("exposure")))

    names = storage.stored(lookup(models.select("stem", "path", "uid"), vs, seeds, snaps.select("stem", "path", "uid")), "project-names")
    generic = storage.stored(generic_tests(yaml, names), "project-tests")
    nodes = nodes.unionByName(_nodes(generic, F.col("uid"), F.regexp_replace("uid", "^test[.]", ""), "test", path=F.col("path")))
    for entry in ("semantic_model", "metric", "saved_query"):
        nodes = nodes.unionByName(_nodes(yaml.where(F.col("entry") == entry), _id(entry, "name"), F.col("name"), entry, path=F.col("path"), description=F.col("description")))

    asks = _asks(models).unionByName(_asks(tests)).unionByName(_asks(snaps)).unionByName(_asks(exposures)).unionByName(_asks(generic)).unionByName(_asks(yaml.where("entry = 'semantic_model'").withColumn("uid", _id("semantic_model", "name"))))
    linked = storage.stored(resolve(asks, names, sources), "project-links")
    phantoms = linked.where("target is null and uid not like 'exposure.%'").select(F.concat_ws(".", F.lit("phantom"), "a", F.when(F.col("what") == "source", F.col("b")).otherwise(F.when(F.col("b").isNotNull(), F.concat(F.lit("v"), "b")))).alias("target"), "uid", "what", "a", "b")
    nodes = nodes.unionByName(_nodes(phantoms.select("target").distinct(), F.col("target"), F.regexp_replace("target", "^phantom[.]", ""), "phantom"))

    dst_kind = F.element_at(F.split("uid", "[.]"), 1)
    kind = F.when(dst_kind == "test", "test").when(dst_kind == "exposure", "exposure").when(F.col("what") == "source", "source").otherwise("ref")
    links = linked.where("target is not null").select("target", "uid", "what").unionByName(phantoms.select("target", "uid", "what"))
    parents = generic.select(F.col("parent_uid").alias("src"), F.col("uid").alias("dst"), F.lit("test").alias("edge_type")).where("src is not null")
    edges = links.select(F.col("target").alias("src"), F.col("uid").alias("dst"), kind.alias("edge_type")).unionByName(parents).unionByName(semantic_edges(yaml))
    edges = edges.select("src", "dst", "edge_type", schema.edge_rank("edge_type").alias("edge_rank"), F.lit(None).cast("int").alias("collapsed_through"))

    reasons = models.select("uid", "reasons")
    for df in (tests, snaps, exposures, generic):
        reasons = reasons.unionByName(df.select("uid", "reasons"))
    reasons = reasons.select(F.col("uid").alias("unique_id"), F.explode("reasons").alias("r")).select("unique_id", "r.kind", "r.detail")
    missing = linked.where("target is null").select(F.col("uid").alias("unique_id"), F.lit("dependency_target_missing").alias("kind"), F.concat_ws(".", "what", "a", "b").alias("detail"))
    ambiguous = linked.where("target is not null and candidates > 1").select(F.col("uid").alias("unique_id"), F.lit("ambiguous_ref").alias("kind"), F.col("a").alias("detail"))
    phantom = phantoms.select(F.col("target").alias("unique_id"), F.lit("not_assessed").alias("kind"), F.lit("phantom").alias("detail")).distinct()
    gaps = yaml.where("entry = 'input_skipped'").select("path", F.col("reasons")[0]["detail"].alias("detail"))
    return Project(storage.stored(nodes, "nodes"), storage.stored(edges, "edges"), storage.stored(reasons.unionByName(missing).unionByName(ambiguous).unionByName(phantom), "reasons"), gaps)


def resolve(asks: DataFrame, names: DataFrame, sources: DataFrame) -> DataFrame:
    """(uid, what, a, b, target, candidates) for every reference and source asked for; target is null where there is none."""
    refs = asks.where("what = 'ref'").alias("x").join(names.alias("n"), (F.col("x.a") == F.col("n.a")) & F.col("x.b").eqNullSafe(F.col("n.b")), "left").select("x.uid", "x.what", "x.a", "x.b", "n.target", "n.candidates")
    of = sources.select(F.col("parent").alias("a"), F.col("name").alias("b"), F.col("uid").alias("target")).distinct().withColumn("candidates", F.lit(1).cast("long"))
    return refs.unionByName(asks.where("what = 'source'").join(of, ["a", "b"], "left").select("uid", "what", "a", "b", "target", "candidates"))


def generic_tests(yaml: DataFrame, names: DataFrame) -> DataFrame:
    """Tests declared in YAML: (uid, parent_uid, path, refs, sources, reasons); ids that repeat get _2, _3 and so on."""
    t = yaml.where("entry = 'test'").withColumn("base", F.concat_ws(".", F.lit("test"), "name", "parent", "column"))
    t = t.withColumn("nth", F.row_number().over(Window.partitionBy("base").orderBy("path", "position")))
    t = t.withColumn("uid", F.when(F.col("nth") > 1, F.concat("base", F.lit("_"), F.col("nth").cast("string"))).otherwise(F.col("base")))
    t = t.alias("t").join(names.where("b is null").select("a", "target").alias("n"), (F.col("t.parent") == F.col("n.a")) & (F.col("t.test") != "source"), "left")
    parent = F.when(F.col("t.test") == "source", _id("source", "t.parent")).otherwise(F.col("n.target"))
    return t.select("t.uid", parent.alias("parent_uid"), "t.path", "t.refs", "t.sources", "t.reasons")


def semantic_edges(yaml: DataFrame) -> DataFrame:
    """(src, dst, edge_type) from semantic models to metrics, between metrics, and to saved queries; a measure belongs to
    the first semantic model that has it."""
    owner = yaml.where("entry = 'semantic_model'").select(F.explode("inputs").alias("m"), F.struct("path", "position").alias("at"), _id("semantic_model", "name").alias("src")).groupBy("m").agg(F.min_by("src", "at").alias("src"))
    use = yaml.where("entry in ('metric', 'saved_query')").select(F.concat_ws(".", "entry", "name").alias("dst"), F.explode("inputs").alias("i")).select("dst", F.substring_index("i", ":", 1).alias("what"), F.regexp_replace("i", "^[^:]*:", "").alias("m"))
    by_measure = use.where("what = 'measure'").join(owner, "m").select("src", "dst")
    known = yaml.where("entry = 'metric'").select(F.col("name").alias("m")).distinct()
    by_metric = use.where("what = 'metric'").join(known, "m").select(_id("metric", "m").alias("src"), "dst")
    return by_measure.unionByName(by_metric).distinct().withColumn("edge_type", F.lit("ref"))


def status(p: Project) -> DataFrame:
    """(unique_id, status, reasons): complete where nothing is unsure, else partial with the sorted kinds of reasons."""
    why = p.reasons.groupBy("unique_id").agg(F.sort_array(F.collect_set("kind")).alias("reasons"))
    empty = F.array().cast("array<string>")
    return p.nodes.select("unique_id").distinct().join(why, "unique_id", "left").select("unique_id", F.when(F.col("reasons").isNull(), "complete").otherwise("partial").alias("status"), F.coalesce("reasons", empty).alias("reasons"))
