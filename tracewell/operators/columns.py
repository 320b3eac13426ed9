"""Column lineage over a project: each model's outputs, and the graph they form."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions import storage
from tracewell.operators import closure
from tracewell.sql import dialects
from tracewell.sql.lexer import SqlError
from tracewell.sql.lineage import Schema, analyze

#: Projects of at most this many models are analysed in one task, without a round for each level.
SMALL_MODELS = 5000
MODELS = "uid string, kind string, relation array<string>, columns array<string>, sql string, depends_on array<string>"
_SOURCES = "array<struct<uid:string,relation:string,column:string>>"
SLOTS = f"uid string, slot int, ordinal int, name string, key string, transform string, star string, complete boolean, sources {_SOURCES}, reasons array<struct<kind:string,payload:string>>, declared boolean"


def _catalog(deps: list[dict], dialect: dialects.Dialect) -> tuple[dict[str, Schema], dict[str, str | None]]:
    """Schemas and ids by relation key. A relation goes by its whole name and by its ends; an end two of them share by none."""
    schemas: dict[str, Schema] = {}
    uids: dict[str, str | None] = {}
    for d in deps:
        keys = [dialect.key(p) for p in d["relation"]]
        for k in range(len(keys)):
            name = ".".join(keys[k:])
            if name in uids and uids[name] != d["uid"]:
                uids[name] = None
                schemas.pop(name, None)
                continue
            uids[name] = d["uid"]
            if len(d["columns"]):
                schemas[name] = Schema(list(d["columns"]), bool(d["exhaustive"]), bool(d["ordered"]))
    return schemas, uids


def analyse(model: dict, deps: list[dict], dialect: dialects.Dialect) -> list[dict]:
    """The slots of one model; where its SQL can't be read, its declared columns with a reason each.

    Sources name the dependency that owns the relation; a relation that none owns, or more than one could, has no uid.
    """
    schemas, uids = _catalog(deps, dialect)
    declared = [dict(uid=model["uid"], slot=i, ordinal=None, name=c, key=dialect.key(c), transform="direct", star=None, complete=True, sources=[], reasons=[], declared=True) for i, c in enumerate(model["columns"])]
    if model["kind"] in ("source", "seed"):
        return declared
    try:
        if not model["sql"]:
            raise SqlError("missing_definition")
        found = [a for a in analyze(model["sql"], dialect, schemas, exact=True) if a.kind != "other"]
        if not found:
            raise SqlError("no query")
    except SqlError as e:
        kind = "missing_definition" if str(e) == "missing_definition" else "analysis_failed"
        rows = declared or [dict(uid=model["uid"], slot=0, ordinal=None, name=None, key=None, transform="direct", star=model["uid"], complete=False, sources=[], reasons=[], declared=True)]
        return [r | dict(complete=False, reasons=[dict(kind=kind, payload=str(e))]) for r in rows]
    out = []
    for i, o in enumerate(found[-1].outputs):
        sources = [dict(uid=uids.get(".".join(dialect.key(p) for p in rel.split("."))), relation=rel, column=dialect.key(col)) for rel, col in o.sources]
        out.append(dict(uid=model["uid"], slot=i, ordinal=o.ordinal, name=o.name, key=None if o.name is None else dialect.key(o.name), transform=o.transform, star=o.star, complete=o.complete, sources=sources, reasons=[dict(kind=k, payload=p) for k, p in o.reasons], declared=False))
    return out


def adopted(uid: str, relation: list[str], rows: list[dict]) -> dict:
    """What a model's dependents may rely on: its named outputs; exhaustive unless something isn't enumerated."""
    named = [r for r in rows if r["name"] is not None]
    return dict(uid=uid, relation=relation, columns=[r["name"] for r in named], exhaustive=not any(r["star"] for r in rows) and (bool(named) or not rows), ordered=all(r["ordinal"] is not None for r in named))


def _project(rows: pd.DataFrame, dialect: dialects.Dialect) -> pd.DataFrame:
    """All of a small project, dependencies first; models on a cycle see no schema of one another."""
    models = {r["uid"]: r for r in rows.sort_values("uid").to_dict("records")}
    schemas: dict[str, dict] = {}
    out: list[dict] = []
    for root in models:
        stack, open_ = [(root, iter(list(models[root]["depends_on"])))] if root not in schemas else [], {root}
        while stack:
            uid, deps = stack[-1]
            nxt = next((d for d in deps if d in models and d not in schemas and d not in open_), None)
            if nxt is not None:
                open_.add(nxt)
                stack.append((nxt, iter(list(models[nxt]["depends_on"]))))
                continue
            stack.pop()
            m = models[uid]
            got = analyse(m, [schemas.get(d) or dict(uid=d, relation=models[d]["relation"], columns=[], exhaustive=False, ordered=False) for d in m["depends_on"] if d in models], dialect)
            schemas[uid] = adopted(uid, list(m["relation"]), got)
            out += got
    return _frame(out)


def _frame(rows: list[dict]) -> pd.DataFrame:
    names = [c.split(" ")[0] for c in SLOTS.replace(_SOURCES, "a").replace("array<struct<kind:string,payload:string>>", "a").split(", ")]
    df = pd.DataFrame(rows, columns=names)
    for c in ("slot", "ordinal"):
        df[c] = df[c].astype("Int32")
    return df


def slots(models: DataFrame, dialect: str | None = None, small: int | None = None) -> DataFrame:
    """SLOTS for all models (MODELS). Small projects take one task; larger ones a round for each level of dependencies,
    in which models are analysed where they lie, with the schemas their dependencies have left."""
    d = dialects.detect(dialect)
    limit = SMALL_MODELS if small is None else small
    models = storage.stored(models.select(*[c.split(" ")[0] for c in MODELS.split(", ")]), "models")
    n = models.count()
    if n <= limit:
        return storage.stored(models.withColumn("g", F.lit(1)).groupBy("g").applyInPandas(lambda p: _project(p, d), SLOTS), "slots")
    spark = models.sparkSession
    deps = storage.stored(models.select("uid", F.explode("depends_on").alias("dep")).join(models.select(F.col("uid").alias("dep")), "dep", "left_semi").select("uid", "dep"), "deps")
    levels = closure.layers(deps.select(F.col("dep").alias("src"), F.col("uid").alias("dst")), models.select(F.col("uid").alias("node")))
    models = storage.stored(models.join(levels.withColumnRenamed("node", "uid"), "uid"), "levelled")
    last = models.agg(F.max("layer")).first()[0]
    parts, schemas = [], []
    dep_type = "uid string, relation array<string>, columns array<string>, exhaustive boolean, ordered boolean"
    for level in [*range(0, (last if last is not None else -1) + 1), None]:
        now = models.where(F.col("layer") == level) if level is not None else models.where("layer is null")
        known = spark.read.parquet(*schemas) if schemas else spark.createDataFrame([], dep_type)
        mine = deps.join(now.select("uid"), "uid", "left_semi").join(known.withColumnRenamed("uid", "dep"), "dep", "left")
        mine = mine.groupBy("uid").agg(F.collect_list(F.struct(F.col("dep").alias("uid"), "relation", "columns", "exhaustive", "ordered")).alias("deps"))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in batches:
                for m in p.to_dict("records"):
                    got = [x for x in (m["deps"] if m["deps"] is not None else []) if x["relation"] is not None]
                    yield _frame(analyse(m, sorted(got, key=lambda x: x["uid"]), d))

        out = now.join(mine, "uid", "left").mapInPandas(run, SLOTS)
        path = storage.new_path(spark, "slots-level")
        out.write.parquet(path)
        parts.append(path)
        level_slots = spark.read.parquet(path)
        named = F.filter("s", lambda x: x["name"].isNotNull())
        adopt = level_slots.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("slot", "name", "ordinal", "star"))).alias("s")).join(models.select("uid", "relation"), "uid")
        adopt = adopt.select("uid", "relation", F.transform(named, lambda x: x["name"]).alias("columns"), (~F.exists("s", lambda x: x["star"].isNotNull()) & (F.size(named) > 0)).alias("exhaustive"), F.forall(named, lambda x: x["ordinal"].isNotNull()).alias("ordered"))
        path = storage.new_path(spark, "schemas")
        adopt.write.parquet(path)
        schemas.append(path)
    return spark.read.parquet(*parts)


def node(uid: str = "uid", key: str = "key") -> F.Column:
    return F.concat_ws("#", uid, key)


def graph(slots_: DataFrame) -> DataFrame:
    """Edges between columns, (src, dst, src_uid, dst_uid, transform): from each proven source to the slot it feeds.

    A column is its owner's id and its key; a source no dependency owns is an external relation of that name.
    """
    x = slots_.where("key is not null").select("uid", "key", "transform", F.explode("sources").alias("s"))
    owner = F.coalesce("s.uid", F.concat(F.lit("external."), F.col("s.relation")))
    return x.select(F.concat_ws("#", owner, "s.column").alias("src"), node().alias("dst"), owner.alias("src_uid"), F.col("uid").alias("dst_uid"), "transform").distinct()


def upstream(slots_: DataFrame, models: DataFrame, roots: DataFrame | None = None, small: int | None = None) -> DataFrame:
    """(root, source, distance, boundary): the columns at which each root (one column, node; all slots by default) ends.

    boundary says why: external_relation (a source or a relation nobody owns), seed, source_free (a slot whose value
    needs no column), missing_definition, analysis_failed, or unresolved.
    """
    edges = storage.stored(graph(slots_), "column-edges")
    starts = roots if roots is not None else slots_.where("key is not null and not declared").select(node().alias("node"))
    pairs = closure.reach_pairs(edges.select("src", "dst"), starts, "up", small)
    ends = pairs.join(edges.select(F.col("dst").alias("node")).distinct(), "node", "left_anti")
    info = slots_.where("key is not null").join(models.select("uid", "kind"), "uid").select(node().alias("node"), "kind", "complete", F.coalesce(F.try_element_at(F.transform("reasons", lambda r: r["kind"]), F.lit(1)), F.lit("")).alias("why"))
    b = F.when(F.col("kind").isNull() | (F.col("kind") == "source"), "external_relation").when(F.col("kind") == "seed", "seed").when(F.col("complete"), "source_free").when(F.col("why").isin("missing_definition", "analysis_failed"), F.col("why")).otherwise("unresolved")
    return ends.join(info.dropDuplicates(["node"]), "node", "left").select("root", F.col("node").alias("source"), "distance", b.alias("boundary"))


def downstream(slots_: DataFrame, starts: DataFrame, small: int | None = None) -> DataFrame:
    """(root, node, distance): every column that confirmed dependencies lead to from each start, itself left out."""
    edges = storage.stored(graph(slots_).select("src", "dst"), "column-edges")
    return closure.reach_pairs(edges, starts, "down", small).where("distance > 0")


def possible(slots_: DataFrame, starts: DataFrame, models: DataFrame | None = None) -> DataFrame:
    """(node): columns that may depend on a start, though no proof says so: slots with an unresolved part whose name could
    be the start's, of models that come after the start's where models are given, and what follows from them; confirmed
    ones are left out."""
    start = starts.select("node", F.element_at(F.split("node", "#"), 1).alias("owner"), F.element_at(F.split("node", "#"), 2).alias("key"))
    loose = slots_.where("not complete").select(node().alias("hit"), F.explode("reasons").alias("r"))
    if models is None:
        first = loose.join(start.select("key").distinct(), F.col("r.payload") == F.col("key"), "left_semi").select(F.col("hit").alias("node")).distinct()
    else:
        from tracewell.operators import gaps

        after = gaps.behind(models, starts).select("uid", F.substring_index("input", "#", -1).alias("key")).distinct()
        loose = loose.select("hit", F.substring_index("hit", "#", 1).alias("uid"), F.col("r.payload").alias("key"))
        first = loose.join(after, ["uid", "key"], "left_semi").select(F.col("hit").alias("node")).distinct()
    edges = storage.stored(graph(slots_).select("src", "dst"), "column-edges")
    sure = closure.reach(edges, starts.select("node"))
    return closure.reach(edges, first).select("node").join(sure.select("node"), "node", "left_anti")


def counts(slots_: DataFrame) -> DataFrame:
    """(uid, listed, complete, partial, open) for each model."""
    n = lambda c: F.count(F.when(c, 1))
    return slots_.groupBy("uid").agg(n(F.col("star").isNull()).alias("listed"), n(F.col("star").isNull() & F.col("complete")).alias("complete"), n(F.col("star").isNull() & ~F.col("complete")).alias("partial"), (n(F.col("star").isNotNull()) > 0).alias("open"))


def select(slots_: DataFrame, names: DataFrame) -> DataFrame:
    """(uid, name, status, slot) for requested (uid, name): found, ambiguous, not_found, or indeterminate behind a star."""
    own = slots_.where("star is null and key is not null").groupBy("uid", "key").agg(F.count("*").alias("n"), F.min("slot").alias("slot"))
    stars = slots_.where("star is not null").select("uid").distinct().withColumn("open", F.lit(True))
    j = names.join(own, (names["uid"] == own["uid"]) & (F.lower(names["name"]) == F.lower(own["key"])), "left").select(names["uid"], names["name"], "n", "slot").join(stars, "uid", "left")
    status = F.when(F.col("n") == 1, "found").when(F.col("n") > 1, "ambiguous").when(F.col("open"), "indeterminate").otherwise("not_found")
    return j.select("uid", "name", status.alias("status"), F.when(F.col("n") == 1, F.col("slot")).alias("slot"))


def declared_difference(slots_: DataFrame, models: DataFrame) -> DataFrame:
    """(uid, column, status): declared columns the SQL doesn't give: missing where its outputs are all known, else not_enumerated."""
    want = models.where("kind in ('model', 'snapshot')").select("uid", F.explode("columns").alias("column"))
    have = slots_.where("not declared and key is not null").select("uid", F.lower("key").alias("k")).distinct()
    analysed = slots_.where("not declared").groupBy("uid").agg((F.count(F.when(F.col("star").isNotNull(), 1)) > 0).alias("open"))
    gone = want.join(analysed, "uid").join(have, (want["uid"] == have["uid"]) & (F.lower(want["column"]) == have["k"]), "left_anti")
    return gone.select("uid", "column", F.when(F.col("open"), "not_enumerated").otherwise("missing").alias("status"))


def digests(models: DataFrame, edges: DataFrame) -> DataFrame:
    """(uid, digest): a hash of each model and of all it depends on; null on and after cycles, which aren't stored.

    Level by level, a model's digest folds its own content and its dependencies' digests in order.
    """
    own = models.select("uid", F.sha2(F.concat_ws("\x01", "uid", "kind", F.array_join("relation", "."), F.array_join("columns", ","), F.coalesce("sql", F.lit(""))), 256).alias("own"))
    layer = closure.layers(edges.select("src", "dst"), models.select(F.col("uid").alias("node"))).withColumnRenamed("node", "uid")
    own = storage.stored(own.join(layer, "uid"), "own-digests")
    last = own.agg(F.max("layer")).first()[0]
    levels = storage.Levels(models.sparkSession, "uid string, digest string", "digests")
    for at in range((last if last is not None else -1) + 1):
        now = own.where(F.col("layer") == at)
        if at == 0:
            levels.add(now.select("uid", F.col("own").alias("digest")))
            continue
        deps = edges.select("src", F.col("dst").alias("uid")).distinct().join(levels.all().withColumnRenamed("uid", "src"), "src")
        deps = deps.groupBy("uid").agg(F.array_join(F.sort_array(F.collect_list("digest")), ",").alias("d"))
        levels.add(now.join(deps, "uid", "left").select("uid", F.sha2(F.concat_ws("\x02", "own", F.coalesce("d", F.lit(""))), 256).alias("digest")))
    return own.select("uid").join(levels.all(), "uid", "left")
