"""Column-lineage queries over generated projects, with closed forms in DuckDB's SQL, and over a small written project."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import storage
from tracewell.operators import columns, gaps

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def generated(spark: SparkSession, family: str, width: int, size: int) -> DataFrame:
    """A project of a family: deep or wide (a chain of `size` models), fanout (one base and `size` branches), volume (a
    chain of one model and `size` unrelated ones), every model selecting all `width` columns from what it reads."""
    cols = F.transform(F.sequence(F.lit(1), F.lit(width)), lambda i: F.concat(F.lit("c"), F.lpad(i.cast("string"), 4, "0")))
    uid = lambda n: F.concat(F.lit("model.gen.m"), F.lpad(n.cast("string"), 5, "0"))
    name = lambda n: F.concat(F.lit("m"), F.lpad(n.cast("string"), 5, "0"))
    n = spark.range(1, size + 1 + (family in ("fanout", "volume"))).withColumnRenamed("id", "n")
    if family in ("deep", "wide"):
        up = F.when(F.col("n") == 1, F.lit(None)).otherwise(F.col("n") - 1)
    elif family == "fanout":
        up = F.when(F.col("n") > 1, F.lit(1))
    else:
        up = F.lit(None)
    n = n.withColumn("up", up.cast("long"))
    dep, rel = F.coalesce(uid(F.col("up")), F.lit("source.gen.raw.base")), F.coalesce(name(F.col("up")), F.lit("base"))
    empty = F.array().cast("array<string>")
    models = n.select(uid(F.col("n")).alias("uid"), F.lit("model").alias("kind"), F.array(F.lit("db"), F.lit("main"), name(F.col("n"))).alias("relation"), empty.alias("columns"), F.concat(F.lit("select "), F.array_join(cols, ", "), F.lit(" from db.main."), rel).alias("sql"), F.array(dep).alias("depends_on"))
    source = spark.range(1).select(F.lit("source.gen.raw.base").alias("uid"), F.lit("source").alias("kind"), F.array(F.lit("db"), F.lit("main"), F.lit("base")).alias("relation"), cols.alias("columns"), F.lit(None).cast("string").alias("sql"), empty.alias("depends_on"))
    return models.unionByName(source)


_COL = "'c' || lpad(CAST(c AS VARCHAR), 4, '0')"
_UID = "'model.gen.m' || lpad(CAST(m AS VARCHAR), 5, '0')"


def _grid(width: int, models: int) -> str:
    return f"FROM generate_series(1, {width}) g(c), generate_series(1, {models}) h(m)"


def _upstream(name: str, family: str, width: int, size: int, models: int, distance: str) -> None:
    def run(spark, sf_dir):
        m = storage.stored(generated(spark, family, width, size), "generated")
        return columns.upstream(columns.slots(m, "duckdb"), m)

    QUERIES[name] = run
    ORACLES[name] = f"SELECT {_UID} || '#' || {_COL} AS root, 'source.gen.raw.base#' || {_COL} AS source, CAST({distance} AS INT) AS distance, 'external_relation' AS boundary {_grid(width, models)}"


_upstream("col_upstream_deep", "deep", 25, 16, 16, "m")
_upstream("col_upstream_wide", "wide", 100, 8, 8, "m")
_upstream("col_upstream_fanout", "fanout", 25, 32, 33, "CASE WHEN m = 1 THEN 1 ELSE 2 END")
_upstream("col_upstream_volume", "volume", 50, 200, 201, "1")


@query(f"SELECT 'source.gen.raw.base#c0001' AS root, {_UID} || '#c0001' AS node, CAST(CASE WHEN m = 1 THEN 1 ELSE 2 END AS INT) AS distance FROM generate_series(1, 33) h(m)")
def col_downstream_confirmed(spark, sf_dir):
    s = columns.slots(generated(spark, "fanout", 25, 32), "duckdb")
    return columns.downstream(s, spark.createDataFrame([("source.gen.raw.base#c0001",)], "node string"))


@query(f"SELECT {_UID} AS uid, CAST(25 AS BIGINT) AS listed, CAST(25 AS BIGINT) AS complete, CAST(0 AS BIGINT) AS partial, FALSE AS open FROM generate_series(1, 16) h(m) UNION ALL SELECT 'source.gen.raw.base', 25, 25, 0, FALSE")
def col_counts(spark, sf_dir):
    return columns.counts(columns.slots(generated(spark, "deep", 25, 16), "duckdb"))


#: A small project written for these queries: (uid, kind, relation, declared columns, SQL, dependencies).
PROJECT = [
    ("source.shop.raw.orders", "source", "shop.raw.orders", "id user_id order_date status", None, ""),
    ("source.shop.raw.payments", "source", "shop.raw.payments", "id order_id amount method", None, ""),
    ("source.shop.raw.events", "source", "shop.raw.events", "id", None, ""),
    ("seed.shop.countries", "seed", "shop.main.countries", "code name", None, ""),
    ("model.shop.stg_orders", "model", "shop.main.stg_orders", "order_id customer_id ghost", "with src as (select * from shop.raw.orders) select id as order_id, user_id as customer_id, order_date, status from src", "source.shop.raw.orders"),
    ("model.shop.stg_payments", "model", "shop.main.stg_payments", "", "select id as payment_id, order_id, amount / 100 as amount, method from shop.raw.payments", "source.shop.raw.payments"),
    ("model.shop.orders", "model", "shop.main.orders", "", "select o.*, p.total from shop.main.stg_orders o left join (select order_id, sum(amount) as total from shop.main.stg_payments group by 1) p using (order_id)", "model.shop.stg_orders model.shop.stg_payments"),
    ("model.shop.customers", "model", "shop.main.customers", "", "select customer_id, count(*) as n_orders, sum(total) as lifetime_value, case when max(total) > 10 then 'big' else 'small' end as size from shop.main.orders group by customer_id", "model.shop.orders"),
    ("model.shop.twice", "model", "shop.main.twice", "", "select id, * from shop.raw.orders", "source.shop.raw.orders"),
    ("model.shop.union", "model", "shop.main.union_all", "", "select id, amount from shop.raw.payments union all select order_id, null from shop.main.stg_orders", "source.shop.raw.payments model.shop.stg_orders"),
    ("model.shop.broken", "model", "shop.main.broken", "x", "select (", ""),
    ("model.shop.loose", "model", "shop.main.loose", "", "select status, a.amount from shop.main.stg_orders s cross join elsewhere a", "model.shop.stg_orders"),
    ("model.shop.constant", "model", "shop.main.constant", "", "select 1 as one, current_date as today", ""),
    ("model.shop.missing", "model", "shop.main.missing", "a b", None, ""),
]


def project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The project once for every supplier, `shop` being the supplier's own; stored."""
    rows = [(u, k, r, c.split(), s, d.split()) for u, k, r, c, s, d in PROJECT]
    one = spark.createDataFrame(rows, "uid string, kind string, relation string, columns array<string>, sql string, depends_on array<string>")
    keys = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(F.lit("shop"), F.col("s_suppkey").cast("string")).alias("own"))
    own = lambda c: F.replace(c, F.lit("shop"), F.col("own"))
    made = F.broadcast(one.groupBy().agg(F.collect_list(F.struct(*one.columns)).alias("rows")))  # one row: the project's text
    x = keys.join(made).select("own", F.explode("rows").alias("r"))
    return storage.stored(x.select(own(F.col("r.uid")).alias("uid"), F.col("r.kind").alias("kind"), F.split(own(F.col("r.relation")), "[.]").alias("relation"), F.col("r.columns").alias("columns"), own(F.col("r.sql")).alias("sql"), F.transform("r.depends_on", own).alias("depends_on")), "project")


def each(spark: SparkSession, sf_dir: str, rows: list[tuple], schema: str = "node string") -> DataFrame:
    """The rows once for every supplier, `shop` being the supplier's own."""
    one = spark.createDataFrame(rows, schema)
    keys = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(F.lit("shop"), F.col("s_suppkey").cast("string")).alias("own"))
    made = F.broadcast(one.groupBy().agg(F.collect_list(F.struct(*one.columns)).alias("rows")))
    return keys.join(made).select("own", F.explode("rows").alias("r")).select(*[F.replace(F.col(f"r.{c}"), F.lit("shop"), F.col("own")).alias(c) for c in one.columns])


def _values(cols: str, rows: list[tuple], types: str = "") -> str:
    """The rows once for every supplier, `shop` being the supplier's own."""

    def lit(x) -> str:
        return "NULL" if x is None else str(x) if isinstance(x, int | bool) else "'" + str(x).replace("'", "''") + "'"

    names = [c.strip() for c in cols.split(",")]
    text = [any(isinstance(r[i], str) for r in rows) for i in range(len(names))]
    said = ", ".join(f"replace({n}, 'shop', 'shop' || s_suppkey) AS {n}" if t else n for n, t in zip(names, text, strict=True))
    return f"SELECT {said} FROM supplier, (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) v({cols})"


_S, _M = "source.shop.raw.", "model.shop."


@query(
    _values(
        "root, source, boundary",
        [
            (_M + "customers#customer_id", _S + "orders#user_id", "external_relation"),
            (_M + "customers#lifetime_value", _S + "payments#amount", "external_relation"),
            (_M + "customers#n_orders", _M + "customers#n_orders", "source_free"),
            (_M + "customers#size", _S + "payments#amount", "external_relation"),
        ],
    )
)
def col_upstream(spark, sf_dir):
    m = project(spark, sf_dir)
    s = columns.slots(m, "duckdb")
    roots = s.where("uid like 'model.shop%.customers'").select(columns.node().alias("node"))
    return columns.upstream(s, m, roots).select("root", "source", "boundary")


@query(_values("uid, slot, name, transform", [(_M + "orders", 0, "order_id", "direct"), (_M + "orders", 1, "customer_id", "direct"), (_M + "orders", 2, "order_date", "direct"), (_M + "orders", 3, "status", "direct"), (_M + "orders", 4, "total", "aggregation")]))
def col_lineage_model(spark, sf_dir):
    return columns.slots(project(spark, sf_dir), "duckdb").where("uid like 'model.shop%.orders'").select("uid", "slot", "name", "transform")


@query(_values("uid, status, reason", [(_M + "broken", "partial", "analysis_failed"), (_M + "missing", "partial", "missing_definition"), (_M + "missing", "partial", "missing_definition"), (_M + "loose", "partial", "ambiguous")]))
def trace_boundaries(spark, sf_dir):
    s = columns.slots(project(spark, sf_dir), "duckdb").where("not complete")
    return s.select("uid", F.lit("partial").alias("status"), F.col("reasons")[0]["kind"].alias("reason"))


@query(_values("uid, column_name, status", [(_M + "stg_orders", "ghost", "missing")]))
def yaml_sql_difference(spark, sf_dir):
    m = project(spark, sf_dir)
    return columns.declared_difference(columns.slots(m, "duckdb"), m).withColumnRenamed("column", "column_name")


@query(_values("uid, name, status, slot", [(_M + "orders", "TOTAL", "found", 4), (_M + "twice", "id", "ambiguous", None), (_M + "orders", "nothing", "not_found", None)]))
def col_select(spark, sf_dir):
    want = each(spark, sf_dir, [(_M + "orders", "TOTAL"), (_M + "twice", "id"), (_M + "orders", "nothing")], "uid string, name string")
    return columns.select(columns.slots(project(spark, sf_dir), "duckdb"), want)


@query(_values("node, distance", [(_M + "orders#total", 2), (_M + "customers#lifetime_value", 3), (_M + "customers#size", 3), (_M + "stg_payments#amount", 1), (_M + "union#amount", 1)]))
def col_downstream(spark, sf_dir):
    s = columns.slots(project(spark, sf_dir), "duckdb")
    return columns.downstream(s, each(spark, sf_dir, [(_S + "payments#amount",)])).select("node", "distance")


@query(_values("node", [(_M + "loose#status",)]))
def col_downstream_possible(spark, sf_dir):
    m = project(spark, sf_dir)
    return columns.possible(columns.slots(m, "duckdb"), each(spark, sf_dir, [(_M + "stg_orders#status",)]), m)


@query(f"SELECT CAST(count(*) * {len(PROJECT)} AS BIGINT) AS models, CAST(count(*) * {len(PROJECT)} AS BIGINT) AS digests, TRUE AS changed, CAST(count(*) * 4 AS BIGINT) AS n_changed FROM supplier")
def semantic_digest(spark, sf_dir):
    m = storage.stored(project(spark, sf_dir), "project")
    e = m.select(F.explode("depends_on").alias("src"), F.col("uid").alias("dst"))
    a = columns.digests(m, e)
    edited = m.withColumn("sql", F.when(F.col("uid").endswith(".stg_payments"), F.concat("sql", F.lit(" where amount > 0"))).otherwise(F.col("sql")))
    edited = edited.withColumn("columns", F.when(F.col("uid").endswith(".missing"), F.array(F.lit("a"))).otherwise(F.col("columns")))
    b = columns.digests(edited, e).withColumnRenamed("digest", "other")
    return a.join(b, "uid").agg(F.count("*").alias("models"), F.count_distinct("digest").alias("digests"), (F.count(F.when(F.col("digest") != F.col("other"), 1)) > 0).alias("changed"), F.count(F.when(F.col("digest") != F.col("other"), 1)).alias("n_changed"))


#: Columns whose impact is asked for.
ASKED = [(_S + "payments#amount",), (_M + "stg_orders#status",), (_M + "stg_payments#method",), (_M + "customers#size",), (_M + "twice#id",), (_M + "orders#nothing",), (_S + "orders#id",)]


def _exploring(spark, sf_dir):
    m = project(spark, sf_dir)
    return storage.stored(columns.slots(m, "duckdb"), "slots"), m, each(spark, sf_dir, ASKED, "node string")


@query(_values("input, gap, place, detail", GAPS := [
    (_M + "stg_orders#status", "unresolved_lineage", _M + "loose#status", "ambiguous status"),
    (_S + "orders#id", "unresolved_lineage", _M + "loose#status", "ambiguous status"),
    (_M + "twice#id", "unidentified_input", _M + "twice", "2 outputs"),
    (_M + "orders#nothing", "unidentified_input", _M + "orders", "0 outputs"),
]))
def exploration_gaps(spark, sf_dir):
    return gaps.gaps(*_exploring(spark, sf_dir)).withColumnRenamed("at", "place")


@query(_values("input, confirmed, possible, gaps, status, no_impact", [
    (_S + "payments#amount", 5, 0, 0, "complete", False),
    (_M + "stg_orders#status", 1, 1, 1, "incomplete", False),
    (_M + "stg_payments#method", 0, 0, 0, "complete", True),
    (_M + "customers#size", 0, 0, 0, "complete", True),
    (_M + "twice#id", 0, 0, 1, "incomplete", False),
    (_M + "orders#nothing", 0, 0, 1, "incomplete", False),
    (_S + "orders#id", 4, 1, 1, "incomplete", False),
]))
def no_impact(spark, sf_dir):
    return gaps.exploration(*_exploring(spark, sf_dir))


@query(_values("input, gap, place, detail", [g for g in GAPS if g[1] == "unidentified_input"]))
def unidentified_input(spark, sf_dir):
    return gaps.gaps(*_exploring(spark, sf_dir)).where("gap = 'unidentified_input'").withColumnRenamed("at", "place")


@query(_values("input, relation, relevance", [
    (_M + "stg_orders#status", "shop.main.orders", "relevant"),
    (_M + "stg_orders#status", "shop.main.stg_payments", "unrelated"),
    (_M + "stg_orders#status", "shop.main.nowhere", "unrelated"),
    (_M + "stg_payments#amount", "SHOP.MAIN.CUSTOMERS", "relevant"),
]).replace("'SHOP.MAIN.CUSTOMERS'", "'shop.MAIN.CUSTOMERS'"))
def relation_relevance(spark, sf_dir):
    m = project(spark, sf_dir)
    asked = each(spark, sf_dir, [(_M + "stg_orders#status", "shop.main.orders"), (_M + "stg_orders#status", "shop.main.stg_payments"), (_M + "stg_orders#status", "shop.main.nowhere"), (_M + "stg_payments#amount", "shop.MAIN.CUSTOMERS")], "input string, relation string")
    return gaps.relevance(asked, m, storage.stored(gaps.behind(m, asked.select(F.col("input").alias("node")).distinct()), "behind"))


@query(_values("src, dst", [(_S + "orders", _M + "stg_orders"), (_S + "payments", _M + "stg_payments"), (_M + "stg_orders", _M + "orders"), (_M + "stg_payments", _M + "orders"), (_M + "orders", _M + "customers"), (_S + "orders", _M + "twice"), (_S + "payments", _M + "union"), (_M + "stg_orders", _M + "union"), (_M + "stg_orders", _M + "loose")]))
def downstream_map(spark, sf_dir):
    return gaps.downstream_map(project(spark, sf_dir))


@query(_values("root, path, transform", [
    (_M + "customers#lifetime_value", _M + "customers#lifetime_value>" + _M + "orders#total>" + _M + "stg_payments#amount>" + _S + "payments#amount", "aggregation"),
    (_M + "customers#customer_id", _M + "customers#customer_id>" + _M + "orders#customer_id>" + _M + "stg_orders#customer_id>" + _S + "orders#user_id", "direct"),
    (_M + "union#id", _M + "union#id>" + _M + "stg_orders#order_id>" + _S + "orders#id", "direct"),
    (_M + "union#id", _M + "union#id>" + _S + "payments#id", "direct"),
]))
def col_upstream_paths(spark, sf_dir):
    s = columns.slots(project(spark, sf_dir), "duckdb")
    return gaps.paths(s, each(spark, sf_dir, [(_M + "customers#lifetime_value",), (_M + "customers#customer_id",), (_M + "union#id",)])).select("root", "path", "transform")


@query(_values("node, path, transform", [
    (_M + "stg_payments#amount", _S + "payments#amount>" + _M + "stg_payments#amount", "expression"),
    (_M + "union#amount", _S + "payments#amount>" + _M + "union#amount", "direct"),
    (_M + "orders#total", _S + "payments#amount>" + _M + "stg_payments#amount>" + _M + "orders#total", "aggregation"),
    (_M + "customers#lifetime_value", _S + "payments#amount>" + _M + "stg_payments#amount>" + _M + "orders#total>" + _M + "customers#lifetime_value", "aggregation"),
    (_M + "customers#size", _S + "payments#amount>" + _M + "stg_payments#amount>" + _M + "orders#total>" + _M + "customers#size", "aggregation"),
]))
def col_downstream_paths(spark, sf_dir):
    return gaps.paths(columns.slots(project(spark, sf_dir), "duckdb"), each(spark, sf_dir, [(_S + "payments#amount",)]), "down").select("node", "path", "transform")


#: Claims about suppliers' relations, by the key's remainder: the same twice, an order added, another column.
_CLAIMS = """SELECT 't' || s_suppkey AS relation, 'a' AS one, 'b' AS two, true AS exhaustive, {0} AS ordered, 'e1' AS evidence FROM {{supplier}}
UNION ALL SELECT 't' || s_suppkey, 'a', CASE WHEN s_suppkey % 3 = 2 THEN 'c' ELSE 'b' END, true, s_suppkey % 3 = 1, 'e2' FROM {{supplier}}"""


@query("SELECT 't' || s_suppkey AS relation, CASE s_suppkey % 3 WHEN 0 THEN 'agreed' WHEN 1 THEN 'refined' ELSE 'conflicted' END AS status, CASE WHEN s_suppkey % 3 = 2 THEN NULL ELSE 'a,b' END AS columns, s_suppkey % 3 = 1 AS ordered, 'e1,e2' AS evidence FROM supplier")
def schema_conflict(spark, sf_dir):
    c = spark.sql(_CLAIMS.format("false"), supplier=spark.read.parquet(f"{sf_dir}/supplier.parquet"))
    out = gaps.conflicts(c.select("relation", F.array("one", "two").alias("columns"), "exhaustive", "ordered", "evidence"))
    return out.select("relation", "status", F.array_join("columns", ",").alias("columns"), "ordered", F.array_join("evidence", ",").alias("evidence"))


@query("SELECT s_suppkey AS uid, CASE WHEN s_suppkey % 4 = 0 THEN 'sql' WHEN s_suppkey % 4 = 1 THEN 'header' ELSE 'declared' END AS basis, CASE WHEN s_suppkey % 4 = 0 THEN 's' WHEN s_suppkey % 4 = 1 THEN 'h' ELSE 'd' END AS columns FROM (SELECT CAST(s_suppkey AS VARCHAR) AS uid, CAST(s_suppkey AS BIGINT) AS s_suppkey FROM supplier) x")
def schema_adoption(spark, sf_dir):
    k = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("uid"))
    empty = F.array().cast("array<string>")
    sql = k.where("uid % 4 = 0").select("uid", F.array(F.lit("s")).alias("columns"))
    header = k.where("uid % 4 <> 3").select("uid", F.array(F.lit("h")).alias("columns"))
    declared = k.select("uid", F.when(F.col("uid") % 4 == 1, empty).otherwise(F.array(F.lit("d"))).alias("columns"))
    return gaps.adopted(sql, header, declared).select("uid", "basis", F.array_join("columns", ",").alias("columns"))


@query("SELECT 'r' || s_suppkey || x AS id FROM supplier, (VALUES ('_0'), ('_1'), ('_2')) v(x)")
def evidence_closure(spark, sf_dir):
    k = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(F.lit("r"), F.col("s_suppkey").cast("string")).alias("k"))
    derived = k.select(F.explode(F.array(*[F.struct(F.concat("k", F.lit(f"_{i}")).alias("id"), F.concat("k", F.lit(f"_{i + 1}")).alias("from")) for i in (0, 1, 3)])).alias("x")).select("x.*")
    return gaps.evidence(k.select(F.concat("k", F.lit("_0")).alias("id")), derived)


@query("SELECT 'models/m' || s_suppkey || '.sql' AS path, CASE s_suppkey % 3 WHEN 0 THEN 'stale' ELSE 'deleted' END AS state FROM supplier WHERE s_suppkey % 3 < 2 UNION ALL SELECT '../m' || s_suppkey || '.sql', 'unverified:invalid_resource_path' FROM supplier UNION ALL SELECT 'pack', 'unverified:package'")
def manifest_freshness(spark, sf_dir):
    k = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("k"))
    path = F.concat(F.lit("models/m"), F.col("k").cast("string"), F.lit(".sql"))
    day = F.when(F.col("k") % 3 == 0, F.lit("2024-03-02")).otherwise(F.lit("2024-02-01")).cast("timestamp")
    files = k.where("k % 3 <> 1").select(path.alias("path"), day.alias("modified"))
    none = F.lit(None).cast("string")
    asked = k.select(none.alias("package"), path.alias("path")).union(k.select(none, F.concat(F.lit("../m"), F.col("k").cast("string"), F.lit(".sql")))).union(k.select(F.lit("pack"), path))
    return gaps.freshness(files, asked, F.lit("2024-03-01").cast("timestamp"), "shop", "shop")
