"""Graph queries over the benchmark tables' project graph, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import schema
from tracewell.functions.patterns import glob_regex
from tracewell.operators import closure, impact, select, subgraph
from tracewell.plans import render
from tracewell.sources import fixture, manifest
from tracewell.sql import dialects

Query = Callable[[SparkSession, str], DataFrame]
START = "seed.tpch.nation_3"
FOCUS = ["model.tpch.customer_7", "model.tpch.supplier_5", "nowhere"]

_BASE = f"nodes AS ({fixture.duckdb(fixture.NODES_SQL)}), edges AS ({fixture.duckdb(fixture.EDGES_SQL)})"
_RANK = "CASE edge_type WHEN 'ref' THEN 0 WHEN 'source' THEN 1 WHEN 'test' THEN 2 ELSE 3 END"
_KIND = "CASE {} WHEN 0 THEN 'ref' WHEN 1 THEN 'source' WHEN 2 THEN 'test' ELSE 'exposure' END"
_SEVERITY = "CASE WHEN node_type = 'exposure' THEN 3 WHEN node_type = 'test' THEN 0 WHEN node_type = 'model' AND (coalesce(materialization IN ('table', 'incremental'), FALSE) OR coalesce(contains(file_path, 'mart'), FALSE)) THEN 2 ELSE 1 END"
_LABEL = "CASE {} WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END"

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def ids(spark: SparkSession, names: list[str]) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "node string")


def reach_sql(start: str, a: str = "src", b: str = "dst", depth: int | None = None, name: str = "r") -> str:
    """A recursive query over distinct (node, distance); UNION drops repeats."""
    limit = f" WHERE {name}.d < {depth}" if depth is not None else ""
    return f"{name}(node, d) AS (SELECT unique_id, 0 FROM nodes WHERE unique_id IN ({start}) UNION SELECT e.{b}, {name}.d + 1 FROM {name} JOIN edges e ON e.{a} = {name}.node{limit})"


@query(f"WITH {_BASE} SELECT node_type, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT unique_id) AS BIGINT) AS distinct_ids FROM nodes GROUP BY node_type")
def graph_nodes(spark, sf_dir):
    return fixture.nodes(spark, sf_dir).groupBy("node_type").agg(F.count("*").alias("n"), F.count_distinct("unique_id").alias("distinct_ids"))


@query(f"WITH {_BASE} SELECT edge_type, CAST({_RANK} AS INT) AS edge_rank, CAST(count(*) AS BIGINT) AS n FROM edges GROUP BY ALL")
def graph_edges(spark, sf_dir):
    return fixture.edges_of(spark, sf_dir, fixture.EDGES_SQL).groupBy("edge_type", "edge_rank").agg(F.count("*").alias("n"))


@query(f"WITH RECURSIVE {_BASE}, {reach_sql(repr(START))} SELECT node, CAST(min(d) AS INT) AS distance FROM r GROUP BY node")
def bfs_downstream(spark, sf_dir):
    return closure.reach(fixture.edges_of(spark, sf_dir, fixture.EDGES_SQL), ids(spark, [START]))


@query(f"WITH RECURSIVE {_BASE}, {reach_sql(repr('exposure.tpch.BUILDING_1-URGENT'), 'dst', 'src', 2)} SELECT node, CAST(min(d) AS INT) AS distance FROM r GROUP BY node")
def bfs_upstream(spark, sf_dir):
    return closure.reach(fixture.edges_of(spark, sf_dir, fixture.EDGES_SQL), ids(spark, ["exposure.tpch.BUILDING_1-URGENT"]), "up", 2)


_FOCUS_SQL = ", ".join(map(repr, FOCUS))
_WINDOW = f"{reach_sql(_FOCUS_SQL, 'dst', 'src', 1, 'u')}, {reach_sql(_FOCUS_SQL, 'src', 'dst', 1, 'w')}, kept AS (SELECT node FROM u UNION SELECT node FROM w)"


@query(f"WITH RECURSIVE {_BASE}, {_WINDOW} SELECT node FROM kept")
def focus_multi(spark, sf_dir):
    nodes, edges = fixture.graph(spark, sf_dir)
    known = ids(spark, FOCUS).join(nodes.select(F.col("unique_id").alias("node")), "node", "left_semi")
    return closure.window(edges, known, 1, 1)


@query(f"WITH RECURSIVE {_BASE}, {_WINDOW} SELECT node FROM kept JOIN nodes ON unique_id = node WHERE tag = '1-URGENT' OR starts_with(coalesce(file_path, ''), 'models/staging/')")
def focus_selector_intersect(spark, sf_dir):
    nodes, _ = fixture.graph(spark, sf_dir)
    return focus_multi(spark, sf_dir).join(select.selected(nodes, "tag:1-URGENT,path:models/staging/"), "node", "left_semi")


@query(f"WITH RECURSIVE {_BASE}, {_WINDOW} SELECT src, dst, edge_type FROM edges WHERE src IN (SELECT node FROM kept) AND dst IN (SELECT node FROM kept)")
def subgraph_induced(spark, sf_dir):
    nodes, edges = fixture.graph(spark, sf_dir)
    return subgraph.induced(nodes, edges, focus_multi(spark, sf_dir))[1].select("src", "dst", "edge_type")


def transitive_sql(keep: str) -> str:
    """Edges among kept nodes (a query of node), direct ones and those through removed nodes."""
    return f"""WITH RECURSIVE {_BASE}, k AS ({keep}), e AS (SELECT src, dst, {_RANK} AS r FROM edges),
w(start, cur, r, through) AS (
  SELECT src, dst, r, 1 FROM e WHERE src IN (SELECT node FROM k) AND dst NOT IN (SELECT node FROM k)
  UNION SELECT w.start, e.dst, greatest(w.r, e.r), w.through + 1 FROM w JOIN e ON e.src = w.cur WHERE e.dst NOT IN (SELECT node FROM k)),
a AS (SELECT w.start AS src, e.dst, greatest(w.r, e.r) AS r, w.through FROM w JOIN e ON e.src = w.cur WHERE e.dst IN (SELECT node FROM k)),
d AS (SELECT src, dst, r FROM e WHERE src IN (SELECT node FROM k) AND dst IN (SELECT node FROM k)),
b AS (SELECT src, dst, min(through) AS through FROM a GROUP BY src, dst),
t AS (SELECT a.src, a.dst, max(a.r) AS r, a.through FROM a JOIN b ON a.src = b.src AND a.dst = b.dst AND a.through = b.through WHERE (a.src, a.dst) NOT IN (SELECT (src, dst) FROM d) GROUP BY ALL)
SELECT src, dst, {_KIND.format("r")} AS edge_type, CAST(NULL AS INT) AS collapsed_through FROM d UNION ALL SELECT src, dst, {_KIND.format("r")}, CAST(through AS INT) FROM t"""


_OUT = ("src", "dst", "edge_type", "collapsed_through")


@query(transitive_sql("SELECT unique_id AS node FROM nodes WHERE node_type IN ('seed', 'exposure')"))
def subgraph_transitive(spark, sf_dir):
    nodes, edges = fixture.graph(spark, sf_dir)
    keep = nodes.where("node_type in ('seed', 'exposure')").select(F.col("unique_id").alias("node"))
    return subgraph.transitive(nodes, edges, keep)[1].select(*_OUT)


@query(transitive_sql("SELECT unique_id AS node FROM nodes WHERE node_type IN ('source', 'model', 'exposure')"))
def filter_node_type(spark, sf_dir):
    nodes, edges = fixture.graph(spark, sf_dir)
    return subgraph.by_type(nodes, edges, ["Source", "MODEL", "exposure"])[1].select(*_OUT)


@query(f"WITH {_BASE} SELECT src, dst, edge_type FROM edges JOIN nodes s ON s.unique_id = src JOIN nodes t ON t.unique_id = dst WHERE s.node_type IN ('model', 'test') AND t.node_type IN ('model', 'test')")
def filter_node_type_direct(spark, sf_dir):
    nodes, edges = fixture.graph(spark, sf_dir)
    return subgraph.by_type(nodes, edges, ["model", "test"], through=False)[1].select("src", "dst", "edge_type")


# Collapsing runs on what a customer depends on and feeds, as a focused graph would.
_NEAR = f"{reach_sql(repr('model.tpch.customer_7'), 'dst', 'src', None, 'before')}, {reach_sql(repr('model.tpch.customer_7'), 'src', 'dst', None, 'after')}, near AS (SELECT node FROM before UNION SELECT node FROM after)"


def _near_sql(keep: str) -> str:
    text = transitive_sql(keep)
    base = f"{_BASE}"
    own = base.replace("nodes AS (", "all_nodes AS (").replace("edges AS (", "all_edges AS (")
    near = _NEAR.replace("FROM nodes", "FROM all_nodes").replace("JOIN edges", "JOIN all_edges")
    return text.replace(base, f"{own}, {near}, nodes AS (SELECT * FROM all_nodes WHERE unique_id IN (SELECT node FROM near)), edges AS (SELECT * FROM all_edges WHERE src IN (SELECT node FROM near) AND dst IN (SELECT node FROM near))")


def _near(spark, sf_dir):
    nodes, edges = fixture.graph(spark, sf_dir)
    return subgraph.induced(nodes, edges, closure.window(edges, ids(spark, ["model.tpch.customer_7"]), None, None))


@query(_near_sql("SELECT unique_id AS node FROM nodes WHERE unique_id NOT IN (SELECT src FROM edges) OR unique_id NOT IN (SELECT dst FROM edges) OR unique_id = 'model.tpch.customer_7'"))
def collapse_endpoints(spark, sf_dir):
    nodes, edges = _near(spark, sf_dir)
    return subgraph.endpoints(nodes, edges, ids(spark, ["model.tpch.customer_7"]))[1].select(*_OUT)


@query(_near_sql("SELECT unique_id AS node FROM nodes WHERE node_type IN ('source', 'exposure') OR unique_id = 'model.tpch.customer_7'"))
def collapse_focal(spark, sf_dir):
    nodes, edges = _near(spark, sf_dir)
    return subgraph.focal(nodes, edges, ids(spark, ["model.tpch.customer_7"]))[1].select(*_OUT)


@query(f"""WITH RECURSIVE events_e AS ({fixture.duckdb(fixture.EVENT_EDGES_SQL)}), p(node, start) AS (SELECT dst, src FROM events_e UNION SELECT e.dst, p.start FROM p JOIN events_e e ON e.src = p.node)
SELECT CAST(count(DISTINCT CASE WHEN node = start THEN start END) AS BIGINT) AS nodes_on_cycles, count(CASE WHEN node = start THEN 1 END) > 0 AS has_cycle FROM p""")
def cycle_detect(spark, sf_dir):
    edges = fixture.edges_of(spark, sf_dir, fixture.EVENT_EDGES_SQL)
    ahead = closure.on_cycles(edges)
    both = closure.on_cycles(ahead.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return both.agg(F.count_distinct("src").alias("nodes_on_cycles"), (F.count("*") > 0).alias("has_cycle"))


@query(f"WITH events_e AS ({fixture.duckdb(fixture.EVENT_EDGES_SQL)}), s AS (SELECT src, min(dst) AS dst FROM events_e GROUP BY src) SELECT CASE WHEN s.dst = s.src THEN s.src || '>' || s.src ELSE s.src || '>' || s.dst || '>' || s.src END AS cycle FROM s WHERE src = (SELECT min(src) FROM s)")
def cycle_path(spark, sf_dir):
    path = closure.find_cycle(fixture.edges_of(spark, sf_dir, fixture.EVENT_EDGES_SQL))
    return spark.createDataFrame([(">".join(path),)] if path else [], "cycle string")


# every edge leads from a kind of node to a later one, which no cycle could
_LATER = "CASE split_part({0}, '.', 1) WHEN 'source' THEN 0 WHEN 'seed' THEN 1 WHEN 'model' THEN CASE WHEN contains({0}, '.order_') THEN 3 ELSE 2 END ELSE 4 END"


@query(f"WITH {_BASE} SELECT bool_and({_LATER.format('src')} < {_LATER.format('dst')}) AS acyclic FROM edges")
def cycle_absent(spark, sf_dir):
    return closure.on_cycles(fixture.edges_of(spark, sf_dir, fixture.EDGES_SQL)).agg((F.count("*") == 0).alias("acyclic"))


@query(f"""WITH RECURSIVE {_BASE}, chain AS ({fixture.duckdb(fixture.CHAIN_EDGES_SQL)}), p(node, layer) AS (SELECT unique_id, 0 FROM nodes WHERE unique_id LIKE 'model.tpch.order_%' AND unique_id NOT IN (SELECT dst FROM chain) UNION SELECT c.dst, p.layer + 1 FROM p JOIN chain c ON c.src = p.node)
SELECT node, CAST(max(layer) AS INT) AS layer FROM p GROUP BY node""")
def topo_layers(spark, sf_dir):
    edges = fixture.edges_of(spark, sf_dir, fixture.CHAIN_EDGES_SQL)
    orders = fixture.nodes(spark, sf_dir).where("unique_id like 'model.tpch.order_%'").select(F.col("unique_id").alias("node"))
    return closure.layers(edges, orders)


@query(f"WITH RECURSIVE {_BASE}, p(node, layer) AS (SELECT unique_id, 0 FROM nodes WHERE unique_id NOT IN (SELECT dst FROM edges) UNION SELECT e.dst, p.layer + 1 FROM p JOIN edges e ON e.src = p.node) SELECT node, CAST(max(layer) AS INT) AS layer FROM p GROUP BY node")
def topo_layers_graph(spark, sf_dir):
    nodes, edges = fixture.graph(spark, sf_dir)
    return closure.layers(edges, nodes.select(F.col("unique_id").alias("node")))


_NAMES = ["seed.tpch.nation_3", "order_7", "model.order_9", "CHINA", "tpch.part_11", "BUILDING_1-URGENT", "customer_1", "absent"]


@query(f"""WITH {_BASE}, names AS (SELECT unnest([{", ".join(map(repr, _NAMES))}]) AS name), hits AS (
SELECT name, 1 AS stage, unique_id FROM names JOIN nodes ON unique_id = name
UNION SELECT name, 2, unique_id FROM names JOIN nodes ON regexp_replace(unique_id, '^([^.]+)\\.[^.]+\\.', '\\1.') = name OR (node_type = 'model' AND string_split(unique_id, '.')[-1] = name)
UNION SELECT name, 3, unique_id FROM names JOIN nodes ON label = name
UNION SELECT name, 4, unique_id FROM names JOIN nodes ON ends_with(unique_id, '.' || name) AND node_type <> 'phantom')
SELECT name, CAST(stage AS INT) AS stage, min(unique_id) AS unique_id, CAST(count(*) AS BIGINT) AS candidates FROM hits h WHERE stage = (SELECT min(stage) FROM hits g WHERE g.name = h.name) GROUP BY name, stage""")
def node_lookup(spark, sf_dir):
    return select.lookup(fixture.nodes(spark, sf_dir), spark.createDataFrame([(n,) for n in _NAMES], "name string"))


def _selected(name: str, text: str, condition: str) -> None:
    def run(spark, sf_dir):
        return select.selected(fixture.nodes(spark, sf_dir), text)

    QUERIES[name] = run
    ORACLES[name] = f"WITH {_BASE} SELECT unique_id AS node FROM nodes WHERE {condition}"


_ALIAS = "regexp_replace(unique_id, '^([^.]+)\\.[^.]+\\.', '\\1.')"
_selected("selector_tag", "tag:1-*", f"regexp_matches(tag, '{glob_regex('1-*', False)}')")
_selected("selector_path", "path:models/**/order_1?.sql", f"regexp_matches(file_path, '{glob_regex('models/**/order_1?.sql')}')")
_selected("selector_name", "customer_1*", f"regexp_matches(label, '^customer_1.*$') OR regexp_matches(unique_id, '^customer_1.*$') OR regexp_matches({_ALIAS}, '^customer_1.*$')")
_selected("selector_union", "tag:BUILDING, path:models/marts/, supplier_7, model.order_3", f"tag = 'BUILDING' OR starts_with(file_path, 'models/marts/') OR label IN ('supplier_7', 'model.order_3') OR {_ALIAS} IN ('supplier_7', 'model.order_3')")


@query(f"WITH {_BASE} SELECT unique_id AS node FROM nodes WHERE (regexp_matches(label, '(?i)^customer') OR coalesce(regexp_matches(description, '(?i)^customer'), FALSE)) AND (regexp_matches(label, '(?i)7$') OR coalesce(regexp_matches(description, '(?i)7$'), FALSE))")
def search(spark, sf_dir):
    return select.search(fixture.nodes(spark, sf_dir), ["^Customer", "7$"])


@query(f"WITH {_BASE} SELECT unique_id, label, node_type, file_path FROM nodes WHERE node_type IN ('seed', 'exposure') AND (regexp_matches(label, '(?i)^b') OR coalesce(regexp_matches(description, '(?i)^b'), FALSE))")
def list_nodes(spark, sf_dir):
    nodes = fixture.nodes(spark, sf_dir).where("node_type in ('seed', 'exposure')")
    return nodes.join(select.search(nodes, ["^b"]).withColumnRenamed("node", "unique_id"), "unique_id", "left_semi").select("unique_id", "label", "node_type", "file_path")


@query(f"WITH {_BASE} SELECT unique_id, label FROM nodes WHERE contains(lower(label), 'building') OR contains(lower(unique_id), 'building') OR coalesce(contains(lower(description), 'building'), FALSE) OR coalesce(contains(lower(tag), 'building'), FALSE) OR coalesce(contains(lower(file_path), 'building'), FALSE)")
def list_substring(spark, sf_dir):
    return select.substring(fixture.nodes(spark, sf_dir), "Building").select("unique_id", "label")


@query(f"WITH {_BASE} SELECT CAST(row_number() OVER (ORDER BY label, unique_id) AS INT) AS position, label, unique_id FROM nodes QUALIFY position > 50 AND position <= 75")
def page_limit(spark, sf_dir):
    return select.page(fixture.nodes(spark, sf_dir), ["label", "unique_id"], 25, 50).select("position", "label", "unique_id")


@query(f"WITH {_BASE}, k AS (SELECT unnest([{', '.join(map(repr, schema.NODE_KINDS))}]) AS node_type) SELECT k.node_type, CAST(count(unique_id) AS BIGINT) AS n FROM k LEFT JOIN nodes ON nodes.node_type = k.node_type GROUP BY k.node_type UNION ALL SELECT 'total', CAST(count(*) AS BIGINT) FROM nodes UNION ALL SELECT 'edges', CAST(count(*) AS BIGINT) FROM edges UNION ALL SELECT 'vars', CAST(2 AS BIGINT)")
def summary_counts(spark, sf_dir):
    return select.summary(fixture.nodes(spark, sf_dir), fixture.edges_sql(spark, sf_dir), {"region": "north", "days": 3})


_IMPACT = f"WITH RECURSIVE {_BASE}, {reach_sql(repr(START))}, m AS (SELECT node, min(d) AS distance FROM r GROUP BY node HAVING min(d) > 0), i AS (SELECT n.*, CAST(distance AS INT) AS distance, CAST({_SEVERITY} AS INT) AS severity_rank FROM m JOIN nodes n ON unique_id = node)"


def _impact(spark, sf_dir):
    nodes, edges = fixture.graph(spark, sf_dir)
    return impact.impact(nodes, edges, ids(spark, [START]))


@query(f"{_IMPACT} SELECT unique_id, node_type, distance, {_LABEL.format('severity_rank')} AS severity FROM i")
def impact_nodes(spark, sf_dir):
    return _impact(spark, sf_dir).select("unique_id", "node_type", "distance", "severity")


@query(f"{_IMPACT} SELECT severity_rank, {_LABEL.format('severity_rank')} AS severity, CAST(count(*) AS BIGINT) AS n FROM i GROUP BY severity_rank")
def impact_severity(spark, sf_dir):
    return _impact(spark, sf_dir).groupBy("severity_rank", "severity").agg(F.count("*").alias("n"))


@query(f"{_IMPACT} SELECT CAST(count(*) FILTER (node_type = 'model') AS BIGINT) AS affected_models, CAST(count(*) FILTER (node_type = 'test') AS BIGINT) AS affected_tests, CAST(count(*) FILTER (node_type = 'exposure') AS BIGINT) AS affected_exposures, {_LABEL.format('coalesce(max(severity_rank), 0)')} AS overall_severity FROM i")
def impact_counts(spark, sf_dir):
    return impact.counts(_impact(spark, sf_dir))


@query(f"{_IMPACT} SELECT CAST(row_number() OVER (ORDER BY severity_rank DESC, distance, unique_id) AS INT) AS position, unique_id FROM i QUALIFY position <= 100")
def impact_order(spark, sf_dir):
    rows = _impact(spark, sf_dir).withColumn("bad", -F.col("severity_rank"))
    return select.page(rows, ["bad", "distance", "unique_id"], 100).select("position", "unique_id")


@query(f"""WITH RECURSIVE {_BASE}, {reach_sql(repr('exposure.tpch.BUILDING_1-URGENT'))}, m AS (SELECT DISTINCT node FROM r WHERE d > 0)
SELECT {_LABEL.format(f"coalesce((SELECT max({_SEVERITY}) FROM m JOIN nodes ON unique_id = node), 0)")} AS overall_severity""")
def impact_overall_none(spark, sf_dir):
    nodes, edges = fixture.graph(spark, sf_dir)
    return impact.counts(impact.impact(nodes, edges, ids(spark, ["exposure.tpch.BUILDING_1-URGENT"]))).select("overall_severity")


_PATHS = f"""WITH RECURSIVE {_BASE}, p(node, path) AS (SELECT 'model.tpch.customer_7', ['model.tpch.customer_7'] UNION ALL SELECT e.dst, list_append(p.path, e.dst) FROM p JOIN (SELECT DISTINCT src, dst FROM edges) e ON e.src = p.node WHERE NOT list_contains(p.path, e.dst)),
x AS (SELECT node AS exposure, array_to_string(path, '>') AS path, CAST(row_number() OVER (PARTITION BY node ORDER BY len(path), array_to_string(path, '>')) AS INT) AS rank FROM p WHERE starts_with(node, 'exposure.'))"""


@query(f"{_PATHS} SELECT * FROM x WHERE rank <= 10")
def exposure_paths(spark, sf_dir):
    nodes, edges = fixture.graph(spark, sf_dir)
    return impact.exposure_paths(nodes, edges, ids(spark, ["model.tpch.customer_7"]))[0]


@query(f"{_PATHS.replace('customer_7', 'supplier_5')} SELECT exposure, max(rank) >= 10 AS truncated FROM x GROUP BY exposure")
def exposure_truncated(spark, sf_dir):
    nodes, edges = fixture.graph(spark, sf_dir)
    return impact.exposure_paths(nodes, edges, ids(spark, ["model.tpch.supplier_5"]))[1]


def _shown(alias: str) -> str:
    prefix = " ".join(f"WHEN '{k}' THEN '{p}'" for k, p in schema.NODE_KINDS.items())
    return f"CASE {alias}.node_type {prefix} ELSE '' END || {alias}.label"


@query(f"WITH {_BASE} SELECT {_shown('a')} || ' -> ' || {_shown('b')} || ' [' || edge_type || ']' AS line FROM edges JOIN nodes a ON a.unique_id = src JOIN nodes b ON b.unique_id = dst WHERE b.node_type = 'test'")
def render_plain(spark, sf_dir):
    nodes = fixture.nodes(spark, sf_dir)
    tests = nodes.where("node_type = 'test'").select(F.col("unique_id").alias("dst"))
    return render.plain_lines(nodes, fixture.edges_sql(spark, sf_dir).join(tests, "dst", "left_semi").withColumn("collapsed_through", F.lit(None).cast("int")))


@query(f"WITH {_BASE} SELECT node_type || chr(9) || label AS value FROM nodes WHERE node_type IN ('seed', 'exposure')")
def render_listing(spark, sf_dir):
    return render.listing(fixture.nodes(spark, sf_dir).where("node_type in ('seed', 'exposure')"))


@query(f"WITH {_BASE} SELECT unique_id, '{{\"unique_id\":\"' || unique_id || '\",\"label\":\"' || label || '\",\"node_type\":\"' || node_type || '\"}}' AS value FROM nodes WHERE node_type IN ('seed', 'source')")
def render_json_nodes(spark, sf_dir):
    nodes = fixture.nodes(spark, sf_dir).where("node_type in ('seed', 'source')")
    return nodes.select("unique_id", F.to_json(F.struct("unique_id", "label", "node_type")).alias("value"))


#: A manifest for each supplier, by the key's remainder: sound, not JSON, of a newer schema with a kind and an edge that nothing knows.
_MANIFEST = """SELECT 'm' || CAST(s_suppkey AS STRING) AS path, CASE s_suppkey % 3 WHEN 0 THEN '{"nodes": {}, "sources": {}}' WHEN 1 THEN '{"nodes": ' ELSE '{"metadata": {"dbt_schema_version": "x/v40.json"}, "sources": {}, "nodes": {"model.p.m' || CAST(s_suppkey AS STRING) || '": {"name": "m", "resource_type": "model", "depends_on": {"nodes": ["model.p.no"]}}, "odd.p.x": {"name": "x", "resource_type": "odd"}}}' END AS text FROM {supplier}"""


@query("""SELECT 'm' || s_suppkey AS path, level, replace(what, '{k}', CAST(s_suppkey AS VARCHAR)) AS what FROM supplier JOIN (VALUES (1, 'error', 'manifest'), (2, 'warning', 'metadata'), (2, 'warning', 'model.p.m{k}'), (2, 'warning', 'odd.p.x')) v(r, level, what) ON s_suppkey % 3 = r""")
def manifest_diagnostics(spark, sf_dir):
    # braces of the text aren't the statement's parameters
    texts = spark.sql(_MANIFEST.replace("{", "{{").replace("}", "}}").replace("{{supplier}}", "{supplier}"), supplier=spark.read.parquet(f"{sf_dir}/supplier.parquet"))
    return manifest.diagnostics(texts).select("path", "level", "what")


_DIALECTS = [("sqlserver", "tsql"), ("PostgreSQL", "postgres"), ("athena", "trino"), ("snowflake", "snowflake"), ("materialize", "postgres"), ("oracle", "generic"), ("", "generic")]


@query(f"SELECT s_suppkey % {len(_DIALECTS)} AS k, dialect, CAST(count(*) AS BIGINT) AS n FROM (SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey FROM supplier) s JOIN (VALUES {', '.join(f'({i}, {d!r})' for i, (_, d) in enumerate(_DIALECTS))}) v(i, dialect) ON s_suppkey % {len(_DIALECTS)} = i GROUP BY ALL")
def dialect_detect(spark, sf_dir):
    k = spark.read.parquet(f"{sf_dir}/supplier.parquet").select((F.col("s_suppkey").cast("long") % len(_DIALECTS)).alias("k"))
    name = F.element_at(F.array(*[F.lit(n) for n, _ in _DIALECTS]), (F.col("k") + 1).cast("int"))
    return k.select("k", dialects.column(name).alias("dialect")).groupBy("k", "dialect").agg(F.count("*").alias("n"))
