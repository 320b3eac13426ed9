"""Projects of SQL and YAML files as queries: the files are made from the supplier table, so they grow with it.

A supplier k has a staging model over a source table, a mart, YAML that declares them, and, by k's remainders, a
snapshot, a singular test, a versioned model and names that nothing has. DuckDB states the graph in closed form.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import storage
from tracewell.plans import template_cases
from tracewell.project import build, scan

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, oracle
        return f

    return add


#: path, content, condition on k.
FILES = [
    ("models/staging/stg_{k}.sql", "{{{{ config(materialized='view') }}}}\nselect id, amount, 'x' as note from {{{{ source('raw', 't_{k}') }}}}", "true"),
    ("models/marts/mart_{k}.sql", "{{{{ config(materialized='table', tags=['mart']) }}}}\nselect s.id, sum(s.amount) as total\nfrom {{{{ ref('stg_{k}') }}}} s join {{{{ ref('seed_{r}') }}}} using (id)\n{{% if is_incremental() %}}left join {{{{ ref('stg_{p}') }}}} using (id){{% endif %}}", "k > 1"),
    ("models/marts/odd_{k}.sql", "select * from {{{{ ref('missing_{k}') }}}} join {{{{ source('raw', 'gone_{k}') }}}} using (id)", "k % 7 = 0"),
    ("models/wide/wide_{k}_v1.sql", "select id from {{{{ ref('stg_{k}') }}}}", "k % 5 = 0"),
    ("models/wide/wide_{k}_new.sql", "select id, note from {{{{ ref('wide_{k}', v=1) }}}}", "k % 5 = 0"),
    ("models/wide/user_{k}.sql", "select id from {{{{ ref('wide_{k}') }}}}", "k % 5 = 0"),
    ("snapshots/snap_{k}.sql", "{{% snapshot snap_{k} %}}select * from {{{{ ref('stg_{k}') }}}}{{% endsnapshot %}}", "k % 4 = 0"),
    ("tests/check_{k}.sql", "select * from {{{{ ref('stg_{k}') }}}} where amount < 0", "k % 3 = 0"),
    ("seeds/seed_{k}.csv", "id,\"full name\",rate\r\n1,a,2\r\n", "k < 5"),
    ("models/schema_{k}.yml", """version: 2
sources:
  - name: raw
    tables:
      - name: t_{k}
        columns:
          - name: id
            tests: [not_null]
models:
  - name: stg_{k}
    description: staging of {k}
    columns:
      - name: id
        data_tests:
          - unique
          - unique
          - relationships:
              to: ref('seed_{r}')
              field: id
  - name: wide_{k}
    versions:
      - v: 1
      - v: 2
        defined_in: wide_{k}_new
exposures:
  - name: board_{k}
    type: dashboard
    owner: {{name: desk, email: ""}}
    depends_on:
      - ref('stg_{k}')
      - source('raw', 't_{k}')
      - ref('nowhere_{k}')
semantic_models:
  - name: sem_{k}
    model: ref('stg_{k}')
    measures:
      - name: sum_{k}
metrics:
  - name: total_{k}
    type: simple
    type_params: {{measure: sum_{k} }}
  - name: share_{k}
    type: ratio
    type_params: {{numerator: total_{k}, denominator: {{name: total_{k} }} }}
saved_queries:
  - name: board_query_{k}
    query_params: {{metrics: [share_{k}]}}
""", "true"),
    ("notes/readme_{k}.sql", "select {{{{ ref('stg_{k}') }}}}", "k % 2 = 0"),
]


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): seed_0 to seed_4 stand under k below 5, r being k % 5 and p the k before."""
    k = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("k"))

    def text(x: str) -> F.Column:
        out = F.lit(x.replace("{{", "\x01").replace("}}", "\x02"))
        for name, v in (("{k}", F.col("k")), ("{r}", F.col("k") % 5), ("{p}", F.col("k") - 1)):
            out = F.replace(out, F.lit(name), v.cast("string"))
        return F.replace(F.replace(out, F.lit("\x01"), F.lit("{")), F.lit("\x02"), F.lit("}"))

    made = [F.when(F.expr(cond), F.struct(text(p.replace("seed_{k}", "seed_{r}")).alias("path"), text(c).alias("content"))) for p, c, cond in FILES]
    spread = k.repartition(spark.sparkContext.defaultParallelism)
    return spread.select(F.explode(F.array_compact(F.array(*made))).alias("x")).select("x.path", "x.content")


_BUILT: dict[tuple[str, str], build.Project] = {}


def project(spark: SparkSession, sf_dir: str) -> build.Project:
    """The graph of the files, built once in a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _BUILT:
        _BUILT[key] = build.build(spark, storage.stored(files(spark, sf_dir), "files"))
    return _BUILT[key]


_K = "SELECT CAST(s_suppkey AS BIGINT) AS k FROM supplier"


def _union(*parts: tuple[str, str]) -> str:
    """Rows of (select list, condition on k)."""
    return " UNION ALL ".join(f"SELECT {x} FROM k WHERE {cond}" for x, cond in parts)


_NODES = _union(
    ("'model.stg_' || k AS unique_id, 'model' AS node_type, 'stg_' || k AS label, 'view' AS materialization, 'models/staging/stg_' || k || '.sql' AS file_path, 'id' AS columns, '' AS tags", "true"),
    ("'model.mart_' || k, 'model', 'mart_' || k, 'table', 'models/marts/mart_' || k || '.sql', 'id,total', 'mart'", "k > 1"),
    ("'model.odd_' || k, 'model', 'odd_' || k, NULL, 'models/marts/odd_' || k || '.sql', '*', ''", "k % 7 = 0"),
    ("'model.wide_' || k || '.v1', 'model', 'wide_' || k || '.v1', NULL, 'models/wide/wide_' || k || '_v1.sql', 'id', ''", "k % 5 = 0"),
    ("'model.wide_' || k || '.v2', 'model', 'wide_' || k || '.v2', NULL, 'models/wide/wide_' || k || '_new.sql', 'id,note', ''", "k % 5 = 0"),
    ("'model.user_' || k, 'model', 'user_' || k, NULL, 'models/wide/user_' || k || '.sql', 'id', ''", "k % 5 = 0"),
    ("'snapshot.snap_' || k, 'snapshot', 'snap_' || k, NULL, 'snapshots/snap_' || k || '.sql', '*', ''", "k % 4 = 0"),
    ("'test.check_' || k, 'test', 'check_' || k, NULL, 'tests/check_' || k || '.sql', '', ''", "k % 3 = 0"),
    ("'seed.seed_' || k % 5, 'seed', 'seed_' || k % 5, NULL, 'seeds/seed_' || k % 5 || '.csv', '', ''", "k < 5"),
    ("'source.raw.t_' || k, 'source', 'raw.t_' || k, NULL, 'models/schema_' || k || '.yml', 'id', ''", "true"),
    ("'exposure.board_' || k, 'exposure', 'board_' || k, NULL, 'models/schema_' || k || '.yml', '', ''", "true"),
    ("'test.not_null.raw.t_' || k || '.id', 'test', 'not_null.raw.t_' || k || '.id', NULL, 'models/schema_' || k || '.yml', '', ''", "true"),
    *((f"'test.{t}.stg_' || k || '.id{n}', 'test', '{t}.stg_' || k || '.id{n}', NULL, 'models/schema_' || k || '.yml', '', ''", "true") for t, n in (("unique", ""), ("unique", "_2"), ("relationships", ""))),
    ("'semantic_model.sem_' || k, 'semantic_model', 'sem_' || k, NULL, 'models/schema_' || k || '.yml', '', ''", "true"),
    *((f"'metric.{m}_' || k, 'metric', '{m}_' || k, NULL, 'models/schema_' || k || '.yml', '', ''", "true") for m in ("total", "share")),
    ("'saved_query.board_query_' || k, 'saved_query', 'board_query_' || k, NULL, 'models/schema_' || k || '.yml', '', ''", "true"),
    ("'phantom.missing_' || k, 'phantom', 'missing_' || k, NULL, NULL, '', ''", "k % 7 = 0"),
    ("'phantom.raw.gone_' || k, 'phantom', 'raw.gone_' || k, NULL, NULL, '', ''", "k % 7 = 0"),
)
_EDGES = _union(
    ("'source.raw.t_' || k AS src, 'model.stg_' || k AS dst, 'source' AS edge_type", "true"),
    ("'model.stg_' || k, 'model.mart_' || k, 'ref'", "k > 1"),
    ("'seed.seed_' || k % 5, 'model.mart_' || k, 'ref'", "k > 1"),
    ("'model.stg_' || (k - 1), 'model.mart_' || k, 'ref'", "k > 1"),
    ("'phantom.missing_' || k, 'model.odd_' || k, 'ref'", "k % 7 = 0"),
    ("'phantom.raw.gone_' || k, 'model.odd_' || k, 'source'", "k % 7 = 0"),
    ("'model.stg_' || k, 'model.wide_' || k || '.v1', 'ref'", "k % 5 = 0"),
    ("'model.wide_' || k || '.v1', 'model.wide_' || k || '.v2', 'ref'", "k % 5 = 0"),
    ("'model.wide_' || k || '.v2', 'model.user_' || k, 'ref'", "k % 5 = 0"),
    ("'model.stg_' || k, 'snapshot.snap_' || k, 'ref'", "k % 4 = 0"),
    ("'model.stg_' || k, 'test.check_' || k, 'test'", "k % 3 = 0"),
    ("'model.stg_' || k, 'exposure.board_' || k, 'exposure'", "true"),
    ("'source.raw.t_' || k, 'exposure.board_' || k, 'exposure'", "true"),
    ("'source.raw.t_' || k, 'test.not_null.raw.t_' || k || '.id', 'test'", "true"),
    *((f"'model.stg_' || k, 'test.{t}.stg_' || k || '.id{n}', 'test'", "true") for t, n in (("unique", ""), ("unique", "_2"), ("relationships", ""))),
    ("'seed.seed_' || k % 5, 'test.relationships.stg_' || k || '.id', 'test'", "true"),
    ("'model.stg_' || k, 'semantic_model.sem_' || k, 'ref'", "true"),
    ("'semantic_model.sem_' || k, 'metric.total_' || k, 'ref'", "true"),
    ("'metric.total_' || k, 'metric.share_' || k, 'ref'", "true"),
    ("'metric.share_' || k, 'saved_query.board_query_' || k, 'ref'", "true"),
)


def _edges(where: str = "true") -> str:
    return f"WITH k AS ({_K}), e AS ({_EDGES}) SELECT * FROM e WHERE {where}"


@query(f"WITH k AS ({_K}), n AS ({_NODES}) SELECT * FROM n")
def graph_build_sql(spark, sf_dir):
    return project(spark, sf_dir).nodes.select("unique_id", "node_type", "label", "materialization", "file_path", F.array_join("columns", ",").alias("columns"), F.array_join("tags", ",").alias("tags"))


@query(_edges())
def graph_build_sql_edges(spark, sf_dir):
    return project(spark, sf_dir).edges.select("src", "dst", "edge_type")


@query(_edges("edge_type = 'ref' AND src NOT LIKE 'phantom.%' AND (dst LIKE 'model.%' OR dst LIKE 'snapshot.%')"))
def ref_resolution(spark, sf_dir):
    return project(spark, sf_dir).edges.where("edge_type = 'ref' and src not like 'phantom.%' and (dst like 'model.%' or dst like 'snapshot.%')").select("src", "dst", "edge_type")


@query(f"WITH k AS ({_K}) " + _union(("'phantom.missing_' || k AS src, 'model.odd_' || k AS dst, 'dependency_target_missing' AS kind, 'ref.missing_' || k AS detail", "k % 7 = 0"), ("'phantom.raw.gone_' || k, 'model.odd_' || k, 'dependency_target_missing', 'source.raw.gone_' || k", "k % 7 = 0")))
def phantom_nodes(spark, sf_dir):
    p = project(spark, sf_dir)
    e = p.edges.where("src like 'phantom.%'").select("src", "dst")
    return e.join(p.reasons.where("kind = 'dependency_target_missing'"), (F.col("dst") == F.col("unique_id")) & F.col("detail").endswith(F.substring_index("src", "phantom.", -1))).select("src", "dst", "kind", "detail")


@query(_edges("edge_type = 'source' AND src LIKE 'source.%'"))
def source_link(spark, sf_dir):
    return project(spark, sf_dir).edges.where("edge_type = 'source' and src like 'source.%'").select("src", "dst", "edge_type")


@query(_edges("dst LIKE 'test.%' AND dst NOT LIKE 'test.check%'"))
def generic_tests(spark, sf_dir):
    return project(spark, sf_dir).edges.where("dst like 'test.%' and dst not like 'test.check%'").select("src", "dst", "edge_type")


@query(_edges("dst LIKE 'semantic_model.%' OR dst LIKE 'metric.%' OR dst LIKE 'saved_query.%'"))
def semantic_layer(spark, sf_dir):
    return project(spark, sf_dir).edges.where("dst like 'semantic_model.%' or dst like 'metric.%' or dst like 'saved_query.%'").select("src", "dst", "edge_type")


@query(f"WITH k AS ({_K}), n AS ({_NODES}) SELECT unique_id, CASE WHEN unique_id LIKE 'phantom.%' OR unique_id LIKE 'model.odd%' OR unique_id LIKE 'exposure.%' THEN 'partial' ELSE 'complete' END AS status, CASE WHEN unique_id LIKE 'phantom.%' THEN 'not_assessed' WHEN unique_id LIKE 'model.odd%' OR unique_id LIKE 'exposure.%' THEN 'dependency_target_missing' ELSE '' END AS reasons FROM n")
def dependency_status(spark, sf_dir):
    return build.status(project(spark, sf_dir)).select("unique_id", "status", F.array_join("reasons", ",").alias("reasons"))


@query(f"WITH k AS ({_K}) SELECT kind, CAST(count(*) AS BIGINT) AS n FROM (" + _union(*((f"'{kind}' AS kind", cond) for kind, cond in (("model", "true"), ("model", "k > 1"), ("model", "k % 7 = 0"), ("model", "k % 5 = 0"), ("model", "k % 5 = 0"), ("model", "k % 5 = 0"), ("snapshot", "k % 4 = 0"), ("test", "k % 3 = 0"), ("seed", "k < 5"), ("yaml", "true")))) + ") x GROUP BY kind")
def project_discovery(spark, sf_dir):
    f = files(spark, sf_dir)
    return scan.discovered(f, scan.settings(f)).groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT 'info' AS level, setting, path FROM (VALUES ('analysis-paths', 'analyses'), ('macro-paths', 'macros')) v(setting, path)")
def path_diagnostics(spark, sf_dir):
    f = files(spark, sf_dir)
    return scan.path_diagnostics(f, scan.settings(f))


@query(f"WITH k AS ({_K}) " + _union(*((f"'{e}' AS entry, {n} AS name", "true") for e, n in (("source", "'t_' || k"), ("test", "'not_null'"), ("model", "'stg_' || k"), ("test", "'unique'"), ("test", "'unique'"), ("test", "'relationships'"), ("model", "'wide_' || k"), ("version", "'wide_' || k"), ("version", "'wide_' || k"), ("exposure", "'board_' || k"), ("semantic_model", "'sem_' || k"), ("metric", "'total_' || k"), ("metric", "'share_' || k"), ("saved_query", "'board_query_' || k")))))
def yaml_schema_scan(spark, sf_dir):
    f = files(spark, sf_dir)
    return scan.yaml_rows(scan.discovered(f, scan.settings(f)), {}, {}).select("entry", "name")


@query(f"WITH k AS ({_K}) " + _union(("'wide_' || k AS name, '1' AS version, false AS latest, 'wide_' || k || '_v1' AS stem", "true"), ("'wide_' || k, '2', true, 'wide_' || k || '_new'", "true")))
def model_versions(spark, sf_dir):
    f = files(spark, sf_dir)
    return build.versions(scan.yaml_rows(scan.discovered(f, scan.settings(f)), {}, {})).select("name", "version", "latest", "stem")


@query(f"WITH k AS ({_K}) " + _union(("'seed_' || k % 5 AS name, 'id|full name|rate' AS columns", "k < 5")))
def seed_headers(spark, sf_dir):
    f = files(spark, sf_dir)
    found = scan.discovered(f, scan.settings(f))
    return scan.seed_headers(found, spark.createDataFrame([], "name string")).select("name", F.array_join("columns", "|").alias("columns"))


@query(f"WITH k AS ({_K}) SELECT name, CAST(min(position) AS BIGINT) AS position FROM (" + _union(("'stg_' || k AS name, k * 10 AS position", "true"), ("'mart_' || k, k * 10 + 1", "k > 1"), ("'stg_' || k, k * 10 + 2", "true"), ("'wide_' || k, k * 10 + 2", "true")) + ") x GROUP BY name")
def stdin_inputs(spark, sf_dir):
    k = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("k"))
    line = lambda n, *x: F.struct((F.col("k") * 10 + n).alias("position"), F.concat(*x).alias("line"))
    s = F.col("k").cast("string")
    lines = k.select(F.explode(F.array(line(0, F.lit("stg_"), s), line(1, F.lit("./models/marts/mart_"), s, F.lit(".sql")), line(2, F.lit("models/schema_"), s, F.lit(".yml")), line(3, F.lit("docs/page_"), s, F.lit(".md")), line(4, F.lit("")))).alias("x")).select("x.*")
    f = files(spark, sf_dir)
    declared = scan.yaml_rows(scan.discovered(f, scan.settings(f)), {}, {}).where("entry = 'model'").select("path", "name")
    return scan.inputs(lines, project(spark, sf_dir).nodes, declared)


def _extracted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        found = [template_cases.lines(t) for t in b["text"]]
        out = b[["suppkey", "inventory_row", "case_no"]].assign(line=found, line_no=[list(range(len(x))) for x in found])
        out = out.explode(["line", "line_no"]).dropna(subset=["line"])
        yield out.astype({"line_no": "int32"})[["suppkey", "inventory_row", "case_no", "line_no", "line"]]


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_CASES = ", ".join(f"({_lit(row)}, {i}, {j}, {_lit(line)})" for i, (row, _, said) in enumerate(template_cases.CASES) for j, line in enumerate(said))


@query(f"SELECT CAST(s_suppkey AS BIGINT) AS suppkey, inventory_row, case_no, line_no, replace(said, '{{k}}', CAST(s_suppkey AS VARCHAR)) AS line FROM supplier, (VALUES {_CASES}) v(inventory_row, case_no, line_no, said)")
def template_dependencies(spark, sf_dir):
    keys = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("suppkey"))
    made = F.array(*[F.struct(F.lit(row).alias("inventory_row"), F.lit(i).alias("case_no"), F.replace(F.lit(t), F.lit("{k}"), F.col("suppkey").cast("string")).alias("text")) for i, (row, t, _) in enumerate(template_cases.CASES)])
    spread = keys.repartition(spark.sparkContext.defaultParallelism)
    return spread.select("suppkey", F.explode(made).alias("x")).select("suppkey", "x.*").mapInPandas(_extracted, "suppkey long, inventory_row string, case_no int, line_no int, line string")
