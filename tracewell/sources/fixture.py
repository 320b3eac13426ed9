"""A project graph over the benchmark tables: regions, parts, nations, suppliers, customers and orders become nodes.

The same SQL text builds it in Spark and in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import schema, storage

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
#: Orders above this price have a test.
TESTED = 400_000

NODES_SQL = f"""
SELECT 'source.tpch.region_' || CAST(r_regionkey AS STRING) AS unique_id, 'region.' || r_name AS label, 'source' AS node_type, CAST(NULL AS STRING) AS file_path, 'region ' || r_name AS description, CAST(NULL AS STRING) AS materialization, CAST(NULL AS STRING) AS tag FROM {{region}}
UNION ALL SELECT 'source.tpch.part_' || CAST(p_partkey AS STRING), 'part.' || CAST(p_partkey AS STRING), 'source', NULL, p_name, NULL, p_brand FROM {{part}}
UNION ALL SELECT 'seed.tpch.nation_' || CAST(n_nationkey AS STRING), n_name, 'seed', 'seeds/nation.csv', 'nation ' || n_name, 'seed', NULL FROM {{nation}}
UNION ALL SELECT 'model.tpch.supplier_' || CAST(s_suppkey AS STRING), 'supplier_' || CAST(s_suppkey AS STRING), 'model', 'models/staging/supplier_' || CAST(s_suppkey AS STRING) || '.sql', s_name, 'view', NULL FROM {{supplier}}
UNION ALL SELECT 'model.tpch.customer_' || CAST(c_custkey AS STRING), 'customer_' || CAST(c_custkey AS STRING), 'model', 'models/intermediate/customer_' || CAST(c_custkey AS STRING) || '.sql', c_name, 'view', c_mktsegment FROM {{customer}}
UNION ALL SELECT 'model.tpch.order_' || CAST(o_orderkey AS STRING), 'order_' || CAST(o_orderkey AS STRING), 'model', CASE WHEN o_orderpriority = '1-URGENT' THEN 'models/marts/order_' ELSE 'models/reporting/order_' END || CAST(o_orderkey AS STRING) || '.sql', 'order of customer ' || CAST(o_custkey AS STRING), CASE o_orderstatus WHEN 'F' THEN 'table' WHEN 'P' THEN 'incremental' ELSE 'view' END, o_orderpriority FROM {{orders}}
UNION ALL SELECT DISTINCT 'exposure.tpch.' || c_mktsegment || '_' || o_orderpriority, c_mktsegment || '_' || o_orderpriority, 'exposure', 'models/exposures.yml', CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING) FROM {{customer}} JOIN {{orders}} ON o_custkey = c_custkey
UNION ALL SELECT 'test.tpch.order_' || CAST(o_orderkey AS STRING), 'price_order_' || CAST(o_orderkey AS STRING), 'test', NULL, NULL, NULL, NULL FROM {{orders}} WHERE o_totalprice > {TESTED}
"""
EDGES_SQL = f"""
SELECT 'source.tpch.region_' || CAST(n_regionkey AS STRING) AS src, 'seed.tpch.nation_' || CAST(n_nationkey AS STRING) AS dst, 'source' AS edge_type FROM {{nation}}
UNION ALL SELECT 'seed.tpch.nation_' || CAST(c_nationkey AS STRING), 'model.tpch.customer_' || CAST(c_custkey AS STRING), 'ref' FROM {{customer}}
UNION ALL SELECT 'seed.tpch.nation_' || CAST(s_nationkey AS STRING), 'model.tpch.supplier_' || CAST(s_suppkey AS STRING), 'ref' FROM {{supplier}}
UNION ALL SELECT 'model.tpch.customer_' || CAST(o_custkey AS STRING), 'model.tpch.order_' || CAST(o_orderkey AS STRING), 'ref' FROM {{orders}}
UNION ALL SELECT 'model.tpch.supplier_' || CAST(l_suppkey AS STRING), 'model.tpch.order_' || CAST(l_orderkey AS STRING), 'ref' FROM (SELECT DISTINCT l_suppkey, l_orderkey FROM {{lineitem}}) s
UNION ALL SELECT 'source.tpch.part_' || CAST(l_partkey AS STRING), 'model.tpch.order_' || CAST(l_orderkey AS STRING), 'source' FROM (SELECT DISTINCT l_partkey, l_orderkey FROM {{lineitem}}) p
UNION ALL SELECT 'model.tpch.order_' || CAST(o_orderkey AS STRING), 'exposure.tpch.' || c_mktsegment || '_' || o_orderpriority, 'exposure' FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey
UNION ALL SELECT 'model.tpch.order_' || CAST(o_orderkey AS STRING), 'test.tpch.order_' || CAST(o_orderkey AS STRING), 'test' FROM {{orders}} WHERE o_totalprice > {TESTED}
"""
#: A graph with cycles: which type of event follows which, within a user's events.
EVENT_EDGES_SQL = """
SELECT DISTINCT src, dst, 'ref' AS edge_type FROM (
  SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM {events}) e
WHERE dst IS NOT NULL
"""
#: A deep graph: each order of a customer comes from the one before.
CHAIN_EDGES_SQL = """
SELECT src, dst, 'ref' AS edge_type FROM (
  SELECT 'model.tpch.order_' || CAST(lag(o_orderkey) OVER w AS STRING) AS src, 'model.tpch.order_' || CAST(o_orderkey AS STRING) AS dst
  FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) e
WHERE src IS NOT NULL
"""


def _sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in text})


def edges_of(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Edges from one of the texts above, with rank; stored, since loops read them again and again."""
    e = _sql(spark, sf_dir, text).withColumn("edge_rank", schema.edge_rank("edge_type")).withColumn("collapsed_through", F.lit(None).cast("int"))
    return storage.stored(e, "edges")


def edges_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The project's edges as they come, for one pass."""
    return _sql(spark, sf_dir, EDGES_SQL)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _sql(spark, sf_dir, NODES_SQL)
    empty = F.array().cast("array<string>")
    return n.select("unique_id", "label", "node_type", "file_path", "description", "materialization", F.when(F.col("tag").isNull(), empty).otherwise(F.array("tag")).alias("tags"), empty.alias("columns"), F.array(F.regexp_replace("unique_id", r"^([^.]+)\.[^.]+\.", "$1.")).alias("aliases"), F.when(F.col("node_type") == "exposure", F.struct(F.col("label"), F.lit("dashboard").alias("exposure_type"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("maturity"), F.lit(None).cast("struct<name:string,email:string>").alias("owner"))).cast(schema.EXPOSURE).alias("exposure"))


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return nodes(spark, sf_dir), edges_of(spark, sf_dir, EDGES_SQL)


def duckdb(text: str) -> str:
    return text.format(**{t: t for t in TABLES}).strip()
