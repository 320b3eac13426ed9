"""The analysis of SQL texts as queries: every case's text for every supplier, analysed in the tasks.

A text is a template with the supplier's key in its relation names, so that the number of texts grows with the tables.
The DuckDB equivalents state what the analysis must say.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.plans import sql_cases

#: Query -> the inventory rows it covers.
GROUPS = {
    "sql_statements": [f"A{i}" for i in range(1, 9)],
    "sql_relations": [f"A{i}" for i in range(9, 28)],
    "sql_projection": ["A28", "A29", "A30"],
    "sql_joins": [f"B{i}" for i in range(1, 14)],
    "sql_aggregates": [f"C{i}" for i in range(1, 8)],
    "sql_windows": [f"C{i}" for i in range(8, 12)],
    "setop_union": ["D1"],
    "setop_intersect": ["D2"],
    "setop_except": ["D3"],
    "setop_alignment": ["D4"],
    "setop_by_name": ["D5"],
    "setop_arity": ["D6"],
    "cte_visibility": ["D7"],
    "cte_recursive": ["D8"],
    "sql_subqueries": ["D9", "D10", "D11"],
    "sql_expressions": [f"E{i}" for i in range(1, 15)],
    "read_relations": ["F1"],
    "name_choice": ["F2"],
    "star_expand": ["F3"],
    "ordinal_assign": ["F4"],
    "catalog_presence": ["F5"],
    "catalog_disambiguate": ["F6"],
    "lineage_normalize": ["F7"],
    "eval_cycle_guard": ["F9"],
    "output_lookup": ["F10"],
    "duplicate_output_diag": ["F11"],
    "empty_projection_diag": ["F12"],
}


def _analysed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        found = [sql_cases.lines(s, d, c) for s, d, c in zip(b["sql"], b["dialect"], b["catalog"], strict=True)]
        out = b[["suppkey", "inventory_row", "case_no"]].assign(line=found, line_no=[list(range(len(x))) for x in found])
        out = out.explode(["line", "line_no"])
        yield out.astype({"line_no": "int32"})[["suppkey", "inventory_row", "case_no", "line_no", "line"]]


def analysed(keys: DataFrame, cases: list[sql_cases.Case]) -> DataFrame:
    """(suppkey, inventory_row, case_no, line_no, line) of each case's text for each key (one column, suppkey)."""
    text = lambda x: F.replace(F.lit(x), F.lit("{k}"), F.col("suppkey").cast("string"))
    made = F.array(*[F.struct(F.lit(row).alias("inventory_row"), F.lit(i).alias("case_no"), F.lit(d).alias("dialect"), text(c).alias("catalog"), text(s).alias("sql")) for i, (row, d, c, s, _) in enumerate(cases)])
    # keys lie in few small files, their texts are the work: they are dealt out first
    spread = keys.repartition(keys.sparkSession.sparkContext.defaultParallelism)
    return spread.select("suppkey", F.explode(made).alias("x")).select("suppkey", "x.*").mapInPandas(_analysed, "suppkey long, inventory_row string, case_no int, line_no int, line string")


def _register(name: str, rows: list[str]) -> tuple[Callable[[SparkSession, str], DataFrame], str]:
    cases = [c for c in sql_cases.CASES if c[0] in rows]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return analysed(spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("suppkey")), cases)

    lit = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({lit(c[0])}, {i}, {j}, {lit(line)})" for i, c in enumerate(cases) for j, line in enumerate(c[4]))
    run.__name__ = name
    return run, f"SELECT CAST(s_suppkey AS BIGINT) AS suppkey, inventory_row, case_no, line_no, replace(said, '{{k}}', CAST(s_suppkey AS VARCHAR)) AS line FROM supplier, (VALUES {values}) v(inventory_row, case_no, line_no, said)"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _name, _rows in GROUPS.items():
    QUERIES[_name], ORACLES[_name] = _register(_name, _rows)
