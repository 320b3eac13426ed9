"""Graph operators on small graphs against plain Python, and the registered queries against DuckDB."""

from __future__ import annotations

import json

import compare
import numpy as np
import pytest

import __spark_entry__ as entry
from tracewell.functions import schema
from tracewell.operators import closure, columns, impact, select, subgraph
from tracewell.plans import render
from tracewell.plans.engine import LineageEngine

SF = "/root/testdata/sf0.001"


def edges_df(spark, pairs):
    return spark.createDataFrame([(a, b, "ref", 0, None) for a, b in pairs], schema.EDGES)


def random_pairs(seed, n=14, m=30, acyclic=True):
    rng = np.random.default_rng(seed)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, n, (m, 2))]
    return [(f"n{min(a, b):02}", f"n{max(a, b):02}") if acyclic else (f"n{a:02}", f"n{b:02}") for a, b in pairs if a != b or not acyclic]


@pytest.mark.parametrize("small", [0, 1000])
def test_reach_and_layers(spark, small):
    pairs = random_pairs(3, acyclic=False)
    got = {r.node: r.distance for r in closure.reach(edges_df(spark, pairs), spark.createDataFrame([("n01",), ("n01",)], "node string"), "down", 3, small=small).collect()}
    want, front = {"n01": 0}, {"n01"}
    for d in (1, 2, 3):
        front = {b for a, b in pairs if a in front} - set(want)
        want |= dict.fromkeys(front, d)
    assert got == want
    dag = random_pairs(5)
    nodes = sorted({x for p in dag for x in p}) + ["alone"]
    level = dict.fromkeys(nodes, 0)
    for _ in nodes:
        for a, b in dag:
            level[b] = max(level[b], level[a] + 1)
    df = spark.createDataFrame([(n,) for n in nodes], "node string")
    assert {r.node: r.layer for r in closure.layers(edges_df(spark, dag), df, small).collect()} == level
    loop = closure.layers(edges_df(spark, [("n00", "n01"), ("n01", "n00"), ("n01", "n02"), ("n03", "n02")]), df.limit(0).union(spark.createDataFrame([(f"n0{i}",) for i in range(4)], "node string")), small)
    assert {r.node: r.layer for r in loop.collect()} == {"n00": None, "n01": None, "n02": None, "n03": 0}


def test_cycles(spark):
    assert closure.find_cycle(edges_df(spark, random_pairs(8))) == []
    assert closure.find_cycle(edges_df(spark, [("a", "b"), ("b", "c"), ("c", "b"), ("a", "z")])) == ["b", "c", "b"]
    assert closure.find_cycle(edges_df(spark, [("a", "a")])) == ["a", "a"] and closure.find_cycle(edges_df(spark, [])) == []


def test_transitive_prefers_short_then_special(spark):
    e = spark.createDataFrame([("a", "x", "ref", 0, None), ("x", "b", "exposure", 3, None), ("a", "y", "source", 1, None), ("y", "z", "ref", 0, None), ("z", "b", "ref", 0, None), ("a", "c", "test", 2, None), ("x", "c", "ref", 0, None), ("a", "c", "ref", 0, None)], schema.EDGES)
    n = spark.createDataFrame([(x,) for x in "abcxyz"], "unique_id string")
    got = subgraph.transitive(n, e, spark.createDataFrame([("a",), ("b",), ("c",)], "node string"))[1].collect()
    assert sorted((r.src, r.dst, r.edge_type, r.collapsed_through or 0) for r in got) == [("a", "b", "exposure", 1), ("a", "c", "ref", 0), ("a", "c", "test", 0)]


def test_engine_and_renderers(spark, tmp_path):
    m = {"metadata": {"adapter_type": "duckdb"}, "nodes": {"model.p.a": {"name": "a", "resource_type": "model", "config": {"materialized": "table", "tags": ["t"]}, "compiled_code": "select id as k from db.raw.s", "depends_on": {"nodes": ["source.p.raw.s", "model.p.gone"]}, "database": "db", "schema": "main"}, "test.p.ok": {"name": "ok", "resource_type": "test", "depends_on": {"nodes": ["model.p.a"]}}}, "sources": {"source.p.raw.s": {"name": "s", "source_name": "raw", "database": "db", "schema": "raw", "columns": {"id": {"name": "id"}}}}, "exposures": {"exposure.p.e": {"name": "e", "type": "dashboard", "depends_on": {"nodes": ["model.p.a"]}}}, "macros": {"ignored": 1}}
    (tmp_path / "m.json").write_text(json.dumps(m))
    e = LineageEngine.from_manifest(spark, str(tmp_path / "m.json"))
    assert sorted((r.src, r.dst, r.edge_type) for r in e.edges.collect()) == [("model.p.a", "exposure.p.e", "exposure"), ("model.p.a", "test.p.ok", "test"), ("source.p.raw.s", "model.p.a", "source")]
    assert {r.unique_id: r.severity for r in e.impact("raw.s").collect()} == {"model.p.a": "high", "exposure.p.e": "critical", "test.p.ok": "low"}
    assert [tuple(r) for r in e.column_upstream("model.p.a", "K").collect()] == [("model.p.a#k", "source.p.raw.s#id", 1, "external_relation")]
    n, x = e.graph(["a"], 1, 1, kinds=["source", "exposure"])
    assert "src:raw.s -> exp:e [exposure (via 1)]" in render.plain(n, x) and 'n1["src:raw.s"]' in render.mermaid(n, x) and "rankdir=LR" in render.dot(n, x)
    assert json.loads(render.to_json(n, x, ["label"]))["nodes"] == [{"label": "e"}, {"label": "raw.s"}]
    with pytest.raises(ValueError):
        render.to_json(n, x, ["nope"])
    with pytest.raises(ValueError):
        e.ids(["nothing"])


def test_levels_give_the_same_slots(spark):
    from tracewell.plans.column_queries import project

    rows = lambda df: sorted(map(str, df.drop("slot").collect()))
    assert rows(columns.slots(project(spark, "/root/testdata/sf0.001"), "duckdb", 0)) == rows(columns.slots(project(spark, "/root/testdata/sf0.001"), "duckdb"))


def test_selectors(spark):
    n = spark.createDataFrame([("model.p.a", "a", "models/x/a.sql", ["t1"], ["model.a"]), ("model.p.b", "b", "models/b.sql", [], ["model.b"]), ("source.p.s.c", "s.c", None, [], [])], "unique_id string, label string, file_path string, tags array<string>, aliases array<string>")
    get = lambda s: sorted(r.node for r in select.selected(n, s).collect())
    assert get("tag:t*") == ["model.p.a"] and get("path:models/*.sql") == ["model.p.b"] and get("path:models/**") == ["model.p.a", "model.p.b"]
    assert get("model.a, s.c") == ["model.p.a", "source.p.s.c"] and get("") == [] and get("path:[") == []


@pytest.mark.parametrize("name", ["impact_nodes", "impact_counts", "node_lookup", "selector_union", "search", "summary_counts", "cycle_detect", "page_limit", "col_upstream", "col_select", "trace_boundaries"])
def test_against_duckdb(spark, name):
    assert compare.difference(spark, SF, entry.queries()[name], entry.oracle_sql()[name]) == ""


def test_severity_needs_no_path(spark):
    n = spark.createDataFrame([("model", None, None), ("model", "view", "models/marts/a.sql"), ("seed", None, None)], "node_type string, materialization string, file_path string")
    assert [r[0] for r in n.select(impact.severity()).collect()] == [1, 2, 1]
