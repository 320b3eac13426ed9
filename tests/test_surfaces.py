"""The command line, the tools, the drawings and the project scan on a small project."""

from __future__ import annotations

import io
import json

import pytest

from tracewell import cli, tools
from tracewell.plans import render, template_cases
from tracewell.plans.engine import LineageEngine
from tracewell.project import build, scan, template

FILES = {
    "dbt_project.yml": "name: port\nmodel-paths: [models]\nvars:\n  area: north\n",
    "models/stg.sql": "{{ config(materialized='view') }} select id, load from {{ source('raw', 'calls') }}",
    "models/mart/north.sql": "{{ wrap('stg') }} where area = '{{ var('area') }}'",
    "models/a/twin.sql": "select 1 as x",
    "models/b/twin.sql": "select * from {{ ref('twin') }} join {{ ref('gone') }} using (x)",
    "macros/wrap.sql": "{% macro wrap(m) %}select * from {{ ref(m) }}{% endmacro %}",
    "models/raw.yml": "sources:\n- name: raw\n  tables:\n  - name: calls\n    columns: [{name: id}]\nexposures:\n- name: wall\n  type: dashboard\n  depends_on:\n  - ref('north')\n",
    "models/bad.yml": "a: [",
    "seeds/zone.csv": 'id,"a ""b"" c",d\n1,2,3\n',
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("project")
    for path, text in FILES.items():
        (top / path).parent.mkdir(parents=True, exist_ok=True)
        (top / path).write_text(text)
    return str(top)


def test_project_files_become_a_graph(spark, root):
    p = build.build(spark, scan.files(spark, root))
    nodes = {r.unique_id: r for r in p.nodes.collect()}
    assert set(nodes) == {"model.stg", "model.north", "model.twin", "source.raw.calls", "exposure.wall", "seed.zone", "phantom.gone"}
    assert nodes["model.stg"].materialization == "view" and nodes["model.stg"].columns == ["id", "load"]
    assert {(r.src, r.dst, r.edge_type) for r in p.edges.collect()} == {("source.raw.calls", "model.stg", "source"), ("model.stg", "model.north", "ref"), ("model.twin", "model.twin", "ref"), ("phantom.gone", "model.twin", "ref"), ("model.north", "exposure.wall", "exposure")}
    why = {(r.unique_id, r.kind) for r in p.reasons.collect()}
    assert ("model.twin", "ambiguous_ref") in why and ("model.twin", "dependency_target_missing") in why and not any(u == "model.north" for u, _ in why)
    assert [r.path for r in p.gaps.collect()] == ["models/bad.yml"]
    found = scan.discovered(scan.files(spark, root), scan.settings(scan.files(spark, root)))
    assert [tuple(r.columns) for r in scan.seed_headers(found, spark.createDataFrame([], "name string")).collect()] == [("id", 'a "b" c', "d")]


@pytest.mark.parametrize("number", range(len(template_cases.CASES)), ids=[f"{c[0]}-{i}" for i, c in enumerate(template_cases.CASES)])
def test_templates(number):
    _, text, want = template_cases.CASES[number]
    assert template_cases.lines(text.replace("{k}", "31")) == [w.replace("{k}", "31") for w in want]


@pytest.mark.parametrize("text", ["{{ ref(", "{% for %}", "{{ 'a", "{% endif %}", "{% if x %}", "{# {{ ref('a') }}", "{{ a..b }}", "{% set %}"])
def test_broken_templates_never_raise(text):
    assert template.extract(text + " {{ ref('still') }}").reasons[0][0] == "jinja_render_failed"


MANIFEST = {
    "metadata": {"adapter_type": "duckdb"},
    "sources": {"source.p.raw.s": {"name": "s", "source_name": "raw", "database": "db", "schema": "raw", "columns": {"id": {"name": "id"}, "v": {"name": "v"}}}},
    "nodes": {f"model.p.m{i}": {"name": f"m{i}", "resource_type": "model", "original_file_path": f"models/{'ab'[i % 2]}/m{i}.sql", "compiled_code": f"select id, v + {i} as v from db.{'raw.s' if i == 0 else f'main.m{i - 1}'}", "depends_on": {"nodes": ["source.p.raw.s" if i == 0 else f"model.p.m{i - 1}"]}, "database": "db", "schema": "main"} for i in range(4)},
    "exposures": {"exposure.p.e": {"name": "e", "type": "dashboard", "depends_on": {"nodes": ["model.p.m3"]}}},
}


@pytest.fixture(scope="module")
def manifest(tmp_path_factory):
    path = tmp_path_factory.mktemp("manifest") / "m.json"
    path.write_text(json.dumps(MANIFEST))
    return str(path)


def test_commands(spark, manifest):
    run = lambda *a: cli.run(["--manifest", manifest, *a], spark)
    assert run("graph", "m1", "-u", "1", "-d", "1", "-o", "plain") == "m0 -> m1 [ref]\nm1 -> m2 [ref]\n"
    assert 'subgraph g1["models/a"]' in run("graph", "-o", "mermaid", "--group-by", "directory")
    assert "layer 5\n  [exp:e]" in run("graph") and run("graph", "-o", "svg").count("<rect") == 6
    assert "via 4" in run("graph", "--node-type", "source", "--node-type", "exposure", "-o", "dot")
    assert json.loads(run("impact", "m2", "-o", "json"))["affected_exposures"] == 1 and "overall severity: critical" in run("impact", "m2")
    assert json.loads(run("summary", "-o", "json"))["model"] == 4 and run("list", "--node-type", "exposure") == "exposure\te\n"
    assert run("column", "upstream", "m2", "--column", "V") == "model.p.m2#v <- model.p.m1#v <- model.p.m0#v <- source.p.raw.s#v [expression]\n"
    assert len(json.loads(run("column", "downstream", "m2", "--column", "id", "-o", "json"))) == 1
    assert run("check-manifest", manifest) == "ok\n"
    with pytest.raises(ValueError):
        run("column", "upstream", "m")


def test_debug():
    got = json.loads(cli.run(["--dialect", "duckdb", "debug", "trace-column", "SELECT x.*, y FROM x, z", "--schema", "x(a); z(y, ...)"]))
    assert [(r["name"], r["sources"]) for r in got] == [("a", ["x.a"]), ("y", ["z.y"])]
    assert json.loads(cli.run(["debug", "parse-sql", "select 1"]))[0]["kind"] == "query"
    with pytest.raises(ValueError):
        cli.schema("t(a")


def test_tools_page_and_refuse(spark, manifest):
    e = LineageEngine.from_manifest(spark, manifest)
    one = tools.call(e, "list_nodes", {"limit": 4})
    two = tools.call(e, "list_nodes", {"limit": 4, "cursor": one["cursor"]})
    assert len(one["rows"]) == 4 and len(two["rows"]) == 2 and two["cursor"] is None
    assert "error" in tools.call(e, "list_nodes", {"query": "m", "cursor": one["cursor"]}) and "error" in tools.call(e, "nothing")
    assert tools.call(e, "find_nodes", {"names": ["m1"]})["rows"][0]["unique_id"] == "model.p.m1"
    assert len(tools.call(e, "get_lineage", {"node": "m1", "upstream": 1, "downstream": 1})["rows"]) == 2
    assert tools.call(e, "get_impact", {"node": "m0"})["affected_models"] == 3
    assert len(tools.call(e, "get_column_lineage", {"model": "m0"})["rows"]) == 2
    out = io.StringIO()
    tools.serve(e, ['{"id": 1, "method": "tools/list"}', '{"method": "notifications/initialized"}', '{"id": 2, "method": "tools/call", "params": {"name": "get_project_summary"}}'], out.write)
    said = [json.loads(x) for x in out.getvalue().splitlines()]
    assert len(said[0]["result"]["tools"]) == 6 and json.loads(said[1]["result"]["content"][0]["text"])["total"] == 6


def test_drawings_hold_no_open_tags(spark, manifest):
    e = LineageEngine.from_manifest(spark, manifest)
    nodes = e.nodes.withColumn("label", __import__("pyspark.sql.functions", fromlist=["f"]).lit("</script>&\""))
    page = render.html(nodes, e.edges)
    assert page.count("</script>") == 1 and "&lt;/script&gt;&amp;&quot;" in page


def test_barycenter_uncrosses():
    assert render.barycenter([["a", "b"], ["x", "y"]], [("a", "y"), ("b", "x")])[0:2] in ([["a", "b"], ["y", "x"]], [["b", "a"], ["x", "y"]])
