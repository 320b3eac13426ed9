"""The command line: python -m tracewell.cli COMMAND ...; text goes to standard output."""

from __future__ import annotations

import argparse
import json
import sys


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tracewell")
    p.add_argument("--project", default=".", help="the project's folder")
    p.add_argument("--manifest", help="a compiled manifest instead of the project's files")
    p.add_argument("--dialect")
    commands = p.add_subparsers(dest="command", required=True)
    g = commands.add_parser("graph")
    g.add_argument("names", nargs="*")
    g.add_argument("-u", "--upstream", type=int)
    g.add_argument("-d", "--downstream", type=int)
    g.add_argument("-s", "--select")
    g.add_argument("--node-type", action="append")
    g.add_argument("--no-transitive", action="store_true")
    g.add_argument("--collapse", nargs="?", const="endpoints", choices=["endpoints", "focal"])
    g.add_argument("--group-by", choices=["type", "directory"])
    g.add_argument("--show-columns", action="store_true")
    g.add_argument("--direction", default="LR", choices=["LR", "TB", "RL", "BT"])
    g.add_argument("--json-fields")
    g.add_argument("--json-full", action="store_true")
    g.add_argument("-o", "--output", default="ascii", choices=["ascii", "dot", "mermaid", "svg", "html", "plain", "json"])
    ls = commands.add_parser("list")
    ls.add_argument("names", nargs="*")
    ls.add_argument("--node-type", action="append")
    ls.add_argument("--search", action="append")
    for name in ("impact", "summary"):
        c = commands.add_parser(name)
        if name == "impact":
            c.add_argument("name")
        c.add_argument("-o", "--output", default="text", choices=["text", "json"])
    ls.add_argument("-o", "--output", default="plain", choices=["plain", "json"])
    col = commands.add_parser("column")
    col.add_argument("way", choices=["upstream", "downstream"])
    col.add_argument("model")
    col.add_argument("--column", action="append")
    col.add_argument("-o", "--output", default="plain", choices=["plain", "mermaid", "dot", "json"])
    d = commands.add_parser("debug")
    d.add_argument("what", choices=["parse-sql", "trace-column"])
    d.add_argument("sql")
    d.add_argument("--column")
    d.add_argument("--schema", default="", help="t(a, b); u(c)")
    check = commands.add_parser("check-manifest")
    check.add_argument("path")
    return p


def schema(text: str) -> dict:
    """A catalog from t(a, b); u(c, ...)."""
    import re

    from tracewell.sql.lineage import Schema

    out = {}
    for part in filter(None, (x.strip() for x in text.split(";"))):
        m = re.fullmatch(r"([\w.\"]+)\s*\(([^()]*)\)", part)
        if not m:
            raise ValueError(f"not a schema: {part}")
        names = [c.strip() for c in m[2].split(",") if c.strip()]
        out[m[1]] = Schema([c for c in names if c != "..."], "..." not in names)
    return out


def debug(a: argparse.Namespace) -> str:
    from dataclasses import asdict

    from tracewell.sql.dialects import detect
    from tracewell.sql.lineage import analyze
    from tracewell.sql.parser import parse

    if a.what == "parse-sql":
        return json.dumps([asdict(s) for s in parse(a.sql, detect(a.dialect))], default=str) + "\n"
    out = []
    for s in analyze(a.sql, detect(a.dialect), schema(a.schema)):
        for o in s.outputs:
            if a.column is None or (o.name or "").lower() == a.column.lower():
                out.append({"name": o.name, "ordinal": o.ordinal, "sources": [f"{r}.{c}" for r, c in o.sources], "unresolved": [f"{k} {x}" for k, x in o.reasons], "transform": o.transform})
    return json.dumps(out) + "\n"


def run(argv: list[str], spark=None) -> str:
    """What a command prints; ValueError for what can't be done."""
    a = parser().parse_args(argv)
    if a.command == "debug":
        return debug(a)
    from pyspark.sql import SparkSession

    from tracewell.operators import impact
    from tracewell.plans import render
    from tracewell.plans.engine import LineageEngine
    from tracewell.sources import manifest

    spark = spark or SparkSession.builder.appName("tracewell").getOrCreate()
    if a.command == "check-manifest":
        rows = manifest.diagnostics(manifest.read_text(spark, a.path)).orderBy("level", "what", "why").collect()
        return "".join(f"{r.level}: {r.what}: {r.why} ({r.hint})\n" for r in rows) or "ok\n"
    e = LineageEngine.from_manifest(spark, a.manifest, a.dialect) if a.manifest else LineageEngine.from_project(spark, a.project, a.dialect)
    if a.command == "graph":
        nodes, edges = e.graph(a.names or None, a.upstream, a.downstream, a.select, a.node_type, not a.no_transitive, a.collapse)
        if a.output in ("mermaid", "dot"):
            return getattr(render, a.output)(nodes, edges, a.direction, a.group_by, a.show_columns)
        if a.output == "json":
            return render.to_json(nodes, edges, render.FIELDS if a.json_full else a.json_fields.split(",") if a.json_fields else None) + "\n"
        return {"ascii": render.ascii, "svg": render.svg, "html": render.html, "plain": render.plain}[a.output](nodes, edges)
    if a.command == "list":
        nodes = e.list(a.node_type, a.search)
        if a.names:
            nodes = nodes.join(e.ids(a.names).withColumnRenamed("node", "unique_id"), "unique_id", "left_semi")
        return render.listing_json(nodes) + "\n" if a.output == "json" else "".join(r.value + "\n" for r in render.listing(nodes).limit(render.MOST).collect())
    if a.command == "impact":
        rows = e.impact(a.name)
        counts = impact.counts(rows)
        return render.impact_json(rows, counts) + "\n" if a.output == "json" else render.impact_text(rows, counts)
    if a.command == "summary":
        rows = e.summary()
        return render.summary_json(rows) + "\n" if a.output == "json" else render.summary_text(rows)
    return render.column_graph(e.column_paths(a.model, a.column, "up" if a.way == "upstream" else "down"), a.output)


def main() -> int:
    try:
        sys.stdout.write(run(sys.argv[1:]))
    except ValueError as e:
        sys.stderr.write(f"error: {e}\n")
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
