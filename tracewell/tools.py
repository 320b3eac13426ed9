"""Tools for assistants: six questions about a project, answered as JSON in pages."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tracewell.operators import closure, impact, select
from tracewell.plans import render
from tracewell.plans.engine import LineageEngine

PAGE = 50


def _page(df, order: list[str], name: str, args: dict) -> dict:
    """A page of rows, and the cursor of the next one; a cursor of another question is refused."""
    limit = min(max(int(args.get("limit", PAGE)), 1), 100)
    query = json.dumps([name, {k: v for k, v in args.items() if k not in ("cursor", "limit")}], sort_keys=True)
    at = render.offset_of(args.get("cursor"), query)
    rows = [r.asDict(True) for r in select.page(df, order, limit, at).collect()]
    for r in rows:
        r.pop("position")
    return {"rows": rows, "cursor": render.cursor(query, at + limit) if len(rows) == limit else None}


def get_project_summary(e: LineageEngine, args: dict) -> dict:
    return {r.node_type: r.n for r in e.summary().collect()}


def list_nodes(e: LineageEngine, args: dict) -> dict:
    nodes = e.list(args.get("node_types"))
    nodes = select.substring(nodes, args["query"]) if args.get("query") else nodes
    return _page(nodes.select("unique_id", "label", "node_type", "file_path"), ["label", "unique_id"], "list_nodes", args)


def find_nodes(e: LineageEngine, args: dict) -> dict:
    names = e.spark.createDataFrame([(n,) for n in args["names"]], "name string")
    return {"rows": [r.asDict() for r in select.lookup(e.nodes, names).orderBy("name").collect()]}


def get_lineage(e: LineageEngine, args: dict) -> dict:
    keep = closure.window(e.edges, e.ids([args["node"]]), args.get("upstream"), args.get("downstream"))
    near = e.edges.join(keep.withColumnRenamed("node", "src"), "src", "left_semi").join(keep.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return _page(near.select("src", "dst", "edge_type"), ["src", "dst", "edge_type"], "get_lineage", args)


def get_impact(e: LineageEngine, args: dict) -> dict:
    rows = e.impact(args["node"]).withColumn("bad", -F.col("severity_rank"))
    return impact.counts(rows).first().asDict() | _page(rows.drop("severity_rank"), ["distance", "bad", "unique_id"], "get_impact", args)


def get_column_lineage(e: LineageEngine, args: dict) -> dict:
    rows = e.column_paths(args["model"], args.get("columns"), "down" if args.get("direction") == "downstream" else "up")
    return _page(rows, ["root", "path"], "get_column_lineage", args)


TOOLS = {f.__name__: f for f in (get_project_summary, list_nodes, find_nodes, get_lineage, get_impact, get_column_lineage)}


def call(e: LineageEngine, name: str, args: dict | None = None) -> dict:
    """One question; an unknown tool or argument that can't be used is an error in the answer, not an exception."""
    try:
        if name not in TOOLS:
            raise ValueError(f"unknown tool {name}")
        return TOOLS[name](e, args or {})
    except (ValueError, KeyError) as x:
        return {"error": str(x)}


def serve(e: LineageEngine, lines, write) -> None:
    """JSON-RPC, one message a line: initialize, tools/list and tools/call."""
    for line in lines:
        m = json.loads(line)
        if m.get("method") == "initialize":
            out = {"protocolVersion": "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "tracewell", "version": "0.2"}}
        elif m.get("method") == "tools/list":
            out = {"tools": [{"name": n, "description": f.__name__.replace("_", " "), "inputSchema": {"type": "object"}} for n, f in TOOLS.items()]}
        elif m.get("method") == "tools/call":
            got = call(e, m["params"]["name"], m["params"].get("arguments"))
            out = {"content": [{"type": "text", "text": json.dumps(got, default=str)}], "isError": "error" in got}
        else:
            continue
        write(json.dumps({"jsonrpc": "2.0", "id": m.get("id"), "result": out}) + "\n")
