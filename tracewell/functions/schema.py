"""The data model: kinds of nodes and edges, their order, and the graph's schemas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the data model. Node kinds in their order, with the prefix a display name carries.
NODE_KINDS = {"model": "", "source": "src:", "seed": "seed:", "snapshot": "snap:", "test": "test:", "exposure": "exp:", "semantic_model": "sem:", "metric": "metric:", "saved_query": "sq:", "phantom": "?:"}
#: Edge kinds from the most general to the most specialised: along a path the highest rank names the whole.
EDGE_KINDS = ["ref", "source", "test", "exposure"]
SEVERITIES = ["low", "medium", "high", "critical"]
#: What a plain listing shows: everything but phantoms.
OUTPUT_KINDS = [k for k in NODE_KINDS if k != "phantom"]

EXPOSURE = "struct<label:string,exposure_type:string,url:string,maturity:string,owner:struct<name:string,email:string>>"
NODES = f"unique_id string, label string, node_type string, file_path string, description string, materialization string, tags array<string>, columns array<string>, aliases array<string>, exposure {EXPOSURE}"
EDGES = "src string, dst string, edge_type string, edge_rank int, collapsed_through int"


def edge_rank(edge_type: Column | str) -> Column:
    c = F.col(edge_type) if isinstance(edge_type, str) else edge_type
    out = F.lit(None).cast("int")
    for k, name in enumerate(EDGE_KINDS):
        out = F.when(c == name, F.lit(k)).otherwise(out)
    return out


def edge_type(rank: Column | str) -> Column:
    return F.element_at(F.array(*map(F.lit, EDGE_KINDS)), (F.col(rank) if isinstance(rank, str) else rank) + 1)


def severity_label(rank: Column | str) -> Column:
    return F.element_at(F.array(*map(F.lit, SEVERITIES)), (F.col(rank) if isinstance(rank, str) else rank) + 1)


def display_name(node_type: Column | str = "node_type", label: Column | str = "label") -> Column:
    prefix = F.create_map(*[F.lit(x) for pair in NODE_KINDS.items() for x in pair])
    return F.concat(F.coalesce(F.try_element_at(prefix, F.col(node_type) if isinstance(node_type, str) else node_type), F.lit("")), F.col(label) if isinstance(label, str) else label)
