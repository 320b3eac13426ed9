"""A project's files as DataFrames: what its SQL templates ask for, what its YAML files declare, its seeds' headers.

Files come as rows (path, content), from a folder through `files` or from anywhere else. Macros and variables are the
project's own settings, a few small files, and go to the driver; models and YAML files are parsed where they lie.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.project import template

#: A project's folders by setting, where it names none.
DEFAULTS = {"model-paths": ["models"], "analysis-paths": ["analyses"], "seed-paths": ["seeds"], "snapshot-paths": ["snapshots"], "test-paths": ["tests"], "macro-paths": ["macros"]}
KIND_OF = {"model-paths": "model", "analysis-paths": "model", "seed-paths": "seed", "snapshot-paths": "snapshot", "test-paths": "test", "macro-paths": "macro"}
_REFS = "array<struct<package:string,name:string,version:string>>"
_SOURCES = "array<struct<source:string,table:string>>"
_REASONS = "array<struct<kind:string,detail:string>>"
SQL_ROWS = f"path string, kind string, stem string, refs {_REFS}, sources {_SOURCES}, materialization string, tags array<string>, reasons {_REASONS}, columns array<string>"
YAML_ROWS = f"path string, entry string, name string, parent string, column string, description string, columns array<string>, materialization string, tags array<string>, test string, version string, latest string, stem string, refs {_REFS}, sources {_SOURCES}, inputs array<string>, exposure struct<label:string,exposure_type:string,url:string,maturity:string,owner:struct<name:string,email:string>>, reasons {_REASONS}, position int"


def files(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of every SQL, YAML and CSV file below the folder; paths are relative to it."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "content")
    path = F.regexp_replace(F.regexp_replace("path", r"^\w+:/*", "/"), "^" + _quoted("/" + root.split(":", 1)[-1].strip("/")) + "/+", "")
    return found.where(F.lower("path").rlike(r"\.(sql|sql\.j2|sql\.jinja2?|ya?ml|csv)$")).select(path.alias("path"), F.decode("content", "UTF-8").alias("content"))


def _quoted(x: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c not in "/_" else c for c in x)


def settings(files_: DataFrame) -> dict:
    """The project file's folders and variables; at most two small files reach the driver.

    Variables stand in the project file or in vars.yml, not in both: ValueError.
    """
    import yaml

    texts = {r.path: r.content for r in files_.where(F.col("path").isin("dbt_project.yml", "dbt_project.yaml", "vars.yml")).collect()}
    project = next((yaml.safe_load(t) or {} for p, t in texts.items() if p.startswith("dbt_project")), {})
    extra = yaml.safe_load(texts["vars.yml"]) or {} if "vars.yml" in texts else {}
    if project.get("vars") and extra.get("vars"):
        raise ValueError("variables are defined in both the project file and vars.yml")
    variables = extra.get("vars") or project.get("vars") or {}
    own = variables.get(project.get("name"))
    flat = {k: v for k, v in variables.items() if not isinstance(v, dict)} | (own if isinstance(own, dict) else {})
    return {"name": project.get("name"), "paths": {k: project.get(k) or v for k, v in DEFAULTS.items()}, "named": [k for k in DEFAULTS if project.get(k)], "vars": flat}


def path_diagnostics(files_: DataFrame, config: dict) -> DataFrame:
    """(level, setting, path) of folders without a file: a warning where the project names them, else an information."""
    spark = files_.sparkSession
    want = spark.createDataFrame([("warning" if k in config["named"] else "info", k, p) for k, ps in config["paths"].items() for p in ps], "level string, setting string, path string")
    tops = files_.select(F.element_at(F.split("path", "/"), 1).alias("path")).distinct()
    return want.join(tops, "path", "left_anti").select("level", "setting", "path")


def kind(config: dict) -> F.Column:
    """What a file is by its folder and name; null for what the project doesn't know."""
    out = F.when(F.lower("path").rlike(r"\.ya?ml$"), "yaml")
    for setting, paths in config["paths"].items():
        inside = F.lit(False)
        for p in paths:
            inside = inside | F.col("path").startswith(p.rstrip("/") + "/")
        ending = r"\.csv$" if setting == "seed-paths" else r"\.(sql|sql\.j2|sql\.jinja2?)$"
        # generic tests are macros
        generic = F.lit(False) if setting != "test-paths" else F.col("path").rlike("^(" + "|".join(_quoted(p.rstrip("/")) for p in paths) + ")/generic/")
        out = out.when(inside & F.lower("path").rlike(ending), F.when(generic, "macro").otherwise(KIND_OF[setting]))
    return out


def stem() -> F.Column:
    return F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(?i)\.(sql|csv|sql\.j2|sql\.jinja2?)$", "")


def discovered(files_: DataFrame, config: dict) -> DataFrame:
    """(path, kind, stem, content) of the files the project knows."""
    return files_.select("path", kind(config).alias("kind"), stem().alias("stem"), "content").where("kind is not null")


def macros_of(found: DataFrame) -> dict[str, template.Macro]:
    """The project's macros, the first file by path winning."""
    texts = [r.content for r in found.where("kind = 'macro'").orderBy("path").select("content").toLocalIterator()]
    return template.library(texts)


def _found(f: template.Found) -> dict:
    return {"refs": [{"package": p, "name": n, "version": v} for p, n, v in f.refs], "sources": [{"source": s, "table": t} for s, t in f.sources], "materialization": f.materialized, "tags": f.tags, "reasons": [{"kind": k, "detail": d} for k, d in f.reasons]}


def sql_rows(found: DataFrame, macros: dict, variables: dict) -> DataFrame:
    """SQL_ROWS of models, analyses, snapshots and tests. A file may hold several snapshots: each is a row under its name."""
    import re

    names = [c.split(" ")[0] for c in SQL_ROWS.split(", ")]
    block = re.compile(r"\{%-?\s*snapshot\s+(\w+)\s*-?%\}.*?\{%-?\s*endsnapshot\s*-?%\}", re.S)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, k, s, text in zip(b["path"], b["kind"], b["stem"], b["content"], strict=True):
                parts = [(m[1], m[0]) for m in block.finditer(text)] if k == "snapshot" else []
                for name, part in parts or [(s, text)]:
                    out.append({"path": path, "kind": k, "stem": name, "columns": template.select_columns(part)} | _found(template.extract(part, macros, variables)))
            yield pd.DataFrame(out, columns=names)

    return found.where(F.col("kind").isin("model", "snapshot", "test")).select("path", "kind", "stem", "content").mapInPandas(run, SQL_ROWS)


def _tests(x: dict) -> list:
    return [*(x.get("tests") or []), *(x.get("data_tests") or [])]


def _test(t: object, macros: dict, variables: dict) -> tuple[str, template.Found]:
    """A test's name and what its arguments refer to."""
    if not isinstance(t, dict):
        return str(t), template.Found()
    name = t.get("test_name") or t.get("name") if "test_name" in t else next(iter(t))
    body = t if "test_name" in t else t.get(name) or {}
    calls = []

    def walk(v: object) -> None:
        if isinstance(v, dict):
            for y in v.values():
                walk(y)
        elif isinstance(v, list):
            for y in v:
                walk(y)
        elif isinstance(v, str):
            s = v.strip()
            calls.append(v if "{{" in v or "{%" in v else "{{ " + s + " }}" if s.startswith(("ref(", "source(", "var(", "env_var(", "doc(")) else "")

    walk({k: v for k, v in body.items() if k not in ("name", "config", "description")} if isinstance(body, dict) else body)
    return str(name), template.extract("".join(calls), macros, variables)


def parse_yaml(path: str, text: str, macros: dict, variables: dict) -> list[dict]:
    """YAML_ROWS of one file."""
    import yaml

    out: list[dict] = []
    blank = dict.fromkeys(c.split(" ")[0] for c in YAML_ROWS.split(", ") if " " in c and "<" not in c.split(" ")[0])
    names = ["path", "entry", "name", "parent", "column", "description", "columns", "materialization", "tags", "test", "version", "latest", "stem", "refs", "sources", "inputs", "exposure", "reasons", "position"]
    blank = dict.fromkeys(names)

    def row(entry: str, **x) -> None:
        out.append(blank | {"columns": [], "tags": [], "refs": [], "sources": [], "inputs": [], "reasons": []} | {"path": path, "entry": entry, "position": len(out)} | x)

    try:
        data = yaml.safe_load(text) or {}
    except yaml.YAMLError as e:
        row("input_skipped", reasons=[{"kind": "yaml_parse", "detail": str(e).split("\n")[0]}])
        return out
    if not isinstance(data, dict):
        return out
    strings = lambda v: [str(t) for t in (v if isinstance(v, list) else [v]) if t is not None]

    def tests(of: str, id_: str, x: dict) -> None:
        for t in _tests(x):
            n, f = _test(t, macros, variables)
            got = _found(f)
            row("test", name=n, parent=id_, test=of, refs=got["refs"], sources=got["sources"], reasons=got["reasons"])
        for c in x.get("columns") or []:
            for t in _tests(c):
                n, f = _test(t, macros, variables)
                got = _found(f)
                row("test", name=n, parent=id_, column=str(c.get("name")), test=of, refs=got["refs"], sources=got["sources"], reasons=got["reasons"])

    for s in data.get("sources") or []:
        for t in s.get("tables") or []:
            id_ = f"{s.get('name')}.{t.get('name')}"
            row("source", name=str(t.get("name")), parent=str(s.get("name")), description=t.get("description") or s.get("description"), columns=[str(c.get("name")) for c in t.get("columns") or []], tags=strings((s.get("tags") or [])) + strings(t.get("tags") or []))
            tests("source", id_, t)
    for kind_ in ("models", "seeds", "snapshots"):
        for m in data.get(kind_) or []:
            config = m.get("config") or {}
            relation = m.get("relation")
            f = _found(template.extract("{{ " + str(relation) + " }}" if relation and "{{" not in str(relation) else str(relation or ""), macros, variables))
            row(kind_[:-1], name=str(m.get("name")), description=m.get("description"), columns=[str(c.get("name")) for c in m.get("columns") or []], materialization=config.get("materialized"), tags=strings(config.get("tags") or []) + strings(m.get("tags") or []), refs=f["refs"], sources=f["sources"], reasons=f["reasons"], stem="yes" if relation else None)
            vs = [v for v in m.get("versions") or [] if isinstance(v, dict) and "v" in v]
            if vs:
                numbers = [template.version_text(v["v"]) for v in vs]
                latest = template.version_text(m.get("latest_version")) or max(numbers, key=lambda v: (v.isdigit(), int(v) if v.isdigit() else 0, v))
                for v, n in zip(vs, numbers, strict=True):
                    row("version", name=str(m.get("name")), version=n, latest=latest, stem=str(v.get("defined_in") or f"{m.get('name')}_v{n}"))
            tests("model" if kind_ == "models" else kind_[:-1], str(m.get("name")), m)
    for x in data.get("exposures") or []:
        f = _found(template.extract("".join("{{ " + str(d) + " }}" for d in x.get("depends_on") or []), macros, variables))
        owner = {k: v for k, v in (x.get("owner") or {}).items() if isinstance(v, str) and v.strip()}
        row("exposure", name=str(x.get("name")), description=x.get("description"), tags=strings(x.get("tags") or []), refs=f["refs"], sources=f["sources"], reasons=f["reasons"], exposure={"label": x.get("label") or x.get("name"), "exposure_type": x.get("type"), "url": x.get("url"), "maturity": x.get("maturity"), "owner": {"name": owner.get("name"), "email": owner.get("email")}})
    for x in data.get("semantic_models") or []:
        f = _found(template.extract("{{ " + str(x.get("model") or "''") + " }}", macros, variables))
        row("semantic_model", name=str(x.get("name")), description=x.get("description"), refs=f["refs"], reasons=f["reasons"], inputs=[str(m.get("name")) for m in x.get("measures") or []])
    for x in data.get("metrics") or []:
        p = x.get("type_params") or {}
        name = lambda v: str(v.get("name") if isinstance(v, dict) else v)
        measures = [name(v) for v in (p.get("measure"), *(p.get("measures") or [])) if v]
        metrics = [name(v) for v in (p.get("numerator"), p.get("denominator"), *(p.get("metrics") or [])) if v]
        row("metric", name=str(x.get("name")), description=x.get("description"), inputs=[f"measure:{m}" for m in measures] + [f"metric:{m}" for m in metrics])
    for x in data.get("saved_queries") or []:
        row("saved_query", name=str(x.get("name")), description=x.get("description"), inputs=[f"metric:{m}" for m in (x.get("query_params") or {}).get("metrics") or []])
    return out


def yaml_rows(found: DataFrame, macros: dict, variables: dict) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [r for p, t in zip(b["path"], b["content"], strict=True) for r in parse_yaml(p, t, macros, variables)]
            out = pd.DataFrame(rows, columns=["path", "entry", "name", "parent", "column", "description", "columns", "materialization", "tags", "test", "version", "latest", "stem", "refs", "sources", "inputs", "exposure", "reasons", "position"])
            yield out.astype({"position": "int32"})

    return found.where("kind = 'yaml'").select("path", "content").mapInPandas(run, YAML_ROWS)


def seed_headers(found: DataFrame, declared: DataFrame, delimiter: str = ",") -> DataFrame:
    """(name, columns) of seeds without declared columns (declared: name), from their first line."""
    seeds = found.where("kind = 'seed'").select(F.col("stem").alias("name"), F.substring_index(F.regexp_replace("content", "\r", ""), "\n", 1).alias("head"))
    seeds = seeds.join(declared.select("name").distinct(), "name", "left_anti")
    cut = F.split("head", _quoted(delimiter) + r'(?=(?:[^"]*"[^"]*")*[^"]*$)')
    return seeds.select("name", F.transform(cut, lambda c: F.replace(F.regexp_replace(F.trim(c), '^"|"$', ""), F.lit('""'), F.lit('"'))).alias("columns"))


def inputs(lines: DataFrame, nodes: DataFrame, declared: DataFrame) -> DataFrame:
    """(position, name) for lines (position, line): a SQL path stands for its node, a YAML path for all it declares
    (declared: path, name), other paths for nothing, anything else for itself; repeats keep their first place."""
    x = lines.select("position", F.regexp_replace(F.trim("line"), r"^\./", "").alias("line")).where("line <> ''")
    sql, yml = F.lower("line").rlike(r"\.sql(\.j2|\.jinja2?)?$"), F.lower("line").rlike(r"\.ya?ml$")
    plain = x.where(~sql & ~yml & ~F.col("line").contains("/") & ~F.lower("line").rlike(r"\.(csv|md|py|txt|json)$")).select("position", F.col("line").alias("name"))
    by_sql = x.where(sql).join(nodes.select(F.col("file_path").alias("line"), F.col("label").alias("name")), "line").select("position", "name")
    by_yaml = x.where(yml).join(declared.select(F.col("path").alias("line"), "name"), "line").select("position", "name")
    return plain.unionByName(by_sql).unionByName(by_yaml).groupBy("name").agg(F.min("position").alias("position")).select("position", "name")
