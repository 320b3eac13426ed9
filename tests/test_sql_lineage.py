"""The SQL analysis: stated cases for every kind of construct, rules that hold for generated statements, refusals."""

from __future__ import annotations

import random

import pytest

from tracewell.plans import sql_cases, sql_queries
from tracewell.sql.dialects import DIALECTS, detect
from tracewell.sql.lexer import SqlError
from tracewell.sql.lineage import Schema, analyze


def filled(x: str) -> str:
    return x.replace("{k}", "12")


@pytest.mark.parametrize("number", range(len(sql_cases.CASES)), ids=[f"{c[0]}-{i}" for i, c in enumerate(sql_cases.CASES)])
def test_cases(number):
    _, dialect, catalog, sql, want = sql_cases.CASES[number]
    assert sql_cases.lines(filled(sql), dialect, filled(catalog)) == [filled(w) for w in want]


def test_every_row_has_a_case_and_a_query():
    rows = {r for g in sql_queries.GROUPS.values() for r in g}
    assert {c[0] for c in sql_cases.CASES} <= rows
    assert rows - {c[0] for c in sql_cases.CASES} == {"A23"}  # refused like A27, with it


def test_queries_analyse_every_text(spark):
    keys = spark.createDataFrame([(4,), (9,)], "suppkey long")
    got = sql_queries.analysed(keys, sql_cases.CASES[:3]).collect()
    want = [(k, i, j, w.replace("{k}", str(k))) for k in (4, 9) for i, c in enumerate(sql_cases.CASES[:3]) for j, w in enumerate(c[4])]
    assert sorted((r.suppkey, r.case_no, r.line_no, r.line) for r in got) == sorted(want)


def expression(rng: random.Random, depth: int) -> tuple[str, set[str]]:
    """A random expression over the columns c0 to c9 of r, and the columns in it."""
    if depth == 0 or rng.random() < 0.2:
        c = f"c{rng.randrange(10)}"
        return rng.choice([f"r.{c}", c, f"(r.{c})"]), {c}
    form = rng.choice(["{} + {}", "coalesce({}, {})", "CASE WHEN {} THEN {} END", "({} || {})", "{} BETWEEN {} AND 7", "f(x => {}, {})", "CAST({} AS text) = {}", "sum({}) OVER (ORDER BY {})", "{} IN ({}, 3)"])
    a, b = (expression(rng, depth - 1) for _ in range(2))
    return f"({form.format(a[0], b[0])})", a[1] | b[1]


@pytest.mark.parametrize("seed", range(40))
def test_random_expressions(seed):
    """An expression's sources are the columns that stand in it, through any nesting of queries, under any dialect."""
    rng = random.Random(seed)
    sql, cols = expression(rng, 4)
    text = f"SELECT {sql} AS v FROM r"
    for level in range(rng.randrange(4)):
        text = rng.choice([f"SELECT q{level}.v FROM ({text}) AS q{level}", f"WITH w{level} AS ({text}) SELECT v FROM w{level}", f"SELECT v FROM ({text}) AS q{level} WHERE v > 1 ORDER BY v"])
    for d in ("postgres", "duckdb", "spark", "trino"):
        out = analyze(text, DIALECTS[d])[-1].outputs
        assert [o.name for o in out] == ["v"] and not out[0].reasons
        assert out[0].sources == sorted(("r", c) for c in cols)


@pytest.mark.parametrize("seed", range(20))
def test_random_unions(seed):
    """Outputs of a union merge by position, and a star is its relation's columns."""
    rng = random.Random(seed)
    width = rng.randrange(1, 5)
    catalog = {f"r{i}": Schema([f"k{i}_{j}" for j in range(width)]) for i in range(4)}
    picked = [rng.randrange(4) for _ in range(rng.randrange(1, 5))]
    sides = ["SELECT " + rng.choice(["*", ", ".join(catalog[f"r{i}"].columns)]) + f" FROM r{i}" for i in picked]
    out = analyze(" UNION ALL ".join(sides), DIALECTS["postgres"], catalog)[0].outputs
    assert [(o.name, o.ordinal) for o in out] == [(f"k{picked[0]}_{j}", j) for j in range(width)]
    assert [o.sources for o in out] == [sorted({(f"r{i}", f"k{i}_{j}") for i in picked}) for j in range(width)]


@pytest.mark.parametrize("sql", ["SELECT (", "SELECT 'open", "SELECT a FROM t WHERE )", "MERGE INTO x", "INSERT INTO"])
def test_refusals(sql):
    with pytest.raises(SqlError):
        analyze(sql, DIALECTS["generic"])


def test_deep_nesting_is_given_up_with_a_reason():
    text = "SELECT 1 AS a"
    for i in range(230):
        text = f"SELECT a FROM ({text}) q{i}"
    try:
        out = analyze(text, DIALECTS["postgres"])[0].outputs[0]
    except SqlError:
        return
    assert out.reasons


def test_dialect_names():
    assert detect("sqlserver").name == "tsql" and detect("nothing").name == "generic"
