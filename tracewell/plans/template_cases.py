"""Templates with what they must refer to; {k} stands for a number. A case is (inventory row, template, lines)."""

from __future__ import annotations

#: Macros and variables that the cases may use.
MACROS = """
{% macro from_layer(layer, name='base_1') %}select * from {{ ref(layer ~ '_' ~ name) }}{% endmacro %}
{% macro names() %}{% set out = [] %}{% for i in range(2) %}{% do out.append('gen_' ~ i) %}{% endfor %}{{ return(out) }}{% endmacro %}
{% macro boxed(title) %}-- {{ title }}
{{ caller('inner') }}{% endmacro %}
{% macro endless(n) %}{{ endless(n) }}{% endmacro %}
{% macro unused() %}{{ ref('never_asked') }}{% endmacro %}
{% macro spread() %}{% for a in varargs %}{{ ref(a) }}{% endfor %}{{ ref(kwargs['last']) }}{% endmacro %}
"""
VARIABLES = {"region": "north", "feeds": ["tide", "wind"], "limits": {"low": 1}}

CASES: list[tuple[str, str, list[str]]] = [
    ("J1", "select * from {{ ref('b_{k}') }} join {{ ref('a_{k}') }} using (id) join {{ ref('b_{k}') }} b2 using (id)", ["ref b_{k}", "ref a_{k}"]),
    ("J1", "select 1 {% if is_incremental() %}from {{ ref('delta_{k}') }}{% else %}from {{ ref('whole_{k}') }}{% endif %}", ["ref whole_{k}", "ref delta_{k}"]),
    ("J2", "select {{ ref('x_{k}') }} {% if %} {# {{ ref('hidden') }} #} {% raw %}{{ ref('raw') }}{% endraw %} {{ source('s', 't_{k}') }}", ["ref x_{k}", "source s.t_{k}", "reason jinja_render_failed"]),
    ("J3", "{{ ref('pack', 'm_{k}', v='03') }} {{ ref('n_{k}', version=2) }}", ["ref pack/m_{k} v3", "ref n_{k} v2"]),
    ("J3", "{{ ref() }} {{ ref('a', colour='red') }} {{ ref(target.name) }}", ["reason invalid_dependency_call ref", "reason unresolved_ref target"]),
    ("J4", "{{ source('raw', 'log_{k}') }} {{ source('raw') }} {{ source('raw', var('nothing')) }}", ["source raw.log_{k}", "reason invalid_dependency_call source", "reason unresolved_source var nothing"]),
    ("J5", "{{ ref('r_' ~ var('region') ~ '_{k}') }} {{ ref(var('none', 'd_{k}')) }} {{ ref(var('none', default='e_{k}')) }}", ["ref r_north_{k}", "ref d_{k}", "ref e_{k}"]),
    ("J6", "{{ ref(env_var('SCHEMA', 'def_{k}')) }} {{ ref(env_var('DBT_ENV_SECRET_X', 'no')) }} {{ ref(env_var('HOME')) }}", ["ref def_{k}", "reason unresolved_ref env_var"]),
    ("J7", "{{ config(materialized='view', tags='a') }}{{ config(materialized='table', tags=['b', 'a']) }}{% if target.name == 'x' %}{{ config(tags='c') }}{% endif %}select {{ config.get('z') }}", ["config table a,b"]),
    ("J7", "{% if target.name == 'x' %}{{ config(materialized='view') }}{% endif %}select 1", []),
    ("J8", "{% set ns = namespace(t='u_{k}') %}{% if true %}{% set ns.t = 'w_{k}' %}{% endif %}{{ ref(ns.t) }}{{ log('x') }}{{ adapter.dispatch('pick')() }}", ["ref w_{k}", "reason unsupported_dispatch pick"]),
    ("J8", "{{ ref('before_{k}') }}{% if var('region') == 'north' %}{{ exceptions.raise_compiler_error('stop') }}{% endif %}{{ ref('after') }}", ["ref before_{k}"]),
    ("J9", "{% if execute %}{{ ref('never') }}{% endif %}{{ ref('m_{k}' if flags.FULL else 'm_{k}') }}", ["ref m_{k}"]),
    ("J10", "{% set parts = {'a': ['p', 'q_{k}']} %}{{ ref(parts.a[1] | upper) }}{{ ref(('x', 'y_{k}')[1:][0]) }}{{ ref('t' ~ (3 * 2 - 1) // 2 ~ '_{k}') }}{% if 'p' in parts['a'] and not 2 > 3 %}{{ ref('yes_{k}') }}{% endif %}", ["ref Q_{k}", "ref y_{k}", "ref t2_{k}", "ref yes_{k}"]),
    ("J10", "{{ ref('z_{k}' if missing is defined else 'd_{k}') }}{{ ref(missing | default('f_{k}')) }}{{ ref(['o', '{k}'] | join('_')) }}", ["ref d_{k}", "ref f_{k}", "ref o_{k}"]),
    ("J11", "{% for n in ['a', 'b', 'c'] if n != 'b' %}{{ ref(n ~ '_{k}') }}{% else %}{{ ref('none') }}{% endfor %}{% with t = 'w_{k}' %}{{ ref(t) }}{% endwith %}{% set q %}{{ ref('s_{k}') }}{% endset %}{% do ref('do_{k}') %}{% filter upper %}{{ ref('f_{k}') }}{% endfilter %}", ["ref a_{k}", "ref c_{k}", "ref w_{k}", "ref s_{k}", "ref do_{k}", "ref f_{k}"]),
    ("J11", "{% for n in range(9) %}{% if n == 1 %}{% continue %}{% endif %}{% if n == 3 %}{% break %}{% endif %}{{ ref('l' ~ n ~ '_{k}') }}{% endfor %}", ["ref l0_{k}", "ref l2_{k}"]),
    ("J12", "{% for r in run_query('x') %}{{ ref(r) }}{{ ref('each_{k}') }}{% endfor %}{% for f in var('feeds') %}{{ source(f, 't_{k}') }}{% endfor %}", ["ref each_{k}", "source tide.t_{k}", "source wind.t_{k}", "reason unresolved_ref runtime_value_unknown"]),
    ("J13", "{{ from_layer('stg', name='s_{k}') }}{{ from_layer('core') }}{% for n in names() %}{{ ref(n) }}{% endfor %}{% call(w) boxed('t') %}{{ ref(w ~ '_{k}') }}{% endcall %}{{ spread('v_{k}', last='z_{k}') }}{{ nothing_here() }}", ["ref stg_s_{k}", "ref core_base_1", "ref gen_0", "ref gen_1", "ref inner_{k}", "ref v_{k}", "ref z_{k}", "reason unresolved_call nothing_here"]),
    ("J14", "{{ ref('a_{k}') }}{{ endless(1) }}{{ ref('never') }}", ["ref a_{k}", "reason analysis_limit_reached"]),
    ("J15", "{% set t = 'one_{k}' %}{% if target.name == 'p' %}{% set t = 'two_{k}' %}{% endif %}{{ ref(t) }}", ["reason unresolved_ref control_flow"]),
    ("J17", "{% set x = 1 %}with a as (select 1 as u) select id, {{ x }} as n, count(*) total, a.*, sum(v) from {{ ref('c_{k}') }}", ["ref c_{k}", "columns id,n,total,*,sum"]),
]


def lines(text: str) -> list[str]:
    """What a template refers to, in the cases' notation; columns only where there is a SELECT with FROM."""
    from tracewell.project import template

    f = template.extract(text, template.library([MACROS]), VARIABLES)
    out = ["ref " + (f"{p}/" if p else "") + n + (f" v{v}" if v else "") for p, n, v in f.refs]
    out += [f"source {s}.{t}" for s, t in f.sources]
    out += [f"config {f.materialized} {','.join(f.tags)}"] if f.materialized else []
    out += [f"reason {k} {d}".rstrip() for k, d in f.reasons]
    return out + ([f"columns {','.join(template.select_columns(text))}"] if "with a as" in text else [])
