"""What differs between dialects."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Dialect:
    name: str
    quotes: str = '"'  # opening characters of quoted names
    fold: str = "lower"  # how an unquoted name is keyed: lower, upper or keep; names are matched after folding
    quoted_fold: bool = False  # quoted names are matched in any case too
    hash_comment: bool = False
    double_quoted_string: bool = False
    lateral_derived: bool = False
    by_name: frozenset[str] = frozenset()
    row_value_alias: bool = False
    static: dict[str, int] = field(default_factory=dict, hash=False)  # function -> position of a date part

    def key(self, name: str, quoted: bool = False) -> str:
        if quoted and not self.quoted_fold:
            return name
        return {"lower": name.lower(), "upper": name.upper(), "keep": name}[self.fold]


_ALL = frozenset({"union", "intersect", "except"})
#: Date parts and normalisation modes that are written like columns, by function and position from 0.
_BIGQUERY = {"date_trunc": 1, "datetime_trunc": 1, "timestamp_trunc": 1, "time_trunc": 1, "date_diff": 2, "datetime_diff": 2, "timestamp_diff": 2, "time_diff": 2, "last_day": 1, "normalize": 1, "normalize_and_casefold": 1}
_SNOWFLAKE = {"dateadd": 0, "datediff": 0, "timestampadd": 0, "timestampdiff": 0, "date_trunc": 0, "date_part": 0}
_TSQL = {"dateadd": 0, "datediff": 0, "datediff_big": 0, "datename": 0, "datepart": 0, "datetrunc": 0}
DIALECTS = {
    d.name: d
    for d in (
        Dialect("generic", '"`', quoted_fold=True),
        Dialect("ansi", fold="upper"),
        Dialect("postgres", row_value_alias=True, static={"normalize": 1}),
        Dialect("redshift", static={"dateadd": 0, "datediff": 0}),
        Dialect("duckdb", quoted_fold=True, lateral_derived=True, by_name=frozenset({"union"}), row_value_alias=True),
        Dialect("snowflake", fold="upper", by_name=frozenset({"union"}), static=_SNOWFLAKE),
        Dialect("bigquery", "`", quoted_fold=True, hash_comment=True, double_quoted_string=True, by_name=_ALL, row_value_alias=True, static=_BIGQUERY),
        Dialect("databricks", "`", quoted_fold=True, double_quoted_string=True, static={"dateadd": 0, "datediff": 0}),
        Dialect("spark", "`", quoted_fold=True, double_quoted_string=True),
        Dialect("hive", "`", quoted_fold=True, double_quoted_string=True),
        Dialect("mysql", "`", quoted_fold=True, hash_comment=True, double_quoted_string=True, static={"timestampadd": 0, "timestampdiff": 0}),
        Dialect("sqlite", '"`[', quoted_fold=True),
        Dialect("tsql", '"[', quoted_fold=True, static=_TSQL),
        Dialect("trino", quoted_fold=True, static={"normalize": 1}),
        Dialect("clickhouse", '"`', fold="keep", quoted_fold=True),
    )
}
#: Adapter names that aren't dialect names themselves.
ADAPTERS = {"postgresql": "postgres", "sqlserver": "tsql", "fabric": "tsql", "synapse": "tsql", "athena": "trino", "presto": "trino", "starburst": "trino", "mssql": "tsql", "mariadb": "mysql", "materialize": "postgres", "spark": "spark"}


def detect(name: str | None) -> Dialect:
    """The dialect of a name or adapter; generic for an unknown or missing one."""
    n = (name or "").lower()
    return DIALECTS.get(n) or DIALECTS.get(ADAPTERS.get(n, ""), DIALECTS["generic"])


def column(name):
    """`detect` as a column expression over a column of names."""
    from pyspark.sql import functions as F

    low = F.lower(F.coalesce(name, F.lit("")))
    known = F.create_map(*[F.lit(x) for n in dict.fromkeys([*DIALECTS, *ADAPTERS]) for x in (n, detect(n).name)])
    return F.coalesce(F.try_element_at(known, low), F.lit("generic"))
