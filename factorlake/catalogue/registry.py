"""Registration of queries and the helpers that write their SQL."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .views import VIEW_DEPENDS, VIEW_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

DIGITS = 6


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every double and drop the sign of zero, so that two engines can be compared by value."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = (F.round(c.cast("double"), digits) + F.lit(0.0)).alias(f.name)
        out.append(c)
    return df.select(*out)


def query(name: str, sql: str | None = None, digits: int = DIGITS):
    """Register ``fn(spark, sf_dir)``; doubles of its result are rounded."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: rounded(fn(spark, sf_dir), digits)
        QUERIES[name].__name__ = name
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


# ---- SQL text ---------------------------------------------------------------------------------


def views(*names: str) -> str:
    """``WITH`` clause defining the given views and what they depend on."""
    done: list[str] = []

    def visit(n: str) -> None:
        if n not in done:
            for d in VIEW_DEPENDS.get(n, ()):
                visit(d)
            done.append(n)

    for n in names:
        visit(n)
    return "WITH " + ",\n".join(f"{n} AS ({VIEW_SQL[n]})" for n in done)


def num(expr: str, name: str, digits: int = DIGITS) -> str:
    return f"round(({expr})::DOUBLE, {digits}) + 0.0 AS {name}"


def nums(exprs: Mapping[str, str] | list[str], digits: int = DIGITS) -> str:
    """Comma-separated rounded columns; a list rounds columns under their own names."""
    pairs = exprs.items() if isinstance(exprs, Mapping) else [(e, e) for e in exprs]
    return ", ".join(num(e, f'"{n}"', digits) for n, e in pairs)


def clip_sql(x: str, lo=None, hi=None) -> str:
    out = x
    if lo is not None:
        out = f"greatest({out}, {lo})"
    if hi is not None:
        out = f"least({out}, {hi})"
    return f"(CASE WHEN ({x}) IS NULL OR isnan(({x})::DOUBLE) THEN ({x}) ELSE {out} END)"


def over(n: int, by: str | None = "ts_code", order: str = "date") -> str:
    part = f"PARTITION BY {by} " if by else ""
    return f"({part}ORDER BY {order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def roll_sql(agg: str, x: str, n: int, m: int, by: str | None = "ts_code") -> str:
    w = over(n, by)
    return f"(CASE WHEN count({x}) OVER {w} >= {m} THEN {agg}({x}) OVER {w} END)"


def corr_sql(x: str, y: str, n: int, m: int, by: str | None = "ts_code") -> str:
    w = over(n, by)
    pairs = f"count(CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN 1 END)"
    return f"(CASE WHEN {pairs} OVER {w} >= {m} THEN corr({y}, {x}) OVER {w} END)"


def lag_sql(x: str, n: int = 1, by: str | None = "ts_code", order: str = "date") -> str:
    part = f"PARTITION BY {by} " if by else ""
    fn = f"lag({x}, {n})" if n >= 0 else f"lead({x}, {-n})"
    return f"{fn} OVER ({part}ORDER BY {order})"


def flag_sql(cond: str) -> str:
    return f"({cond})::TINYINT"


def any_sql(cols: list[str]) -> str:
    return "(" + " OR ".join(f"({c})::BOOLEAN" for c in cols) + ")::TINYINT"


def mean_sql(cols: list[str]) -> str:
    total = " + ".join(f"coalesce({c}, 0)" for c in cols)
    n = " + ".join(f"({c} IS NOT NULL)::INT" for c in cols)
    return f"(CASE WHEN ({n}) > 0 THEN ({total}) / ({n}) END)"


def safe_div_sql(n: str, d: str, min_den: float = 1e-6, negative: str = "null", fill: str | None = None) -> str:
    den = f"abs({d})" if negative == "abs" else f"({d})"
    out = f"({n}) / CASE WHEN {den} IS NULL THEN NULL ELSE greatest({den}, {min_den}) END"
    if negative == "null":
        out = f"CASE WHEN ({d}) <= 0 THEN NULL ELSE {out} END"
    return f"coalesce({out}, {fill})" if fill is not None else f"({out})"
