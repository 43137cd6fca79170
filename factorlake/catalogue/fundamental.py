"""Quarterly statements: specs, joins and fundamental factor groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fundamental
from ..operators.joins import statement_join
from ..operators.skew import over_series
from ..sources.ingest import parse_report
from ..sources.specs import BALANCE, CASHFLOW, INCOME
from . import views as V
from .registry import lag_sql, nums, query, safe_div_sql, views

ST = views("statements")
KEYS = "ts_code, name, notice_date"

# ---- statement specs: raw report pages built from the statements, parsed back -------------------


def raw_pages(spark, sf, spec, columns):
    """Report pages as landed: one JSON document per code and year, and as many without a result."""
    have = [(s, t) for s, t in spec.columns.items() if t in columns]

    def text(target):
        if target == "notice_date":
            return F.date_format("notice_date", "yyyy-MM-dd 00:00:00")
        if target in ("ts_code", "name"):
            return F.col(target)
        return F.round(target, 4).cast("decimal(30,4)").cast("string")

    record = F.struct(*[text(t).alias(s) for s, t in have])
    # At most four reports per page.
    pages = V.statements(spark, sf).groupBy("ts_code", F.year("notice_date").alias("y")).agg(F.collect_list(record).alias("data"))
    full = F.to_json(F.struct(F.struct(F.lit(1).alias("pages"), F.col("data")).alias("result")))
    empty = F.to_json(F.struct(F.lit("no data").alias("message")))
    return pages.select(F.explode(F.array(full, empty)).alias("body"))


def _spec(name, spec, columns, text_cols=("ts_code", "name", "notice_date")):
    measures = [c for c in spec.columns.values() if c in columns]
    absent = [c for c in spec.numeric if c not in columns]
    sql = nums({c: f"round({c}, 4)" for c in measures}, 4)
    nulls = "".join(f", NULL::DOUBLE AS {c}" for c in absent)

    @query(name, f"{ST} SELECT {', '.join(text_cols)}, {sql}{nulls} FROM statements", digits=4)
    def run(spark, sf):
        return parse_report(raw_pages(spark, sf, spec, [*text_cols, *columns]), spec)


_spec("income_spec", INCOME, V.INCOME_COLUMNS)
_spec("balance_spec", BALANCE, V.BALANCE_COLUMNS)
_spec("cashflow_spec", CASHFLOW, V.CASHFLOW_COLUMNS)


@query(
    "ingest_report",
    f"{ST} SELECT {KEYS}, {nums({c: f'round({c}, 4)' for c in ('net_profit', 'total_revenue')}, 4)} FROM statements",
    digits=4,
)
def ingest_report(spark, sf):
    """Pages of several reports in one landing table; those without a result give no rows."""
    pages = raw_pages(spark, sf, INCOME, ["ts_code", "name", "notice_date", *V.INCOME_COLUMNS])
    return parse_report(pages, INCOME).select("ts_code", "name", "notice_date", "net_profit", "total_revenue")


# ---- joins ------------------------------------------------------------------------------------

ALL = [*V.INCOME_COLUMNS, *V.BALANCE_COLUMNS, *V.CASHFLOW_COLUMNS]
STATEMENT_SQL = f"{ST} SELECT {KEYS}, {nums(ALL, 4)} FROM statements"


def joined(spark, sf):
    return statement_join(V.income(spark, sf), V.balance(spark, sf), V.cashflow(spark, sf))


query("statement_join", STATEMENT_SQL, digits=4)(joined)


@query(
    "statement_join_range",
    STATEMENT_SQL + " WHERE notice_date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'",
    digits=4,
)
def joined_range(spark, sf):
    from datetime import date

    return statement_join(
        V.income(spark, sf), V.balance(spark, sf), V.cashflow(spark, sf), date(1996, 1, 1), date(1998, 12, 31)
    )


# ---- factor groups ----------------------------------------------------------------------------

NAN = "'nan'::DOUBLE"
QUALITY = {
    "gross_margin": safe_div_sql("total_revenue - operate_cost", "total_revenue", fill=NAN),
    "operate_margin": safe_div_sql("operate_profit", "total_revenue", fill=NAN),
    "net_margin": safe_div_sql("net_profit", "total_revenue", fill=NAN),
    "roe": safe_div_sql("net_profit", "total_equity", fill=NAN),
    "roa": safe_div_sql("net_profit", "total_asset", fill=NAN),
    "asset_turnover": safe_div_sql("total_revenue", "total_asset", fill=NAN),
}
LEVERAGE = {
    "debt_asset_ratio": safe_div_sql("total_debt", "total_asset"),
    "debt_to_equity": safe_div_sql("total_debt", "total_equity"),
    "current_ratio": safe_div_sql(
        "cash + accounts_receivable + inventory", "accounts_payable + advance_receivable", negative="abs"
    ),
    "quick_ratio": safe_div_sql("cash + accounts_receivable", "accounts_payable + advance_receivable", negative="abs"),
    "interest_coverage": safe_div_sql("operate_profit", "finance_expense", min_den=1.0),
}
_EQ, _NP = lag_sql("total_equity", order="notice_date"), lag_sql("net_profit", order="notice_date")
GROWTH = {
    "revenue_growth_yoy": "total_revenue_yoy / 100",
    "net_profit_growth_yoy": "net_profit_yoy / 100",
    "asset_growth_yoy": "total_asset_yoy / 100",
    "debt_growth_yoy": "total_debt_yoy / 100",
    "profit_growth_premium": "(net_profit_yoy - total_revenue_yoy) / 100",
    "roe_last": f"CASE WHEN {_EQ} > 0 THEN {_NP} / {_EQ} ELSE 0 END",
}
CASHFLOW_F = {
    "cfo_to_net_profit": safe_div_sql("cfo", "net_profit", fill="0"),
    "fcf_to_net_profit": safe_div_sql("cfo + cfi", "net_profit", fill="0"),
    "cfo_yield": safe_div_sql("cfo", "total_asset"),
    "accrual": "net_profit - cfo",
    "accrual_ratio": safe_div_sql("net_profit - cfo", "total_asset"),
}
FACTORS = QUALITY | LEVERAGE | GROWTH | CASHFLOW_F


def _group(name, exprs):
    @query(f"fund_{name}", f"{ST} SELECT {KEYS}, {nums(exprs, 5)} FROM statements", digits=5)
    def run(spark, sf):
        return fundamental.factors(V.statements(spark, sf), [name])


_group("quality", QUALITY)
_group("leverage", LEVERAGE)
_group("growth", GROWTH)
_group("cashflow", CASHFLOW_F)


@query("fund_metrics", f"{ST} SELECT {KEYS}, {nums(FACTORS, 5)} FROM statements", digits=5)
def fund_metrics(spark, sf):
    return fundamental.factors(joined(spark, sf))


@query(
    "partitioned_lag",
    f"""{ST} SELECT ts_code, notice_date, {nums({'last_profit': _NP, 'last_equity': _EQ}, 4)} FROM statements""",
    digits=4,
)
def partitioned_lag(spark, sf):
    out = over_series(
        V.statements(spark, sf),
        ["ts_code"],
        ["notice_date"],
        [lambda w: {"last_profit": F.lag("net_profit").over(w), "last_equity": F.lag("total_equity").over(w)}],
        back=1,
        ahead=0,
    )
    return out.select("ts_code", "notice_date", "last_profit", "last_equity")


TTM_STAGES = f"""q AS (SELECT *, date_trunc('quarter', notice_date)::DATE AS qs FROM statements),
    x AS (SELECT q.*, (qs - INTERVAL 3 MONTH * k)::DATE AS report_date FROM q, (SELECT unnest([0, 1, 2, 3]) AS k)),
    g AS (SELECT ts_code, report_date, sum(total_revenue) AS ttm_revenue, sum(net_profit) AS ttm_net_profit,
      sum(cfo) AS ttm_cfo, sum(cfo + cfi) AS ttm_fcf, arg_max(total_equity, notice_date) AS eq,
      arg_max(total_asset, notice_date) AS ta FROM x GROUP BY 1, 2 HAVING count(*) >= 3),
    p AS (SELECT *, {lag_sql('ttm_net_profit', order='report_date')} AS before FROM g),
    ttm AS (SELECT *, {safe_div_sql('ttm_net_profit', 'eq')} AS ttm_roe, {safe_div_sql('ttm_cfo', 'ta')} AS ttm_cfo_yield,
      coalesce(ttm_net_profit / before - 1, 0) AS profit_momentum FROM p)"""
TTM_SUMS = ["ttm_revenue", "ttm_net_profit", "ttm_cfo", "ttm_fcf"]
TTM_SQL = (
    f"{ST}, {TTM_STAGES} SELECT ts_code, report_date, {nums(TTM_SUMS, 3)}, "
    f"{nums(['ttm_roe', 'ttm_cfo_yield', 'profit_momentum'], 5)} FROM ttm"
)


@query("ttm_rolling", TTM_SQL, digits=5)
def ttm_rolling(spark, sf):
    out = fundamental.trailing_twelve_months(V.statements(spark, sf).drop("report_period"))
    return out.withColumns({c: F.round(c, 3) for c in TTM_SUMS})
