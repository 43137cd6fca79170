"""Quarterly fundamental factors from joined income, balance and cash-flow statements."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import NAN, div, safe_div
from .relational import dedupe_last, ensure_columns
from .skew import MAX_GROUP_ROWS, over_series
from .staged import FeatureGroup

log = logging.getLogger(__name__)

IDENTS = ("ts_code", "name", "notice_date")

# Statement columns the factors read.
RAW_COLUMNS = (
    "net_profit", "total_revenue", "operate_profit", "operate_cost", "total_asset", "total_equity",
    "total_debt", "cash", "accounts_receivable", "inventory", "accounts_payable", "advance_receivable",
    "finance_expense", "cfo", "cfi", "net_profit_yoy", "total_revenue_yoy", "total_asset_yoy", "total_debt_yoy",
)


def quality() -> FeatureGroup:
    """Margins, returns and asset turnover; an undefined ratio is NaN."""
    profit = F.col("total_revenue") - F.col("operate_cost")
    ratios = {
        "gross_margin": (profit, "total_revenue"),
        "operate_margin": ("operate_profit", "total_revenue"),
        "net_margin": ("net_profit", "total_revenue"),
        "roe": ("net_profit", "total_equity"),
        "roa": ("net_profit", "total_asset"),
        "asset_turnover": ("total_revenue", "total_asset"),
    }
    return FeatureGroup(
        tuple(ratios), (lambda w: {k: safe_div(n, d, fill=NAN) for k, (n, d) in ratios.items()},), back=0, ahead=0
    )


def leverage() -> FeatureGroup:
    """Debt, liquidity and interest coverage."""
    liquid = F.col("cash") + F.col("accounts_receivable")
    due = F.col("accounts_payable") + F.col("advance_receivable")
    return FeatureGroup(
        ("debt_asset_ratio", "debt_to_equity", "current_ratio", "quick_ratio", "interest_coverage"),
        (
            lambda w: {
                "debt_asset_ratio": safe_div("total_debt", "total_asset"),
                "debt_to_equity": safe_div("total_debt", "total_equity"),
                "current_ratio": safe_div(liquid + F.col("inventory"), due, negative="abs"),
                "quick_ratio": safe_div(liquid, due, negative="abs"),
                "interest_coverage": safe_div("operate_profit", "finance_expense", min_den=1.0),
            },
        ),
        back=0,
        ahead=0,
    )


def growth() -> FeatureGroup:
    """Year-on-year growth as fractions, and the previous report's return on equity (0 if undefined).

    The previous report is looked up over the full history of the code.
    """

    def previous(w):
        equity, profit = F.lag("total_equity").over(w), F.lag("net_profit").over(w)
        return {"_last_equity": equity, "_last_profit": profit}

    def derived(w):
        pct = {
            "revenue_growth_yoy": F.col("total_revenue_yoy"),
            "net_profit_growth_yoy": F.col("net_profit_yoy"),
            "asset_growth_yoy": F.col("total_asset_yoy"),
            "debt_growth_yoy": F.col("total_debt_yoy"),
            "profit_growth_premium": F.col("net_profit_yoy") - F.col("total_revenue_yoy"),
        }
        equity = F.col("_last_equity")
        return {k: v / 100.0 for k, v in pct.items()} | {
            "roe_last": F.when(equity > 0, div(F.col("_last_profit"), equity)).otherwise(F.lit(0.0))
        }

    return FeatureGroup(
        (
            "revenue_growth_yoy", "net_profit_growth_yoy", "asset_growth_yoy", "debt_growth_yoy",
            "profit_growth_premium", "roe_last",
        ),
        (previous, derived),
        back=1,
        ahead=0,
    )


def cashflow() -> FeatureGroup:
    """Cash conversion, free-cash-flow proxy and accruals."""
    accrual = F.col("net_profit") - F.col("cfo")
    return FeatureGroup(
        ("cfo_to_net_profit", "fcf_to_net_profit", "cfo_yield", "accrual", "accrual_ratio"),
        (
            lambda w: {
                "cfo_to_net_profit": safe_div("cfo", "net_profit", fill=0.0),
                "fcf_to_net_profit": safe_div(F.col("cfo") + F.col("cfi"), "net_profit", fill=0.0),
                "cfo_yield": safe_div("cfo", "total_asset"),
                "accrual": accrual,
                "accrual_ratio": safe_div(accrual, "total_asset"),
            },
        ),
        back=0,
        ahead=0,
    )


GROUPS = {"quality": quality, "leverage": leverage, "growth": growth, "cashflow": cashflow}


def factors(
    df: DataFrame, groups: Sequence[str] = tuple(GROUPS), *, max_rows: int | None = MAX_GROUP_ROWS
) -> DataFrame:
    """Identifiers and the factors of the chosen groups, in one projection.

    Absent statement columns count as null and are logged. Rows with a null identifier are dropped when
    groups are combined, as they could not be matched across groups.
    """
    absent = [c for c in RAW_COLUMNS if c not in df.columns]
    if absent:
        log.warning("missing statement columns, treated as null: %s", absent)
        df = ensure_columns(df, {c: "double" for c in absent})
    if len(groups) > 1:
        df = df.na.drop(subset=list(IDENTS))
    chosen = [GROUPS[g]() for g in groups]
    outputs = [o for g in chosen for o in g.outputs]
    need_window = "growth" in groups
    base = df.select(*IDENTS, *RAW_COLUMNS)
    merged = {}
    for g in chosen:
        merged.update(g.stages[-1](None))
    if need_window:
        base = over_series(base, ["ts_code"], ["notice_date", "name"], [growth().stages[0]], back=1, ahead=0, max_rows=max_rows)
    return base.withColumns(merged).select(*IDENTS, *outputs)


def trailing_twelve_months(
    df: DataFrame, min_periods: int = 3, *, max_rows: int | None = MAX_GROUP_ROWS
) -> DataFrame:
    """Four-quarter sums per code, one window starting in every quarter.

    A window covers ``[report_date, report_date + 12 months)`` of notice dates, so ``report_date`` is its
    first day. Windows with fewer than ``min_periods`` reports are dropped. Reports are first summed per
    quarter; only those small sums are copied into the four windows that cover them.
    """
    if "notice_date" not in df.columns:
        raise ValueError("notice_date column missing")
    if "report_period" in df.columns:
        df = dedupe_last(df, ["ts_code", "report_period"], ["notice_date"])
        order = ["notice_date", "report_period"]
    else:
        df = dedupe_last(df, ["ts_code", "notice_date"], [])
        order = ["notice_date"]
    sums = {
        "ttm_revenue": F.col("total_revenue"),
        "ttm_net_profit": F.col("net_profit"),
        "ttm_cfo": F.col("cfo"),
        "ttm_fcf": F.col("cfo") + F.col("cfi"),
    }
    latest = F.max_by(
        F.struct(F.col("total_equity").alias("equity"), F.col("total_asset").alias("assets")), F.struct(*order)
    )
    quarterly = df.groupBy("ts_code", F.trunc("notice_date", "quarter").alias("_quarter")).agg(
        *[F.sum(v).alias(k) for k, v in sums.items()],
        latest.alias("_latest"),
        F.count(F.lit(1)).alias("_n"),
    )
    starts = F.sequence(F.add_months("_quarter", -9).cast("date"), F.col("_quarter"), F.expr("interval 3 months"))
    windows = (
        quarterly.withColumn("report_date", F.explode(starts))
        .groupBy("ts_code", "report_date")
        .agg(
            *[F.coalesce(F.sum(k), F.lit(0.0)).alias(k) for k in sums],
            F.max_by("_latest", "_quarter").alias("_latest"),
            F.sum("_n").alias("_n"),
        )
        .where(F.col("_n") >= min_periods)
    )
    # One row per code and quarter from here on.
    out = over_series(
        windows,
        ["ts_code"],
        ["report_date"],
        [lambda w: {"_before": F.lag("ttm_net_profit").over(w)}],
        back=1,
        ahead=0,
        max_rows=max_rows,
    )
    return out.select(
        "ts_code",
        "report_date",
        *sums,
        safe_div("ttm_net_profit", "_latest.equity").alias("ttm_roe"),
        safe_div("ttm_cfo", "_latest.assets").alias("ttm_cfo_yield"),
        F.coalesce(div(F.col("ttm_net_profit"), F.col("_before")) - 1, F.lit(0.0)).alias("profit_momentum"),
    )
