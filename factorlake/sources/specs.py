"""Column specifications: raw field -> column name.

Fixed values: field names are those of the raw sources, column names those of the normalised tables.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass


@dataclass(frozen=True)
class TableSpec:
    """``columns``: source -> target. Targets not listed in ``text`` or as ``date_col`` are doubles."""

    columns: Mapping[str, str]
    text: Sequence[str] = ()
    date_col: str | None = None
    unique: Sequence[str] = ()

    @property
    def numeric(self) -> list[str]:
        return [t for t in self.columns.values() if t not in self.text and t != self.date_col]


_REPORT = {"text": ("ts_code", "name"), "date_col": "notice_date", "unique": ("ts_code", "notice_date")}

INCOME = TableSpec(
    {
        "SECURITY_CODE": "ts_code",
        "SECURITY_NAME_ABBR": "name",
        "NOTICE_DATE": "notice_date",
        "TOTAL_PROFIT": "total_profit",
        "PARENT_NETPROFIT": "net_profit",
        "PARENT_NETPROFIT_RATIO": "net_profit_yoy",
        "OPERATE_PROFIT": "operate_profit",
        "TOTAL_OPERATE_INCOME": "total_revenue",
        "TOI_RATIO": "total_revenue_yoy",
        "TOTAL_OPERATE_COST": "total_cost",
        "TOE_RATIO": "total_cost_yoy",
        "OPERATE_COST": "operate_cost",
        "OPERATE_EXPENSE": "operate_expense",
        "OPERATE_EXPENSE_RATIO": "operate_expense_ratio",
        "SALE_EXPENSE": "sale_expense",
        "MANAGE_EXPENSE": "manage_expense",
        "FINANCE_EXPENSE": "finance_expense",
    },
    **_REPORT,
)

BALANCE = TableSpec(
    {
        "SECURITY_CODE": "ts_code",
        "SECURITY_NAME_ABBR": "name",
        "NOTICE_DATE": "notice_date",
        "TOTAL_ASSETS": "total_asset",
        "TOTAL_ASSETS_RATIO": "total_asset_yoy",
        "MONETARYFUNDS": "cash",
        "ACCOUNTS_RECE": "accounts_receivable",
        "INVENTORY": "inventory",
        "TOTAL_LIABILITIES": "total_debt",
        "TOTAL_LIAB_RATIO": "total_debt_yoy",
        "ACCOUNTS_PAYABLE": "accounts_payable",
        "ADVANCE_RECEIVABLES": "advance_receivable",
        "DEBT_ASSET_RATIO": "debt_asset_ratio",
        "CURRENT_RATIO": "current_ratio",
        "TOTAL_EQUITY": "total_equity",
    },
    **_REPORT,
)

# "cfo" holds cash received from sales and services, as the source maps it; it is not the net operating
# cash flow, which is "net_cashflow".
CASHFLOW = TableSpec(
    {
        "SECURITY_CODE": "ts_code",
        "SECURITY_NAME_ABBR": "name",
        "NOTICE_DATE": "notice_date",
        "NETCASH_OPERATE": "net_cashflow",
        "NETCASH_OPERATE_RATIO": "net_cashflow_yoy",
        "SALES_SERVICES": "cfo",
        "SALES_SERVICES_RATIO": "cfo_ratio",
        "NETCASH_INVEST": "cfi",
        "NETCASH_INVEST_RATIO": "cfi_ratio",
        "NETCASH_FINANCE": "cff",
        "NETCASH_FINANCE_RATIO": "cff_ratio",
    },
    **_REPORT,
)

KLINE_FIELDS = (
    "date", "open", "close", "high", "low", "volume", "amount", "amplitude", "change_pct", "change_amt", "turnover",
)

KLINE = TableSpec(
    {"date": "date", "ts_code": "ts_code"} | {f: f for f in KLINE_FIELDS[1:]},
    text=("ts_code",),
    date_col="date",
    unique=("ts_code", "date"),
)

INDEX_MEMBERS = TableSpec(
    {"日期Date": "date", "成份券代码Constituent Code": "ts_code", "成份券名称Constituent Name": "name"},
    text=("ts_code", "name"),
    date_col="date",
)

# ---- alternate quarterly reports: shared identifiers and one map per report -------------------

QUARTER_IDENTS = {"code": "ts_code", "pubDate": "notice_date", "statDate": "date"}

QUARTER_REPORTS = {
    "profit": {
        "roeAvg": "roe",
        "npMargin": "net_margin",
        "gpMargin": "gross_margin",
        "netProfit": "net_profit",
        "epsTTM": "eps_ttm",
        "MBRevenue": "total_revenue",
        "totalShare": "total_shares",
        "liqaShare": "float_shares",
    },
    "operation": {
        "NRTurnRatio": "receivable_turnover",
        "NRTurnDays": "receivable_turnover_days",
        "INVTurnRatio": "inventory_turnover",
        "INVTurnDays": "inventory_turnover_days",
        "CATurnRatio": "current_assets_turnover",
        "AssetTurnRatio": "total_asset_turnover",
    },
    "growth": {
        "YOYEquity": "equity_yoy",
        "YOYAsset": "total_asset_yoy",
        "YOYNI": "net_profit_yoy",
        "YOYEPSBasic": "eps_basic_yoy",
        "YOYPNI": "net_profit_parent_yoy",
    },
    "balance": {
        "currentRatio": "current_ratio",
        "quickRatio": "quick_ratio",
        "cashRatio": "cash_ratio",
        "YOYLiability": "total_debt_yoy",
        "liabilityToAsset": "debts_to_assets",
        "assetToEquity": "assets_to_equity",
    },
    "cashflow": {
        "CAToAsset": "current_assets_to_total_asset",
        "NCAToAsset": "non_current_assets_to_total_asset",
        "tangibleAssetToAsset": "tangible_assets_to_total_asset",
        "ebitToInterest": "ebit_to_interest",
        "CFOToOR": "cfo_to_revenue",
        "CFOToNP": "cfo_to_net_profit",
        "CFOToGr": "cfo_to_total_revenue",
    },
    "dupont": {
        "dupontROE": "roe",
        "dupontAssetStoEquity": "assets_to_equity",
        "dupontAssetTurn": "total_asset_turnover",
        "dupontPnitoni": "parent_profit_ratio",
        "dupontNitogr": "net_margin",
        "dupontTaxBurden": "tax_burden",
        "dupontIntburden": "interest_burden",
        "dupontEbittogr": "ebit_margin",
    },
}

STRING_BARS = {"code": "ts_code", "turn": "turnover", "tradestatus": "trade_status", "isST": "is_st"}

# ---- market-wide series -----------------------------------------------------------------------

CHANNEL_FLOW = {
    "日期": "date",
    "当日成交净买额": "net_buy",
    "当日资金流入": "fund_inflow",
    "历史累计净买额": "cum_net_buy",
}

MARGIN = {
    "日期": "date",
    "融资买入额": "margin_buy_amount",
    "融资余额": "margin_balance",
    "融券卖出量": "short_sell_volume",
    "融券余额": "short_balance",
    "融资融券余额": "total_margin_balance",
}
MARGIN_DROPPED = "融券余量"

SHIBOR = {
    "日期": "date",
    "O/N-定价": "ON_rate",
    "O/N-涨跌幅": "ON_change",
    "1W-定价": "1W_rate",
    "1W-涨跌幅": "1W_change",
    "2W-定价": "2W_rate",
    "2W-涨跌幅": "2W_change",
    "1M-定价": "1M_rate",
    "1M-涨跌幅": "1M_change",
    "3M-定价": "3M_rate",
    "3M-涨跌幅": "3M_change",
    "6M-定价": "6M_rate",
    "6M-涨跌幅": "6M_change",
    "9M-定价": "9M_rate",
    "9M-涨跌幅": "9M_change",
    "1Y-定价": "1Y_rate",
    "1Y-涨跌幅": "1Y_change",
}

# ---- industry classification ------------------------------------------------------------------

INDUSTRY_L1 = {"行业代码": "sw_l1_code", "行业名称": "sw_l1_name"}
INDUSTRY_L2 = {"行业代码": "sw_l2_code", "行业名称": "sw_l2_name", "上级行业": "sw_l1_name"}
INDUSTRY_L3 = {
    "行业代码": "sw_l3_code",
    "行业名称": "sw_l3_name",
    "上级行业": "sw_l2_name",
    "成份个数": "constituent_count",
    "静态市盈率": "pe_static",
    "TTM(滚动)市盈率": "pe_ttm",
    "市净率": "pb",
    "静态股息率": "dividend_yield",
}
INDUSTRY_MEMBERS = {
    "股票代码": "ts_code_suffix",
    "股票简称": "name",
    "纳入时间": "join_date",
    "申万1级": "sw_l1_name",
    "申万2级": "sw_l2_name",
    "申万3级": "sw_l3_name",
}
INDUSTRY_LEVELS = {1: INDUSTRY_L1, 2: INDUSTRY_L2, 3: INDUSTRY_L3}
INDUSTRY_FIGURES = ("constituent_count", "pe_static", "pe_ttm", "pb", "dividend_yield")
