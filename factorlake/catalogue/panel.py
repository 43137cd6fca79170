"""As-of joins, universes and the research panel."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import functions as F

from ..operators.joins import (
    asof_backward,
    asof_stored,
    join_macro_left,
    membership_spans,
    suspended_filter,
    tradable_universe,
    universe_filter,
)
from ..operators import macro
from ..operators.skew import durable, shared_dir
from ..plans.panel import fundamental_features, market_features, panel_dataset, panel_stack
from ..sources.tables import write_bucketed, write_table
from . import views as V
from .crosssection import FUND, _zscore_sql, spans
from .macro import FLOW_STAGES, margin, northbound
from .market import ALL_STAGES, BARS
from .registry import clip_sql, nums, query, views

# ---- as-of and macro joins --------------------------------------------------------------------


@query(
    "asof_fundamentals",
    f"""{views('bars', 'statements')} SELECT b.ts_code, b.date, s.notice_date, {nums({'close': 'b.close', 'net_profit': 's.net_profit',
    'net_profit_yoy': 's.net_profit_yoy'}, 4)} FROM bars b ASOF LEFT JOIN statements s
    ON b.ts_code = s.ts_code AND b.date >= s.notice_date""",
    digits=4,
)
def asof(spark, sf):
    right = V.statements(spark, sf).select("ts_code", "notice_date", "net_profit", "net_profit_yoy")
    return asof_backward(V.bars(spark, sf).select("ts_code", "date", "close"), right)


@query(
    "asof_stored",
    f"""{views('bars', 'statements')} SELECT b.ts_code, b.date, s.notice_date, {nums({'close': 'b.close', 'net_profit': 's.net_profit'}, 4)}
    FROM bars b ASOF LEFT JOIN statements s ON b.ts_code = s.ts_code AND b.date >= s.notice_date""",
    digits=4,
)
def asof_of_table(spark, sf):
    """Bars from a table bucketed by code: only the reports are shuffled."""
    name, path = f"bars_{uuid.uuid4().hex}", f"{shared_dir(spark)}/bars-{uuid.uuid4().hex}"
    write_bucketed(V.bars(spark, sf).select("ts_code", "date", "close"), name, path, "ts_code", "date")
    return asof_stored(spark.table(name), V.statements(spark, sf).select("ts_code", "notice_date", "net_profit"))


@query(
    "join_macro_left",
    f"""{views('bars', 'margin')} SELECT ts_code, date, {nums(['close', 'total_margin_balance'], 2)}
    FROM bars LEFT JOIN margin USING (date)""",
    digits=2,
)
def macro_left(spark, sf):
    return join_macro_left(
        V.bars(spark, sf).select("ts_code", "date", "close"), margin(spark, sf).select("date", "total_margin_balance")
    )


# ---- universes --------------------------------------------------------------------------------


def members(spark, sf):
    """Constituents: suppliers with a positive balance."""
    return V.table(spark, sf, "supplier").where("s_acctbal > 0").select(V._code("s_suppkey").alias("ts_code"))


MEMBERS = "members_in AS (SELECT lpad(s_suppkey::VARCHAR, 6, '0') AS ts_code FROM supplier WHERE s_acctbal > 0)"


@query(
    "universe_filter_any_date",
    f"{BARS}, {MEMBERS} SELECT ts_code, date, {nums(['close'])} FROM bars WHERE ts_code IN (SELECT ts_code FROM members_in)",
)
def universe_of_codes(spark, sf):
    return universe_filter(V.bars(spark, sf), members(spark, sf)).select("ts_code", "date", "close")


def snapshots(spark, sf):
    """Constituents at the start of each quarter: suppliers that shipped no less than the average in the one before."""
    shipped = (
        V.table(spark, sf, "lineitem")
        .groupBy(F.trunc(F.col("l_shipdate").cast("date"), "quarter").alias("qs"), V._code("l_suppkey").alias("ts_code"))
        .agg(F.sum(F.col("l_quantity").cast("bigint")).alias("q"))
    )
    shipped = durable(shipped)  # read for its totals and for its rows, and both again for the days there are
    totals = shipped.groupBy("qs").agg(F.sum("q").alias("all_q"), F.count(F.lit(1)).alias("n"))
    return shipped.join(totals, "qs").where("q * n >= all_q").select(F.add_months("qs", 3).alias("date"), "ts_code")


SNAPSHOTS = """snapshots AS (SELECT (qs + INTERVAL 3 MONTH)::DATE AS date, ts_code FROM (
      SELECT date_trunc('quarter', l_shipdate)::DATE AS qs, lpad(l_suppkey::VARCHAR, 6, '0') AS ts_code, sum(l_quantity::BIGINT) AS q
      FROM lineitem GROUP BY 1, 2) QUALIFY q * count(*) OVER (PARTITION BY qs) >= sum(q) OVER (PARTITION BY qs)),
    lists AS (SELECT DISTINCT date AS listed FROM snapshots)"""


def listed_rows(src: str) -> str:
    """Rows of ``src`` whose code is on the last list before their day or on it."""
    return f"""(SELECT r.* FROM {src} r ASOF JOIN lists l ON r.date >= l.listed
      WHERE EXISTS (SELECT 1 FROM snapshots s WHERE s.ts_code = r.ts_code AND s.date = l.listed))"""


@query("universe_filter", f"{BARS}, {SNAPSHOTS} SELECT ts_code, date, {nums(['close'])} FROM {listed_rows('bars')}")
def universe(spark, sf):
    """Members leave and return with every quarterly list."""
    return universe_filter(V.bars(spark, sf), membership_spans(snapshots(spark, sf))).select("ts_code", "date", "close")


@query(
    "membership_spans",
    f"""WITH {SNAPSHOTS}, n AS (SELECT listed, row_number() OVER (ORDER BY listed) AS no FROM lists),
    i AS (SELECT s.ts_code, s.date, no, no - row_number() OVER (PARTITION BY s.ts_code ORDER BY no) AS island FROM snapshots s JOIN n ON listed = date)
    SELECT ts_code, min(date) AS valid_from, (SELECT listed FROM n WHERE n.no = max(i.no) + 1) AS valid_to FROM i GROUP BY ts_code, island""",
)
def spans_of_members(spark, sf):
    return membership_spans(snapshots(spark, sf))


LISTED = """WITH listed AS (SELECT lpad(c_custkey::VARCHAR, 6, '0') AS ts_code, CASE WHEN c_acctbal < 0 THEN '*ST ' ELSE '' END || c_mktsegment AS name, min(o_orderdate)::DATE AS publish_date,
      max(o_orderdate)::DATE AS off_date FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2)"""


@query(
    "tradable_universe",
    f"""{LISTED} SELECT ts_code, name FROM listed WHERE publish_date <= DATE '2000-06-30' - 365 AND off_date > DATE '2000-06-30'
    AND NOT contains(upper(name), 'ST')""",
)
def tradable(spark, sf):
    """Customers as codes: listed with their first order, delisted with their last;
    those in debt carry the special-treatment marker in their name.
    """
    joined = V.table(spark, sf, "customer").join(V.table(spark, sf, "orders"), F.col("o_custkey") == F.col("c_custkey"))
    codes = joined.groupBy(
        V._code("c_custkey").alias("ts_code"), F.concat(F.when(F.col("c_acctbal") < 0, "*ST ").otherwise(""), "c_mktsegment").alias("name")
    ).agg(
        F.min("o_orderdate").cast("date").alias("publish_date"), F.max("o_orderdate").cast("date").alias("off_date")
    )
    return tradable_universe(codes, codes, date(2000, 6, 30))


@query(
    "suspended_filter",
    f"""{BARS} SELECT ts_code, date, {nums(['close'])} FROM bars b WHERE NOT EXISTS (SELECT 1 FROM lineitem
    WHERE l_returnflag = 'R' AND lpad(l_suppkey::VARCHAR, 6, '0') = b.ts_code AND l_shipdate::DATE = b.date)""",
)
def suspended(spark, sf):
    """Codes count as suspended on days with a return."""
    halted = (
        V.table(spark, sf, "lineitem")
        .where("l_returnflag = 'R'")
        .select(V._code("l_suppkey").alias("ts_code"), F.col("l_shipdate").cast("date").alias("date"))
    )
    return suspended_filter(V.bars(spark, sf).select("ts_code", "date", "close"), halted)


# ---- the panel --------------------------------------------------------------------------------

MARKET_COLS = ["ma12_dev", "roc_4", "vola_20", "atr_pct", "ret_1q"]
FUND_COLS = ["roe", "gross_margin", "current_ratio", "accrual_ratio"]
MACRO_COLS = ["nb_flow_z_short", "nb_flow_z_long"]
START, END, LABEL = date(1996, 1, 1), date(2000, 12, 31), "ret_1q"

_MARKET = f"""{ALL_STAGES.format(src='bars')}, mk AS (SELECT ts_code, date, ret_1q, roc_4, vola_20,
    {clip_sql('close / ma_12 - 1', -10, 10)} AS ma12_dev, {clip_sql('atr / close', 0, 1)} AS atr_pct FROM t3)"""


def _inputs(spark, sf):
    market = market_features(V.bars(spark, sf)).select("ts_code", "date", *MARKET_COLS)
    # The check of group sizes reads the reports, too: they are taken from the lines once.
    reports = durable(V.statements(spark, sf))
    fund = durable(fundamental_features(reports).select("ts_code", "name", "notice_date", *FUND_COLS))
    flow = macro.northbound(northbound(spark, sf)).select("date", *MACRO_COLS)
    return market, fund, flow


@query(
    "panel_stack",
    f"""{views('bars', 'statements', 'northbound')}, {_MARKET}, {FUND}, {FLOW_STAGES}
    SELECT m.ts_code, m.date, f.name, f.notice_date, {nums({c: f'm.{c}' for c in MARKET_COLS} | {c: f'f.{c}' for c in FUND_COLS}
    | {c: f'n.{c}' for c in MACRO_COLS}, 5)} FROM mk m ASOF LEFT JOIN f ON m.ts_code = f.ts_code AND m.date >= f.notice_date
    LEFT JOIN f3 n ON n.date = m.date""",
    digits=5,
)
def stack(spark, sf):
    return panel_stack(*_inputs(spark, sf))


_ZSTAGE, _ZCOLS = _zscore_sql("fi", "sw_l1_code, notice_date", FUND_COLS, True, 5)
_PANEL_Z = [f"cs_{c}_{s}" for c in FUND_COLS for s in ("win", "z")]


@query(
    "panel_dataset",
    f"""{views('bars', 'statements', 'northbound', 'classification')}, {SNAPSHOTS}, {_MARKET}, {FUND}, {FLOW_STAGES},
    fi AS (SELECT f.*, sw_l1_code FROM f ASOF JOIN classification c ON c.ts_code = f.ts_code AND f.notice_date >= c.join_date
      WHERE notice_date <= DATE '{END}'),
    {_ZSTAGE}, z AS (SELECT ts_code, name, notice_date, sw_l1_code, {', '.join(FUND_COLS)}, {_ZCOLS} FROM z2)
    SELECT m.ts_code, m.date, z.name, z.notice_date, z.sw_l1_code, {nums({c: f'm.{c}' for c in MARKET_COLS} |
    {c: f'z.{c}' for c in FUND_COLS} | {c: f'n.{c}' for c in MACRO_COLS}, 5)}, {nums({c: f'z.{c}' for c in _PANEL_Z}, 5)}
    FROM (SELECT * FROM {listed_rows('mk')} WHERE isodow(date) = 5 AND date BETWEEN DATE '{START}' AND DATE '{END}') m
    ASOF LEFT JOIN z ON m.ts_code = z.ts_code AND m.date >= z.notice_date LEFT JOIN f3 n ON n.date = m.date""",
    digits=5,
)
def dataset(spark, sf, min_group_size=5):
    market, fund, flow = _inputs(spark, sf)
    out = panel_dataset(
        market,
        fund,
        flow,
        spans(spark, sf),
        membership_spans(snapshots(spark, sf)),
        factors=FUND_COLS,
        start=START,
        end=END,
        label=LABEL,
        min_group_size=min_group_size,
    )
    return out.withColumns({c: F.round(c, 4) for c in _PANEL_Z})


def labelled_panel(spark, sf):
    """Bars with a forward return and a few features: the input of labels and splits."""
    return market_features(V.bars(spark, sf)).select("ts_code", "date", "ret_1m", "roc_4", "roc_12", "ma12_dev", "vola_20")


def stored_panel(spark, sf):
    """The same as a table in the shared folder, for those who read it several times."""
    path = f"{shared_dir(spark)}/labelled-{uuid.uuid4().hex}"
    write_table(labelled_panel(spark, sf), path)
    return spark.read.parquet(path)


@query(
    "market_features_duplicates",
    f"""{BARS}, again AS (SELECT * EXCLUDE (close), close, 1 AS seq FROM bars UNION ALL BY NAME
      SELECT * EXCLUDE (close), close * 2 AS close, 2 AS seq FROM bars WHERE day(date) % 7 = 0),
    nb AS (SELECT * EXCLUDE (seq, rn) FROM (SELECT *, row_number() OVER (PARTITION BY ts_code, date ORDER BY seq DESC) AS rn FROM again)
      WHERE rn = 1), {ALL_STAGES.format(src='nb')}
    SELECT ts_code, date, {nums(['ret_1q', 'roc_4'], 5)} FROM t3""",
    digits=5,
)
def duplicates(spark, sf):
    """Some days have a second bar with twice the close; the one that came in later counts."""
    bars = V.bars(spark, sf)
    late = bars.where(F.day("date") % 7 == 0).withColumn("close", F.col("close") * 2)
    both = bars.withColumn("seq", F.lit(1)).unionByName(late.withColumn("seq", F.lit(2)))
    return market_features(both, ["seq"]).select("ts_code", "date", "ret_1q", "roc_4")


LABELLED = f"""{ALL_STAGES.format(src='bars')}, lp AS (SELECT ts_code, date, ret_1m, roc_4, roc_12, vola_20,
    {clip_sql('close / ma_12 - 1', -10, 10)} AS ma12_dev FROM t3)"""
