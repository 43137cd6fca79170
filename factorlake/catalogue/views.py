"""Domain tables derived from the driver tables, as DataFrames and as SQL.

Sums of money are taken in decimal, so both engines agree to the last bit whatever their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.skew import route
from ..sources.specs import MARGIN, MARGIN_DROPPED, SHIBOR


# Monetary values are multiplied by this factor (a currency conversion, say), so that they are not short
# decimals: those sit exactly between two roundings, where engines differ.
UNIT = 0.9876543210987


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _code(c: str):
    text = F.col(c).cast("string")
    return F.lpad(text, F.greatest(F.lit(6), F.length(text)), F.lit("0"))


def bars(spark: SparkSession, sf: str) -> DataFrame:
    """One bar per supplier and ship day (at most one row per ticker and calendar day).

    Most bars hold one line, so lines are not combined before their shuffle: they are dealt by ticker, and neither the
    bars nor windows over their tickers need another exchange or sort. Tickers of very many lines are combined first.
    """
    li = table(spark, sf, "lineitem").select(
        "l_suppkey",
        _code("l_suppkey").alias("ts_code"),
        F.col("l_shipdate").cast("date").alias("date"),
        (F.col("l_extendedprice") / F.col("l_quantity") * UNIT).alias("p"),
        (F.col("l_discount") + F.lit(0.0)).alias("d"),
        (F.col("l_tax") + F.lit(0.0)).alias("t"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice",
    )
    k = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "d", "t")
    p, d, t = F.col("p"), F.col("d"), F.col("t")

    def combined(lines: DataFrame) -> DataFrame:
        return lines.groupBy("ts_code", "date").agg(
            F.min_by(p * (1 + (d - t) / 2), k).alias("open"),
            F.max(p * (1 + d)).alias("high"),
            F.min(p * (1 - t)).alias("low"),
            F.max_by(p, k).alias("close"),
            F.sum("l_quantity").alias("volume"),
            (F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double") * UNIT).alias("amount"),
        )

    return route(li, ["l_suppkey"], lambda lines: combined(lines.repartition("ts_code")), combined)


def statements(spark: SparkSession, sf: str) -> DataFrame:
    """All statement columns per supplier and calendar quarter of shipping."""
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    disc, tax = F.col("l_discount").cast("decimal(4,2)"), F.col("l_tax").cast("decimal(4,2)")
    sold = price * (1 - disc)
    q = (
        table(spark, sf, "lineitem")
        .groupBy(_code("l_suppkey").alias("ts_code"), F.trunc(F.col("l_shipdate").cast("date"), "quarter").alias("qs"))
        .agg(
            F.sum(price).alias("gross"),
            F.sum(sold).alias("rev"),
            F.sum(sold * (1 - tax)).alias("net"),
            F.sum(price * tax).alias("taxes"),
            F.sum(F.when(F.col("l_returnflag") == "R", sold).otherwise(F.lit(0).cast("decimal(4,2)"))).alias("returned"),
        )
    )
    # One row per supplier and quarter: windows of at most four rows a year.
    # All steps share the key, so they share one exchange by it.
    w = Window.partitionBy("ts_code").orderBy("qs")
    running = F.sum(F.col("net") * 10 - F.col("gross") * 7).over(w.rowsBetween(Window.unboundedPreceding, 0))
    q = q.withColumn("cum", running.cast("double") * UNIT / 10)
    q = q.select("ts_code", "qs", "cum", *[(F.col(c).cast("double") * UNIT).alias(c) for c in ("gross", "rev", "net", "taxes", "returned")])
    s = table(spark, sf, "supplier").select(_code("s_suppkey").alias("ts_code"), "s_name", "s_acctbal")
    gross, rev, bal = F.col("gross"), F.col("rev"), F.col("s_acctbal")
    end = F.last_day(F.add_months("qs", 2))
    x = q.join(s, "ts_code").select(
        "ts_code",
        F.col("s_name").alias("name"),
        F.date_add(end, 30).alias("notice_date"),
        end.alias("report_period"),
        rev.alias("total_revenue"),
        (gross * 0.7).alias("operate_cost"),
        (gross * 0.7 + F.col("taxes")).alias("total_cost"),
        (F.col("net") - gross * 0.7).alias("net_profit"),
        (rev - gross * 0.7).alias("operate_profit"),
        (rev - gross * 0.7 - F.col("taxes")).alias("total_profit"),
        (F.col("taxes") - gross * 0.04).alias("finance_expense"),
        (bal * 1000 + F.col("cum")).alias("total_equity"),
        (gross * 0.4 + F.abs(bal) * 10).alias("total_debt"),
        (bal * 10).alias("cash"),
        (rev * 0.1).alias("accounts_receivable"),
        (gross * 0.2).alias("inventory"),
        (gross * 0.15).alias("accounts_payable"),
        (bal * 20).alias("advance_receivable"),
        (rev - F.col("returned") - gross * 0.7).alias("cfo"),
        (F.col("returned") * -0.5).alias("cfi"),
    )
    x = x.withColumn("total_asset", F.col("total_equity") + F.col("total_debt")).withColumn(
        "net_cashflow", F.col("cfo") + F.col("cfi")
    )
    yw = Window.partitionBy("ts_code").orderBy("report_period")
    return x.withColumns(
        {
            f"{c}_yoy": (F.try_divide(F.col(c), F.lag(c, 4).over(yw)) - 1) * 100
            for c in ("total_revenue", "net_profit", "total_asset", "total_debt")
        }
    )


_KEYS = ["ts_code", "name", "notice_date"]
INCOME_COLUMNS = [
    "total_profit", "net_profit", "net_profit_yoy", "operate_profit", "total_revenue", "total_revenue_yoy",
    "total_cost", "operate_cost", "finance_expense",
]
BALANCE_COLUMNS = [
    "total_asset", "total_asset_yoy", "cash", "accounts_receivable", "inventory", "total_debt", "total_debt_yoy",
    "accounts_payable", "advance_receivable", "total_equity",
]
CASHFLOW_COLUMNS = ["net_cashflow", "cfo", "cfi"]


def income(spark, sf):
    return statements(spark, sf).select(*_KEYS, *INCOME_COLUMNS)


def balance(spark, sf):
    return statements(spark, sf).select(*_KEYS, *BALANCE_COLUMNS)


def cashflow(spark, sf):
    return statements(spark, sf).select(*_KEYS, *CASHFLOW_COLUMNS)


# ---- industry ---------------------------------------------------------------------------------


def industry_levels(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """L1 = region, L2 = nation, L3 = three parts of a nation; one nation's parent name is misspelt."""
    region, nation = table(spark, sf, "region"), table(spark, sf, "nation")
    l1 = region.select(F.format_string("80%d000", "r_regionkey").alias("sw_l1_code"), F.col("r_name").alias("sw_l1_name"))
    named = nation.join(region, nation.n_regionkey == region.r_regionkey)
    parent = F.when(F.col("n_name") == "NATION_24", "NOWHERE").otherwise(F.col("r_name"))
    l2 = named.select(
        F.format_string("81%02d00", "n_nationkey").alias("sw_l2_code"),
        F.col("n_name").alias("sw_l2_name"),
        parent.alias("sw_l1_name"),
    )
    part = nation.select("n_nationkey", "n_name", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("m"))
    l3 = part.select(
        F.format_string("82%02d%02d", "n_nationkey", "m").alias("sw_l3_code"),
        F.concat_ws("-", "n_name", F.col("m").cast("string")).alias("sw_l3_name"),
        F.col("n_name").alias("sw_l2_name"),
    )
    return l1, l2, l3


def industry_members(spark, sf) -> DataFrame:
    """Constituents with join dates; suppliers in debt changed nation 700 days after joining."""
    s = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    joined = F.date_add(F.lit("1995-01-01").cast("date"), F.floor(F.abs("s_acctbal") / 6).cast("int"))
    m = (F.col("s_suppkey") % 3).cast("int")
    history = F.when(F.col("s_acctbal") < 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = s.select("*", F.explode(history).alias("step"))
    nation = (F.col("s_nationkey") + F.col("step")) % 25
    return rows.select(
        F.concat(_code("s_suppkey"), F.lit(".SZ")).alias("ts_code_suffix"),
        F.col("s_name").alias("name"),
        F.date_add(joined, F.col("step") * 700).alias("join_date"),
        F.format_string("82%02d%02d", nation, m).alias("sw_l3_code"),
        F.concat(F.lit("NATION_"), nation.cast("string"), F.lit("-"), m.cast("string")).alias("sw_l3_name"),
    )


# ---- market-wide series -----------------------------------------------------------------------


def channel(spark, sf, status: str) -> DataFrame:
    """Flow of one channel (a line status) per ship day."""
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    daily = (
        table(spark, sf, "lineitem")
        .where(F.col("l_linestatus") == status)
        .groupBy(F.col("l_shipdate").cast("date").alias("date"))
        .agg(
            F.sum(F.when(F.col("l_returnflag") == "R", -price).otherwise(price)).alias("net_buy"),
            F.sum(price).alias("fund_inflow"),
        )
    )
    upto = Window.partitionBy(F.lit(0)).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return daily.withColumn("cum_net_buy", F.sum("net_buy").over(upto)).select(
        "date", *[(F.col(c).cast("double") * UNIT).alias(c) for c in ("net_buy", "fund_inflow", "cum_net_buy")]
    )


def margin_raw(spark, sf, parity: int) -> DataFrame:
    """Margin table of one exchange (odd or even customers), under the raw column names."""
    total = F.col("o_totalprice").cast("decimal(18,2)")
    short = F.col("o_orderstatus") == "F"
    daily = (
        table(spark, sf, "orders")
        .where(F.col("o_custkey") % 2 == parity)
        .groupBy(F.col("o_orderdate").cast("date").alias("date"))
        .agg(
            F.sum(total).alias("bought"),
            F.count_if(short).alias("sold"),
            F.sum(F.when(short, total).otherwise(F.lit(0).cast("decimal(18,2)"))).alias("short_amount"),
        )
    )
    w = Window.partitionBy(F.lit(0)).orderBy("date").rowsBetween(-19, 0)
    x = daily.withColumns({"long_bal": F.sum("bought").over(w), "short_bal": F.sum("short_amount").over(w)})
    cols = {
        "date": F.col("date"),
        "margin_buy_amount": F.col("bought").cast("double") * UNIT,
        "margin_balance": F.col("long_bal").cast("double") * UNIT,
        "short_sell_volume": F.col("sold"),
        "short_balance": F.col("short_bal").cast("double") * UNIT,
        "total_margin_balance": (F.col("long_bal") + F.col("short_bal")).cast("double") * UNIT,
    }
    raw = {v: k for k, v in MARGIN.items()}
    out = x.select(*[c.alias(raw[n]) for n, c in cols.items()])
    return out.withColumn(MARGIN_DROPPED, F.lit(0.0)) if parity else out


# Order priority standing in for each quoted tenor.
TENOR_PRIORITY = {"ON": "1-URGENT", "1W": "2-HIGH", "1M": "3-MEDIUM", "3M": "4-NOT SPECIFIED", "1Y": "5-LOW"}


def shibor_raw(spark, sf) -> DataFrame:
    """Interbank rates per order day under the raw column names; a missing priority is a null tenor."""
    total = F.col("o_totalprice").cast("decimal(18,2)")
    aggs = []
    for tenor, prio in TENOR_PRIORITY.items():
        hit = F.col("o_orderpriority") == prio
        mean = F.try_divide(F.sum(F.when(hit, total)).cast("double"), F.count_if(hit))
        aggs.append((mean * UNIT / 100000).alias(f"{tenor}_rate"))
    daily = table(spark, sf, "orders").groupBy(F.col("o_orderdate").cast("date").alias("date")).agg(*aggs)
    daily = daily.withColumns(
        {
            "2W_rate": F.col("1W_rate") * 1.25,
            "6M_rate": F.col("3M_rate") * 1.25,
            "9M_rate": F.col("3M_rate") * 1.5,
        }
    )
    cols = {}
    for target in SHIBOR.values():
        cols[target] = F.col(target) if not target.endswith("_change") else F.col(target.replace("_change", "_rate")) / 8
    return daily.select(*[cols[t].alias(s) for s, t in SHIBOR.items()])


def index_raw(spark, sf) -> DataFrame:
    """All bars of a day as one index bar."""
    return bars(spark, sf).groupBy("date").agg(
        F.min_by("open", "ts_code").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "ts_code").alias("close"),
        F.sum("volume").alias("volume"),
        F.sum("amount").alias("amount"),
    )


def qvix_raw(spark, sf) -> DataFrame:
    """The index without volume; no close on the 13th."""
    gap = F.dayofmonth("date") == 13
    return index_raw(spark, sf).select("date", "open", "high", "low", F.when(~gap, F.col("close")).alias("close"))


# ---- the same in SQL --------------------------------------------------------------------------

_MARGIN_SQL = """
SELECT date, bought::DOUBLE * {unit} AS margin_buy_amount, long_bal::DOUBLE * {unit} AS margin_balance,
       sold::DOUBLE AS short_sell_volume, short_bal::DOUBLE * {unit} AS short_balance,
       (long_bal + short_bal)::DOUBLE * {unit} AS total_margin_balance
FROM (SELECT date, bought, sold,
             sum(bought) OVER (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS long_bal,
             sum(short_amount) OVER (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS short_bal
      FROM (SELECT o_orderdate::DATE AS date, sum(o_totalprice::DECIMAL(18,2)) AS bought,
                   count(*) FILTER (WHERE o_orderstatus = 'F') AS sold,
                   sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice::DECIMAL(18,2) ELSE 0 END) AS short_amount
            FROM orders WHERE o_custkey % 2 = {parity} GROUP BY 1))
"""

_CHANNEL_SQL = """
SELECT date, net_buy::DOUBLE * {unit} AS net_buy, fund_inflow::DOUBLE * {unit} AS fund_inflow,
       (sum(net_buy) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING))::DOUBLE * {unit} AS cum_net_buy
FROM (SELECT l_shipdate::DATE AS date,
             sum(CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * l_extendedprice::DECIMAL(18,2)) AS net_buy,
             sum(l_extendedprice::DECIMAL(18,2)) AS fund_inflow
      FROM lineitem WHERE l_linestatus = '{status}' GROUP BY 1)
"""

U = f"{UNIT!r}::DOUBLE"

VIEW_SQL = {
    "bars": f"""
SELECT lpad(l_suppkey::VARCHAR, 6, '0') AS ts_code, l_shipdate::DATE AS date,
       arg_min(p * (1 + (d - t) / 2), k) AS open, max(p * (1 + d)) AS high, min(p * (1 - t)) AS low,
       arg_max(p, k) AS close, sum(l_quantity) AS volume,
       sum(l_extendedprice::DECIMAL(18,2))::DOUBLE * {U} AS amount
FROM (SELECT *, row(l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, d, t) AS k
      FROM (SELECT *, l_extendedprice / l_quantity * {U} AS p, l_discount + 0.0 AS d, l_tax + 0.0 AS t FROM lineitem))
GROUP BY 1, 2
""",
    "statement_sums": """
SELECT l_suppkey, date_trunc('quarter', l_shipdate)::DATE AS qs, sum(price) AS gross, sum(price * (1 - disc)) AS rev,
       sum(price * (1 - disc) * (1 - tax)) AS net, sum(price * tax) AS taxes,
       sum(CASE WHEN l_returnflag = 'R' THEN price * (1 - disc) ELSE 0 END) AS returned
FROM (SELECT *, l_extendedprice::DECIMAL(12,2) AS price, l_discount::DECIMAL(4,2) AS disc, l_tax::DECIMAL(4,2) AS tax
      FROM lineitem)
GROUP BY 1, 2
""",
    "statement_base": f"""
SELECT lpad(l_suppkey::VARCHAR, 6, '0') AS ts_code, s_name AS name, (qs + INTERVAL 3 MONTH)::DATE - 1 + 30 AS notice_date,
       (qs + INTERVAL 3 MONTH)::DATE - 1 AS report_period, rev AS total_revenue, gross * 0.7::DOUBLE AS operate_cost,
       gross * 0.7::DOUBLE + taxes AS total_cost, net - gross * 0.7::DOUBLE AS net_profit,
       rev - gross * 0.7::DOUBLE AS operate_profit, rev - gross * 0.7::DOUBLE - taxes AS total_profit,
       taxes - gross * 0.04::DOUBLE AS finance_expense, s_acctbal * 1000 + cum AS total_equity,
       gross * 0.4::DOUBLE + abs(s_acctbal) * 10 AS total_debt, s_acctbal * 10 AS cash,
       rev * 0.1::DOUBLE AS accounts_receivable, gross * 0.2::DOUBLE AS inventory,
       gross * 0.15::DOUBLE AS accounts_payable, s_acctbal * 20 AS advance_receivable,
       rev - returned - gross * 0.7::DOUBLE AS cfo, returned * -0.5::DOUBLE AS cfi
FROM (SELECT l_suppkey, qs, gross::DOUBLE * {U} AS gross, rev::DOUBLE * {U} AS rev, net::DOUBLE * {U} AS net,
             taxes::DOUBLE * {U} AS taxes, returned::DOUBLE * {U} AS returned,
             (sum(net * 10 - gross * 7) OVER (PARTITION BY l_suppkey ORDER BY qs ROWS UNBOUNDED PRECEDING))::DOUBLE * {U} / 10
               AS cum
      FROM statement_sums)
JOIN supplier ON s_suppkey = l_suppkey
""",
    "statements": """
SELECT *, cfo + cfi AS net_cashflow,
       (total_revenue / lag(total_revenue, 4) OVER w - 1) * 100 AS total_revenue_yoy,
       (net_profit / lag(net_profit, 4) OVER w - 1) * 100 AS net_profit_yoy,
       (total_asset / lag(total_asset, 4) OVER w - 1) * 100 AS total_asset_yoy,
       (total_debt / lag(total_debt, 4) OVER w - 1) * 100 AS total_debt_yoy
FROM (SELECT *, total_equity + total_debt AS total_asset FROM statement_base)
WINDOW w AS (PARTITION BY ts_code ORDER BY report_period)
""",
    "l1": "SELECT printf('80%d000', r_regionkey) AS sw_l1_code, r_name AS sw_l1_name FROM region",
    "l2": """
SELECT printf('81%02d00', n_nationkey) AS sw_l2_code, n_name AS sw_l2_name,
       CASE WHEN n_name = 'NATION_24' THEN 'NOWHERE' ELSE r_name END AS sw_l1_name
FROM nation JOIN region ON n_regionkey = r_regionkey
""",
    "l3": """
SELECT printf('82%02d%02d', n_nationkey, m) AS sw_l3_code, n_name || '-' || m AS sw_l3_name, n_name AS sw_l2_name
FROM (SELECT n_nationkey, n_name, unnest([0, 1, 2]) AS m FROM nation)
""",
    "levels": """
SELECT l3.sw_l3_code, l2.sw_l2_code, l2.sw_l2_name, coalesce(l1.sw_l1_code, l2.sw_l1_name) AS sw_l1_code,
       coalesce(l1.sw_l1_name, l2.sw_l1_name) AS sw_l1_name, l1.sw_l1_code IS NULL AS is_unmapped
FROM l3 JOIN l2 USING (sw_l2_name) LEFT JOIN l1 USING (sw_l1_name)
""",
    "members": """
SELECT lpad(s_suppkey::VARCHAR, 6, '0') || '.SZ' AS ts_code_suffix, s_name AS name,
       (DATE '1995-01-01' + floor(abs(s_acctbal) / 6)::INT + step * 700) AS join_date,
       printf('82%02d%02d', (s_nationkey + step) % 25, s_suppkey % 3) AS sw_l3_code,
       'NATION_' || ((s_nationkey + step) % 25) || '-' || (s_suppkey % 3) AS sw_l3_name
FROM (SELECT *, unnest(CASE WHEN s_acctbal < 0 THEN [0, 1] ELSE [0] END) AS step FROM supplier)
""",
    "classification": """
SELECT left(ts_code_suffix, 6) AS ts_code, name, join_date, sw_l3_code, sw_l3_name, sw_l2_code, sw_l2_name,
       sw_l1_code, sw_l1_name
FROM members JOIN levels USING (sw_l3_code)
""",
    "industry": """
SELECT ts_code, sw_l1_code, sw_l1_name
FROM (SELECT *, row_number() OVER (PARTITION BY ts_code ORDER BY join_date DESC) AS rn FROM classification)
WHERE rn = 1
""",
    "channel_f": _CHANNEL_SQL.format(status="F", unit=U),
    "channel_o": _CHANNEL_SQL.format(status="O", unit=U),
    "northbound": """
SELECT date, sum(net_buy) AS net_buy, sum(fund_inflow) AS fund_inflow, sum(cum_net_buy) AS cum_net_buy
FROM (SELECT * FROM channel_f UNION ALL SELECT * FROM channel_o) GROUP BY date
""",
    "margin_0": _MARGIN_SQL.format(parity=0, unit=U),
    "margin_1": _MARGIN_SQL.format(parity=1, unit=U),
    "margin": """
SELECT date, sum(margin_buy_amount) AS margin_buy_amount, sum(margin_balance) AS margin_balance,
       sum(short_sell_volume) AS short_sell_volume, sum(short_balance) AS short_balance,
       sum(total_margin_balance) AS total_margin_balance
FROM (SELECT * FROM margin_0 UNION ALL SELECT * FROM margin_1) GROUP BY date
""",
    "shibor": """
SELECT o_orderdate::DATE AS date, """
    + ", ".join(
        f"""sum(CASE WHEN o_orderpriority = '{p}' THEN o_totalprice::DECIMAL(18,2) END)::DOUBLE
       / nullif(count(*) FILTER (WHERE o_orderpriority = '{p}'), 0) * {U} / 100000 AS "{t}_rate\""""
        for t, p in TENOR_PRIORITY.items()
    )
    + " FROM orders GROUP BY 1",
    "index_bars": """
SELECT date, arg_min(open, ts_code) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts_code) AS close,
       sum(volume) AS volume FROM bars GROUP BY date
""",
    "qvix_bars": "SELECT date, open, high, low, close FROM index_bars WHERE day(date) <> 13",
}

VIEW_DEPENDS = {
    "statement_base": ("statement_sums",),
    "statements": ("statement_base",),
    "levels": ("l1", "l2", "l3"),
    "classification": ("members", "levels"),
    "industry": ("classification",),
    "northbound": ("channel_f", "channel_o"),
    "margin": ("margin_0", "margin_1"),
    "index_bars": ("bars",),
    "qvix_bars": ("index_bars",),
}
