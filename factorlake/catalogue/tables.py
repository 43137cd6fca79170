"""Tables at rest, unions, profiles and key joins."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import functions as F

from ..operators import behavioral
from ..operators import relational as R
from ..operators.joins import join_dates, join_keys
from ..operators.skew import shared_dir
from ..operators.staged import FeatureGroup
from ..sources import tables as T
from ..sources.incremental import GrowingFeatures
from . import views as V
from .market import ALL_STAGES
from .registry import nums, query, roll_sql, views

BARS = views("bars")
START, END = date(1996, 3, 1), date(1998, 2, 28)
PRICES = ["open", "high", "low", "close", "volume", "amount"]
BARS_SQL = f"{BARS} SELECT ts_code, date, {nums(PRICES)} FROM bars"


def scratch(spark, name: str) -> str:
    """A new folder under the cluster's shared checkpoint folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored_bars(spark, sf) -> str:
    """Bars written as a table partitioned by year; returns its path."""
    path = scratch(spark, "bars")
    T.write_table(V.bars(spark, sf).withColumn("year", F.year("date")), path, ["year"])
    return path


# ---- write and read ---------------------------------------------------------------------------

query("table_write", BARS_SQL)(lambda spark, sf: T.read_table(spark, stored_bars(spark, sf)).drop("year"))


@query(
    "table_read",
    BARS_SQL + f" WHERE year(date) = 1996 UNION ALL SELECT NULL, NULL, {', '.join(['NULL'] * len(PRICES))} WHERE false",
)
def table_read(spark, sf):
    """One book of a stored table, plus a table that does not exist and counts as empty."""
    found = T.read_books(spark, stored_bars(spark, sf), [1996], "year").drop("year")
    return found.unionByName(T.read_table(spark, scratch(spark, "absent"), found.schema))


@query(
    "refresh_partition",
    f"{BARS} SELECT ts_code, date, {nums({'close': 'CASE WHEN year(date) = 1997 THEN close * 2 ELSE close END'})} FROM bars",
)
def refresh(spark, sf):
    """Recompute the 1997 book only; the other books stay."""
    path = stored_bars(spark, sf)
    fresh = V.bars(spark, sf).withColumn("year", F.year("date")).where("year = 1997")
    T.refresh_partition(fresh.withColumn("close", F.col("close") * 2), path, ["year"])
    return T.read_table(spark, path).select("ts_code", "date", "close")


@query("table_read_codes", BARS_SQL + " WHERE ts_code IN ('000003', '000008')")
def codes_read(spark, sf):
    """Two codes of a table whose files are clustered by code."""
    path = scratch(spark, "clustered")
    T.write_clustered(V.bars(spark, sf), path, "ts_code", "date", row_group_bytes=1 << 16)
    return T.read_table(spark, path).where(F.col("ts_code").isin("000003", "000008"))


_CUTS = (date(1996, 12, 31), date(1998, 2, 14), date(1998, 2, 16))


@query(
    "refresh_appended",
    f"""{BARS}, {ALL_STAGES.format(src='bars')}, v AS (SELECT ts_code, date, sum(volume) OVER (PARTITION BY ts_code ORDER BY date) AS traded FROM bars)
    SELECT t3.ts_code, t3.date, {nums({'ret_1q': 'ret_1q', 'roc_4': 'roc_4', 'vola_20': 'vola_20', 'traded': 'traded'}, 5)}
    FROM t3 JOIN v ON v.ts_code = t3.ts_code AND v.date = t3.date""",
    digits=5,
)
def appended(spark, sf):
    """Features of bars that come in four lots; each lot recomputes what it reaches, a running total goes on."""
    bars = V.bars(spark, sf).drop("amount")  # no metric reads it
    traded = FeatureGroup(("traded",), (lambda w: {},), ("volume",), back=0, ahead=0, running={"traded": F.col("volume")})
    groups = [behavioral.GROUPS[g](bars.columns) for g in ("momentum", "volatility")]
    table = GrowingFeatures(spark, scratch(spark, "growing"), [*groups, traded])
    for since, until in zip((date(1900, 1, 1), *_CUTS), (*_CUTS, date(2100, 1, 1))):
        table.append(bars.where((F.col("date") > F.lit(since)) & (F.col("date") <= F.lit(until))))
    return table.read().select("ts_code", "date", "ret_1q", "roc_4", "vola_20", "traded")


@query(
    "read_through",
    f"""{BARS} SELECT ts_code, date, {nums({'close': 'CASE WHEN year(date) = 1995 THEN close + 1000 ELSE close END'})} FROM bars
    WHERE year(date) IN (1995, 1996, 1997)""",
)
def through(spark, sf):
    """Two books are stored, marked by a shifted price; one of them is stale, and a third is missing."""
    bars = V.bars(spark, sf).select("ts_code", "date", "close", F.concat(F.lit("y"), F.year("date")).alias("book"))
    path = scratch(spark, "books")
    old = bars.where("book in ('y1995', 'y1996')").withColumn("close", F.col("close") + 1000)
    T.write_table(old, path, ["book"])

    def compute(books):
        assert books == ["y1996", "y1997"], books
        return bars.where(F.col("book").isin(books))

    return T.read_through(spark, path, ["y1995", "y1996", "y1997"], compute, stale=["y1996"]).drop("book")


@query(
    "missing_books",
    f"""{views('statements')} SELECT DISTINCT year(d) || '_Q' || quarter(d) AS book
    FROM (SELECT o_orderdate::DATE AS d FROM orders) WHERE year(d) || '_Q' || quarter(d) NOT IN
    (SELECT year(notice_date) || '_Q' || quarter(notice_date) FROM statements)""",
)
def missing(spark, sf):
    """Quarters with orders in which no report was published."""
    from ..functions.dates import quarter_key

    wanted = V.table(spark, sf, "orders").select(quarter_key(F.col("o_orderdate").cast("date")).alias("book"))
    return T.missing_books(wanted, V.statements(spark, sf).select(quarter_key("notice_date").alias("book")))


@query(
    "cached_dim",
    f"{views('levels')} SELECT * FROM levels",
)
def cached(spark, sf):
    """Built on the first call, read back on the second; a cache lacking columns is rebuilt."""
    from .crosssection import levels

    path = scratch(spark, "levels")
    required = ["sw_l3_code", "sw_l2_code", "sw_l1_code"]
    T.write_table(V.table(spark, sf, "region"), path)
    T.cached_dim(spark, path, required, lambda: levels(spark, sf))

    def unexpected():
        raise AssertionError("a valid cache was rebuilt")

    return T.cached_dim(spark, path, required, unexpected)


@query(
    "market_stack_read",
    f"""{BARS} SELECT ts_code, date, {nums({'close': 'close', 'amount': "CASE WHEN year(date) < 1998 THEN amount END",
    'volume': "CASE WHEN year(date) >= 1998 THEN volume END"})} FROM bars""",
)
def stack_read(spark, sf):
    """Tickers stored in two lots, of which the older one holds amounts and the newer one volumes."""
    path, bars = scratch(spark, "tickers"), V.bars(spark, sf)
    T.write_tickers(bars.where(F.year("date") < 1998).select("ts_code", "date", "close", "amount"), path)
    T.write_tickers(bars.where(F.year("date") >= 1998).select("ts_code", "date", "close", "volume"), path)
    return T.market_stack_read(spark, path)


@query(
    "market_stack_some",
    f"{BARS} SELECT ts_code, date, {nums(['close'])} FROM bars WHERE right(ts_code, 1) IN ('3', '8')",
)
def stack_some(spark, sf):
    """Only the tickers asked for, of those stored."""
    path, bars = scratch(spark, "tickers"), V.bars(spark, sf).select("ts_code", "date", "close")
    T.write_tickers(bars, path)
    asked = V.table(spark, sf, "supplier").select(V._code("s_suppkey").alias("ts_code")).where("right(ts_code, 1) IN ('3', '8')")
    return T.market_stack_read(spark, path, asked, bars.schema)


@query(
    "market_stack_frames",
    f"""{BARS} SELECT ts_code, date, {nums({'close': 'close', 'amount': "CASE WHEN year(date) < 1998 THEN amount END",
    'volume': "CASE WHEN year(date) >= 1998 THEN volume END"})} FROM bars""",
)
def stack_frames(spark, sf):
    bars = V.bars(spark, sf)
    old = bars.where(F.year("date") < 1998).select("ts_code", "date", "close", "amount")
    new = bars.where(F.year("date") >= 1998).select("ts_code", "date", "close", "volume")
    return T.market_stack([old, new])


@query(
    "market_range_read",
    BARS_SQL + f" WHERE date BETWEEN DATE '{START}' AND DATE '{END}'",
)
def market_range(spark, sf):
    return T.range_read(T.read_table(spark, stored_bars(spark, sf)), START, END).drop("year")


@query(
    "fundamental_range_read",
    f"""{views('statements')} SELECT ts_code, notice_date, {nums(['net_profit'], 4)} FROM statements
    WHERE date_trunc('quarter', notice_date) BETWEEN date_trunc('quarter', DATE '{START}') AND date_trunc('quarter', DATE '{END}')""",
    digits=4,
)
def fundamental_range(spark, sf):
    from ..functions.dates import quarter_key

    path = scratch(spark, "fundamental")
    T.write_table(V.statements(spark, sf).withColumn("book", quarter_key("notice_date")), path, ["book"])
    return T.fundamental_range_read(T.read_table(spark, path), START, END).select("ts_code", "notice_date", "net_profit")


@query("write_predictions", BARS_SQL.replace(nums(PRICES), nums(["close"])) + f" WHERE date BETWEEN DATE '{START}' AND DATE '{END}'")
def predictions(spark, sf):
    path = scratch(spark, "predictions")
    T.write_predictions(V.bars(spark, sf).select("ts_code", "date", "close"), path, START, END)
    return spark.read.parquet(path)


# ---- joins on keys ----------------------------------------------------------------------------


@query(
    "join_multi_key",
    f"""{views('statements')} SELECT a.ts_code, a.name, a.notice_date, {nums({'net_profit': 'a.net_profit', 'cfo': 'b.cfo'}, 4)}
    FROM statements a JOIN statements b ON a.ts_code = b.ts_code AND a.name = b.name AND a.notice_date = b.notice_date
    WHERE a.total_equity > 0 AND b.cfo > 0""",
    digits=4,
)
def multi_key(spark, sf):
    """Inner join on three keys; keys made null on one side match nothing."""
    keys = ["ts_code", "name", "notice_date"]
    a = V.income(spark, sf).join(V.balance(spark, sf).select(*keys, "total_equity"), keys)
    a = a.withColumn("name", F.when(F.col("total_equity") > 0, F.col("name"))).select(*keys, "net_profit")
    b = V.cashflow(spark, sf).withColumn("name", F.when(F.col("cfo") > 0, F.col("name"))).select(*keys, "cfo")
    return join_keys(a, b, keys)


@query(
    "join_date_inner",
    f"""{views('northbound', 'margin')} SELECT date, {nums(['net_buy', 'total_margin_balance'], 2)}
    FROM northbound JOIN margin USING (date)""",
    digits=2,
)
def date_inner(spark, sf):
    from .macro import margin, northbound

    return join_dates(
        [northbound(spark, sf).select("date", "net_buy"), margin(spark, sf).select("date", "total_margin_balance")]
    )


@query(
    "join_idents_left",
    f"""{BARS} SELECT ts_code, date, s_name AS name, {nums({'ma_4': 'round(' + roll_sql('avg', 'close', 4, 2) + ', 3)'})}
    FROM bars JOIN supplier ON lpad(s_suppkey::VARCHAR, 6, '0') = ts_code""",
)
def idents(spark, sf):
    """Identifying columns ride along with the features; nothing is joined back."""
    names = V.table(spark, sf, "supplier").select(V._code("s_suppkey").alias("ts_code"), F.col("s_name").alias("name"))
    out = behavioral.features(V.bars(spark, sf).join(names, "ts_code"), ["momentum"])
    return out.select("ts_code", "date", "name", F.round("ma_4", 3).alias("ma_4"))


# ---- aggregates, duplicates, unions -----------------------------------------------------------


@query(
    "agg_sum_by_date",
    f"""{BARS} SELECT date, sum(volume) AS volume, coalesce(sum(CASE WHEN day(date) <> 1 THEN volume END), 0) AS gapped
    FROM bars GROUP BY date""",
)
def sum_by_date(spark, sf):
    gapped = F.when(F.dayofmonth("date") != 1, F.col("volume"))
    return R.sum_by(V.bars(spark, sf).select("date", "volume", gapped.alias("gapped")), "date")


@query(
    "dedupe_last",
    """SELECT o_custkey, last_order, price, priority FROM (SELECT o_custkey, o_orderkey AS last_order, o_totalprice AS price,
    o_orderpriority AS priority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
    FROM orders) WHERE rn = 1""",
)
def last_order(spark, sf):
    o = V.table(spark, sf, "orders").select(
        "o_custkey",
        F.col("o_orderkey").alias("last_order"),
        F.col("o_totalprice").alias("price"),
        F.col("o_orderpriority").alias("priority"),
        "o_orderdate",
    )
    return R.dedupe_last(o, ["o_custkey"], ["o_orderdate", "last_order"]).drop("o_orderdate")


@query("dedupe_any", "SELECT DISTINCT l_suppkey, l_returnflag, l_linestatus FROM lineitem")
def distinct_rows(spark, sf):
    return R.dedupe_any(V.table(spark, sf, "lineitem").select("l_suppkey", "l_returnflag", "l_linestatus"))


YOY = ["net_profit", "net_profit_yoy", "total_revenue_yoy", "total_equity"]


@query(
    "null_profile",
    views("statements")
    + " "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS non_null, count(*) - count({c}) AS "null",
        {nums({'non_null_ratio': f'count({c}) / count(*)', 'null_ratio': f'1 - count({c}) / count(*)'})} FROM statements"""
        for c in YOY
    ),
)
def profile(spark, sf):
    return R.null_profile(V.statements(spark, sf).select(*YOY))


@query(
    "coverage_stats",
    f"""{views('bars', 'industry')} SELECT count(*) AS rows, count(DISTINCT ts_code) AS codes, min(date) AS first_date,
    max(date) AS last_date FROM bars""",
)
def coverage(spark, sf):
    return R.coverage_stats(V.bars(spark, sf))


@query(
    "join_retention",
    f"""{BARS}, k AS (SELECT count(*) AS n FROM bars JOIN supplier ON lpad(s_suppkey::VARCHAR, 6, '0') = ts_code WHERE s_acctbal > 0)
    SELECT (SELECT count(*) FROM bars) AS rows_before, n AS rows_after,
    {nums({'retained_pct': '100.0::DOUBLE * n / (SELECT count(*) FROM bars)'})} FROM k""",
)
def retention(spark, sf):
    bars = V.bars(spark, sf)
    good = V.table(spark, sf, "supplier").where("s_acctbal > 0").select(V._code("s_suppkey").alias("ts_code"))
    return R.join_retention(bars, bars.join(good, "ts_code", "left_semi"))


@query("any_flag", f"{BARS} SELECT bool_or(volume >= 150) AS \"any\" FROM bars")
def any_row(spark, sf):
    return R.any_flag(V.bars(spark, sf), F.col("volume") >= 150)


@query(
    "union_vertical",
    f"""{views('northbound')} SELECT date, {nums(['net_buy', 'fund_inflow', 'cum_net_buy'], 2)}
    FROM (SELECT * FROM channel_f UNION ALL SELECT * FROM channel_o)""",
    digits=2,
)
def union_vertical(spark, sf):
    return R.union_vertical(V.channel(spark, sf, "F"), V.channel(spark, sf, "O"))


@query(
    "union_relaxed",
    """SELECT l_orderkey AS k, l_linenumber::DOUBLE AS v FROM lineitem UNION ALL
    SELECT o_orderkey, round(o_totalprice, 6) FROM orders""",
)
def union_relaxed(spark, sf):
    """Integer and double columns widen to double."""
    a = V.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("v"))
    b = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    return R.union_relaxed(a, b)


@query(
    "union_diagonal",
    """SELECT l_orderkey AS k, l_linenumber AS line, NULL AS status FROM lineitem UNION ALL
    SELECT o_orderkey, NULL, o_orderstatus FROM orders""",
)
def union_diagonal(spark, sf):
    a = V.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"))
    b = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"))
    return R.union_diagonal(a, b)


@query("sort", f"{BARS} SELECT ts_code, date, {nums(['volume'])} FROM bars ORDER BY date ASC, volume DESC, ts_code")
def ordered(spark, sf):
    return V.bars(spark, sf).select("ts_code", "date", "volume").orderBy(F.asc("date"), F.desc("volume"), "ts_code")
