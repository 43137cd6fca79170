"""Ingestion and scalar functions over raw text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codes, columns as C, dates as D
from ..operators.relational import ensure_columns, reorder, valid_filter, weekly_sample
from ..operators.staged import FeatureGroup, staged_metrics
from ..sources.ingest import apply_spec, bars_clean, parse_kline, quarter_report, read_rows
from ..sources.specs import INDEX_MEMBERS, KLINE, QUARTER_IDENTS, QUARTER_REPORTS
from ..operators import behavioral
from . import views as V
from .registry import any_sql, clip_sql, flag_sql, mean_sql, nums, query, safe_div_sql, views
from .tables import scratch

BARS = views("bars")

# ---- bars as landed ---------------------------------------------------------------------------

# Bar fields as landed text: four decimals; the derived fields are left to simple formulas.
KLINE_EXPR = {
    "open": "open", "close": "close", "high": "high", "low": "low", "volume": "volume", "amount": "amount",
    "amplitude": "high - low", "change_pct": "close / open", "change_amt": "close - open", "turnover": "volume / 100",
}


def _text(expr: str):
    return F.round(F.expr(expr), 4).cast("decimal(24,4)").cast("string")


def kline_pages(spark, sf):
    """Responses of one ticker and month, with a line too short, a line too long, and empty responses."""
    line = F.concat_ws(",", F.date_format("date", "yyyy-MM-dd"), *[_text(e) for e in KLINE_EXPR.values()])
    lines = V.bars(spark, sf).select("ts_code", "date", line.alias("line"))
    # At most 31 bars per response. The other variants of a line are made where its response is, not shuffled.
    pages = lines.groupBy("ts_code", F.trunc("date", "month").alias("m")).agg(F.collect_list("line").alias("lines"))
    variants = F.transform("lines", lambda x: F.array(x, F.regexp_replace(x, r",[^,]*$", ""), F.concat(x, F.lit(",0"))))
    pages = pages.select("ts_code", F.flatten(variants).alias("klines"))
    full = F.to_json(F.struct(F.struct("klines").alias("data")))
    bodies = F.array(full, F.lit('{"data": null}'), F.lit("{}"), F.lit('{"data": {"klines": []}}'))
    return pages.select(F.col("ts_code").alias("symbol"), F.explode(bodies).alias("body"))


@query(
    "ingest_kline",
    f"{BARS} SELECT ts_code, date, {nums({n: f'round({e}, 4)' for n, e in KLINE_EXPR.items()}, 4)} FROM bars",
    digits=4,
)
def ingest_kline(spark, sf):
    return parse_kline(kline_pages(spark, sf))


STRING_FIELDS = ["date", "code", "open", "high", "low", "close", "volume", "turn", "tradestatus", "isST"]


def string_bars(spark, sf):
    """All-text bars: no close on Mondays; a ticker that ever trades 150 or more in a day is flagged then."""
    close = F.when(F.weekday("date") == 0, F.lit("")).otherwise(_text("close"))
    return V.bars(spark, sf).select(
        F.date_format("date", "yyyy-MM-dd").alias("date"),
        F.concat(F.lit("sz."), "ts_code").alias("code"),
        *[_text(c).alias(c) for c in ("open", "high", "low")],
        close.alias("close"),
        _text("volume").alias("volume"),
        _text("volume / 100").alias("turn"),
        F.lit("1").alias("tradestatus"),
        F.when(F.col("volume") >= 150, "1").otherwise("0").alias("isST"),
    )


@query(
    "bars_clean",
    f"""{BARS} SELECT ts_code, date, {nums({c: f'round({c}, 4)' for c in ('open', 'high', 'low', 'volume')} |
    {'close': 'CASE WHEN isodow(date) <> 1 THEN round(close, 4) END', 'turnover': 'round(volume / 100, 4)'}, 4)} FROM bars
    WHERE ts_code NOT IN (SELECT ts_code FROM bars WHERE volume >= 150)""",
    digits=4,
)
def clean(spark, sf):
    return bars_clean(string_bars(spark, sf))


@query(
    "ingest_rows",
    f"""{BARS} SELECT strftime(date, '%Y-%m-%d') AS date, 'sz.' || ts_code AS code,
    {', '.join(f"round({c}, 4)::DECIMAL(24,4)::VARCHAR AS {c}" for c in ('open', 'high', 'low'))},
    CASE WHEN isodow(date) = 1 THEN '' ELSE round(close, 4)::DECIMAL(24,4)::VARCHAR END AS close,
    round(volume, 4)::DECIMAL(24,4)::VARCHAR AS volume, round(volume / 100, 4)::DECIMAL(24,4)::VARCHAR AS turn,
    '1' AS tradestatus, CASE WHEN volume >= 150 THEN '1' ELSE '0' END AS "isST" FROM bars""",
)
def ingest_rows(spark, sf):
    path = scratch(spark, "rows")
    string_bars(spark, sf).write.csv(path, header=True)
    return read_rows(spark, path, STRING_FIELDS)


@query(
    "ingest_index_members",
    """SELECT DATE '1996-01-31' AS date, lpad(s_suppkey::VARCHAR, 6, '0') AS ts_code, s_name AS name FROM supplier""",
)
def index_members(spark, sf):
    sheet = V.table(spark, sf, "supplier").select(
        F.lit("19960131").alias("日期Date"),
        V._code("s_suppkey").alias("成份券代码Constituent Code"),
        F.col("s_name").alias("成份券名称Constituent Name"),
        F.lit("x").alias("other"),
    )
    path = scratch(spark, "members")
    sheet.write.csv(path, header=True)
    return apply_spec(read_rows(spark, path, sheet.columns), INDEX_MEMBERS, "yyyyMMdd")


@query(
    "column_spec",
    f"""{BARS} SELECT ts_code, date, {nums({'open': 'round(open, 4)', 'close': 'CASE WHEN isodow(date) <> 1 THEN round(close, 4) END'}, 4)}
    FROM bars""",
    digits=4,
)
def column_spec(spark, sf):
    """Doubled rows, an unparseable number, and most specified columns absent."""
    raw = string_bars(spark, sf).select(
        "date", F.substring("code", 4, 20).alias("ts_code"), "open", F.concat("close", F.lit("")).alias("close")
    )
    return apply_spec(raw.unionAll(raw), KLINE)


@query(
    "quarter_report_specs",
    views("statements")
    + " "
    + " UNION ALL ".join(
        f"SELECT '{k}' AS report, ts_code, notice_date, report_period AS date, "
        + " || ',' || ".join(
            f"'{target}=' || (round(total_revenue, 2)::DECIMAL(24,2) + {i})::VARCHAR" for i, target in enumerate(f.values())
        )
        + " AS measures FROM statements"
        for k, f in QUARTER_REPORTS.items()
    ),
)
def quarter_reports(spark, sf):
    """Six report layouts with a figure of its own in each of their fields."""
    base = V.statements(spark, sf).select(
        F.concat(F.lit("sh."), "ts_code").alias("code"),
        F.date_format("notice_date", "yyyy-MM-dd").alias("pubDate"),
        F.date_format("report_period", "yyyy-MM-dd").alias("statDate"),
        F.round("total_revenue", 2).cast("decimal(24,2)").alias("v"),
    )
    out = None
    for kind, fields in QUARTER_REPORTS.items():
        values = [(F.col("v") + i).cast("decimal(24,2)").cast("string").alias(f) for i, f in enumerate(fields)]
        raw = base.select(*QUARTER_IDENTS, *values)
        rep = quarter_report(raw, kind)
        names = list(fields.values())
        rep = rep.select(
            F.lit(kind).alias("report"),
            "ts_code",
            "notice_date",
            "date",
            F.concat_ws(",", *[F.concat(F.lit(f"{n}="), F.col(n)) for n in names]).alias("measures"),
        )
        out = rep if out is None else out.unionByName(rep)
    return out


# ---- codes ------------------------------------------------------------------------------------

# Every shape a code comes in, chosen by the size of the part.
RAW_CODE_SQL = """SELECT p_partkey, CASE WHEN p_size <= 7 THEN 'sh' || (600000 + p_partkey)
    WHEN p_size <= 14 THEN (300000 + p_partkey) || '.SZ' WHEN p_size <= 21 THEN p_partkey::VARCHAR
    WHEN p_size <= 28 THEN '12' || (430000 + p_partkey) WHEN p_size <= 35 THEN 'abc' WHEN p_size <= 42 THEN NULL
    ELSE 'bj' || (830000 + p_partkey) || 'x9' END AS code FROM part"""


def raw_codes(spark, sf):
    k, size = F.col("p_partkey"), F.col("p_size")
    code = (
        F.when(size <= 7, F.concat(F.lit("sh"), 600000 + k))
        .when(size <= 14, F.concat(300000 + k, F.lit(".SZ")))
        .when(size <= 21, k.cast("string"))
        .when(size <= 28, F.concat(F.lit("12"), 430000 + k))
        .when(size <= 35, F.lit("abc"))
        .when(size <= 42, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("bj"), 830000 + k, F.lit("x9")))
    )
    return V.table(spark, sf, "part").select("p_partkey", code.alias("code"))


_EXCH = """CASE left(d, 1) WHEN '6' THEN 'SH' WHEN '0' THEN 'SZ' WHEN '3' THEN 'SZ' WHEN '4' THEN 'BJ' WHEN '8' THEN 'BJ'
    ELSE 'UNKNOWN' END"""


def _digits_sql(expr: str) -> str:
    return f"CASE WHEN {expr} = '' THEN NULL ELSE right(repeat('0', 6) || {expr}, 6) END"


@query(
    "normalize_ts_code",
    f"""WITH r AS ({RAW_CODE_SQL}), n AS (SELECT *, {_digits_sql("regexp_extract(code, '([0-9]+)', 1)")} AS d FROM r)
    SELECT p_partkey, d AS digits, d || '.' || {_EXCH} AS suffixed, lower({_EXCH}) || d AS prefixed, d || '_SH' AS given
    FROM n""",
)
def ts_code(spark, sf):
    n = codes.normalize_ts_code
    return raw_codes(spark, sf).select(
        "p_partkey",
        n("code").alias("digits"),
        n("code", add_exchange=True).alias("suffixed"),
        n("code", add_exchange=True, position="prefix", sep="", case="lower").alias("prefixed"),
        n("code", add_exchange=True, exchange="SH", sep="_").alias("given"),
    )


@query(
    "normalize_ts_code_all_digits",
    f"""WITH r AS ({RAW_CODE_SQL}), n AS (SELECT *, {_digits_sql("regexp_replace(code, '[^0-9]', '', 'g')")} AS d FROM r)
    SELECT p_partkey, d AS digits, d || '.' || {_EXCH} AS suffixed, {_EXCH} || '' || d AS prefixed FROM n""",
)
def ts_code_all(spark, sf):
    n = codes.normalize_ts_code_all_digits
    return raw_codes(spark, sf).select(
        "p_partkey",
        n("code").alias("digits"),
        n("code", add_exchange=True).alias("suffixed"),
        n("code", add_exchange=True, position="prefix", sep="").alias("prefixed"),
    )


@query(
    "suffix_ts_code",
    f"""WITH r AS ({RAW_CODE_SQL}), d AS (SELECT *, regexp_matches(code, '^[0-9]{{6}}$') AS plain, code AS d FROM r)
    SELECT p_partkey, CASE WHEN instr(code, '.') = 7 THEN upper(code) WHEN NOT plain THEN NULL
    WHEN ({_EXCH}) = 'UNKNOWN' THEN code ELSE code || '.' || {_EXCH} END AS suffixed FROM d""",
)
def suffix(spark, sf):
    return raw_codes(spark, sf).select("p_partkey", codes.suffix_ts_code("code").alias("suffixed"))


@query(
    "strip_ts_code",
    f"""WITH r AS ({RAW_CODE_SQL}) SELECT p_partkey, CASE WHEN regexp_matches(code, '^[0-9]{{6}}([.][^.]*)?$')
    THEN left(code, 6) END AS stripped FROM r""",
)
def strip(spark, sf):
    return raw_codes(spark, sf).select("p_partkey", codes.strip_ts_code("code").alias("stripped"))


_NAMES = "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '*ST ' WHEN 1 THEN 'st-' ELSE '' END || p_name AS name FROM part"


@query("st_name_filter", f"SELECT p_partkey, name FROM ({_NAMES}) WHERE NOT contains(upper(name), 'ST')")
def st_names(spark, sf):
    """Half of the names carry the marker, in either case."""
    mark = F.when(F.col("p_partkey") % 4 == 0, "*ST ").when(F.col("p_partkey") % 4 == 1, "st-").otherwise("")
    named = V.table(spark, sf, "part").select("p_partkey", F.concat(mark, "p_name").alias("name"))
    return named.where(codes.not_special_treatment("name"))


# ---- dates ------------------------------------------------------------------------------------

_DAY_FORMATS = {"1-URGENT": "%Y%m%d", "2-HIGH": "%Y-%m-%d", "3-MEDIUM": "%Y/%m/%d", "4-NOT SPECIFIED": "%Y.%m.%d"}
RAW_DATE_SQL = (
    "SELECT o_orderkey, o_orderdate::DATE AS day, CASE o_orderpriority "
    + " ".join(f"WHEN '{p}' THEN strftime(o_orderdate, '{f}')" for p, f in _DAY_FORMATS.items())
    + " ELSE 'n/a' END AS text FROM orders"
)


def raw_dates(spark, sf):
    spark_formats = {"%Y%m%d": "yyyyMMdd", "%Y-%m-%d": "yyyy-MM-dd", "%Y/%m/%d": "yyyy/MM/dd", "%Y.%m.%d": "yyyy.MM.dd"}
    text = F.lit("n/a")
    for prio, fmt in _DAY_FORMATS.items():
        text = F.when(F.col("o_orderpriority") == prio, F.date_format("o_orderdate", spark_formats[fmt])).otherwise(text)
    return V.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"), text.alias("text"))


@query("parse_date", f"SELECT o_orderkey, CASE WHEN text <> 'n/a' THEN day END AS parsed FROM ({RAW_DATE_SQL})")
def parse(spark, sf):
    padded = F.concat(F.lit(" "), "text", F.lit(" "))
    return raw_dates(spark, sf).select("o_orderkey", D.parse_date(padded).alias("parsed"))


@query(
    "format_ymd",
    "SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS compact, strftime(o_orderdate, '%Y-%m-%d') AS dashed FROM orders",
)
def ymd(spark, sf):
    return V.table(spark, sf, "orders").select(
        "o_orderkey", D.format_ymd("o_orderdate").alias("compact"), D.format_ymd("o_orderdate", "-").alias("dashed")
    )


@query(
    "normalize_date_column",
    """SELECT o_orderkey, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderdate::DATE END AS text FROM orders""",
)
def date_column(spark, sf):
    """Four fifths of the rows share one format; the rest do not parse."""
    low = F.col("o_orderpriority") == "5-LOW"
    text = F.when(low, "unknown").otherwise(F.date_format("o_orderdate", "yyyy.MM.dd"))
    return D.normalize_date_column(V.table(spark, sf, "orders").select("o_orderkey", text.alias("text")), "text")


@query(
    "quarter_spine",
    f"""{BARS}, s AS (SELECT ts_code, date_trunc('quarter', min(date)) AS a, date_trunc('quarter', max(date)) AS b FROM bars GROUP BY 1),
    q AS (SELECT ts_code, unnest(generate_series(a, b, INTERVAL 3 MONTH)) AS d FROM s)
    SELECT ts_code, year(d)::INT AS year, quarter(d)::INT AS quarter, year(d) || '_Q' || quarter(d) AS book FROM q""",
)
def spine(spark, sf):
    """Quarters covering each ticker's history."""
    span = V.bars(spark, sf).groupBy("ts_code").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    q = span.select("ts_code", F.explode(D.quarters_between(F.col("a"), F.col("b"))).alias("d"))
    return q.select("ts_code", F.year("d").alias("year"), F.quarter("d").alias("quarter"), D.quarter_key("d").alias("book"))


@query(
    "quarter_keys",
    """WITH d AS (SELECT o_orderkey, o_orderdate::DATE AS d, date_trunc('quarter', o_orderdate)::DATE AS q FROM orders)
    SELECT o_orderkey, year(d) || '_Q' || quarter(d) AS book, q AS parsed, (q + INTERVAL 3 MONTH)::DATE - 1 AS quarter_end,
    (q + INTERVAL 3 MONTH)::DATE AS next_start, (q - INTERVAL 3 MONTH)::DATE AS previous_start,
    (q - INTERVAL 3 MONTH)::DATE AS completed, quarter(d) = 4 AS is_year_end FROM d""",
)
def quarter_keys(spark, sf):
    d = V.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    return d.select(
        "o_orderkey",
        D.quarter_key("d").alias("book"),
        D.quarter_start(D.quarter_key("d")).alias("parsed"),
        D.quarter_end("d").alias("quarter_end"),
        D.next_quarter("d").alias("next_start"),
        D.previous_quarter("d").alias("previous_start"),
        D.completed_quarter("d").alias("completed"),
        D.is_year_end("d").alias("is_year_end"),
    )


@query(
    "book_keys",
    """WITH k AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate::DATE END AS d,
      'csi' || o_custkey AS u FROM orders)
    SELECT o_orderkey, u || coalesce('_' || strftime(d, '%Y-%m-%d'), '') AS key, u AS universe, d AS date,
    replace(u || '_SZ', '_', '.') AS ts_code FROM k""",
)
def book_keys(spark, sf):
    day = F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate").cast("date"))
    universe = F.concat(F.lit("csi"), "o_custkey")
    keyed = V.table(spark, sf, "orders").select(
        "o_orderkey", D.universe_key(universe, day).alias("key"), F.concat(universe, F.lit("_SZ")).alias("ticker")
    )
    u, d = D.split_universe_key("key")
    return keyed.select("o_orderkey", "key", u.alias("universe"), d.alias("date"), D.ticker_to_ts_code("ticker").alias("ts_code"))


# ---- numeric columns --------------------------------------------------------------------------

ST = views("statements")


@query(
    "safe_div",
    f"""{ST} SELECT ts_code, notice_date, {nums({
    'as_null': safe_div_sql('net_profit', 'total_equity'), 'as_abs': safe_div_sql('net_profit', 'total_equity', negative='abs'),
    'kept': 'net_profit / greatest(total_equity, 1000000.0)', 'filled': safe_div_sql('net_profit', 'total_equity', fill='0')}, 5)}
    FROM statements""",
    digits=5,
)
def safe_division(spark, sf):
    d = C.safe_div
    return V.statements(spark, sf).select(
        "ts_code",
        "notice_date",
        d("net_profit", "total_equity").alias("as_null"),
        d("net_profit", "total_equity", negative="abs").alias("as_abs"),
        d("net_profit", "total_equity", negative="keep", min_den=1e6).alias("kept"),
        d("net_profit", "total_equity", fill=0.0).alias("filled"),
    )


@query(
    "safe_ratio",
    f"""{ST} SELECT ts_code, notice_date, {nums({'capped': clip_sql('cfo / greatest(total_revenue, 1e-6)', 0, 0.3),
    'floored': clip_sql('cfo / greatest(total_revenue, 1e-6)', 0)}, 5)} FROM statements""",
    digits=5,
)
def ratio(spark, sf):
    return V.statements(spark, sf).select(
        "ts_code",
        "notice_date",
        C.safe_ratio("cfo", "total_revenue", hi=0.3).alias("capped"),
        C.safe_ratio("cfo", "total_revenue").alias("floored"),
    )


@query(
    "clip",
    f"""{ST} SELECT ts_code, notice_date, {nums({'both': clip_sql('net_profit_yoy', -50, 50), 'low': clip_sql('net_profit_yoy', -50),
    'by_column': clip_sql('cfo', 'cfi', 'net_profit')}, 4)} FROM statements""",
    digits=4,
)
def clipped(spark, sf):
    return V.statements(spark, sf).select(
        "ts_code",
        "notice_date",
        C.clip("net_profit_yoy", -50, 50).alias("both"),
        C.clip("net_profit_yoy", -50).alias("low"),
        C.clip("cfo", F.col("cfi"), F.col("net_profit")).alias("by_column"),
    )


@query(
    "math",
    f"""{ST} SELECT ts_code, notice_date, {nums({'ln_equity': "CASE WHEN total_equity < 0 THEN 'nan'::DOUBLE ELSE ln(total_equity) END",
    'root': 'sqrt(total_debt)', 'square': 'pow(total_revenue / 1e6, 2)', 'magnitude': 'abs(cfo)', 'sign': 'sign(cfo)::DOUBLE'}, 4)}
    FROM statements""",
    digits=4,
)
def maths(spark, sf):
    return V.statements(spark, sf).select(
        "ts_code",
        "notice_date",
        C.log(F.col("total_equity")).alias("ln_equity"),
        F.sqrt("total_debt").alias("root"),
        F.pow(F.col("total_revenue") / 1e6, 2).alias("square"),
        F.abs("cfo").alias("magnitude"),
        F.signum("cfo").alias("sign"),
    )


@query(
    "flags",
    f"""{ST} SELECT ts_code, notice_date, {flag_sql('net_profit_yoy > 0')} AS growing, {flag_sql('total_equity > 0')} AS solvent
    FROM statements""",
)
def flags(spark, sf):
    return V.statements(spark, sf).select(
        "ts_code",
        "notice_date",
        C.flag(F.col("net_profit_yoy") > 0).alias("growing"),
        C.flag(F.col("total_equity") > 0).alias("solvent"),
    )


@query(
    "horizontal_reduce",
    f"""{views('shibor')} SELECT date, {nums({'highest': 'greatest("ON_rate", "1W_rate", "3M_rate")',
    'mean': mean_sql(['"ON_rate"', '"1W_rate"', '"3M_rate"'])})},
    {any_sql(['"ON_rate" > 2', '"1W_rate" > 2', '"3M_rate" > 2'])} AS any_high FROM shibor""",
)
def horizontal(spark, sf):
    from .macro import shibor

    cols = ["ON_rate", "1W_rate", "3M_rate"]
    return shibor(spark, sf).select(
        "date",
        C.row_max(cols).alias("highest"),
        C.row_mean(cols).alias("mean"),
        C.row_any([F.col(c) > 2 for c in cols]).alias("any_high"),
    )


TENORS = ["ON_rate", "1W_rate", "1M_rate", "3M_rate", "1Y_rate"]
_TENOR_LIST = ", ".join(f'"{t}"' for t in TENORS)
_LIST_STD = f"list_aggregate(list_filter([{_TENOR_LIST}], lambda x: x IS NOT NULL), 'stddev_samp')"


@query("row_list_std", f"{views('shibor')} SELECT date, {nums({'dispersion': clip_sql(_LIST_STD, 0, 10)})} FROM shibor")
def list_std(spark, sf):
    from .macro import shibor

    return shibor(spark, sf).select("date", C.clip(C.row_std(TENORS), 0, 10).alias("dispersion"))


@query("weekly_sample", f"{BARS} SELECT ts_code, date, {nums(['close'])} FROM bars WHERE isodow(date) = 5")
def fridays(spark, sf):
    return weekly_sample(V.bars(spark, sf)).select("ts_code", "date", "close")


@query(
    "reorder",
    f"{ST} SELECT ts_code, {nums(['net_profit', 'total_revenue', 'cfo'], 4)} FROM statements",
    digits=4,
)
def reordered(spark, sf):
    return reorder(V.statements(spark, sf).select("cfo", "net_profit", "ts_code", "total_revenue"), "total_revenue")


@query(
    "valid_filter",
    f"""{ST} SELECT ts_code, notice_date, {nums(['cfo', 'net_profit_yoy'], 4)} FROM statements
    WHERE cfo > 0 AND NOT isnan(cfo) AND net_profit_yoy IS NOT NULL""",
    digits=4,
)
def valid(spark, sf):
    return valid_filter(V.statements(spark, sf), positive=["cfo"], present=["net_profit_yoy"]).select(
        "ts_code", "notice_date", "cfo", "net_profit_yoy"
    )


@query(
    "empty_schema_guard",
    f"""{BARS} SELECT ts_code, date, NULL::DOUBLE AS vol_dev20, NULL::DOUBLE AS vol_dev60, NULL::TINYINT AS vol_spike,
    NULL::DOUBLE AS vwap_dev_1d, NULL::DOUBLE AS avg_trade_price, NULL::VARCHAR AS name FROM bars""",
)
def guard(spark, sf):
    """Bars without close and volume: no momentum, typed-null volume features, a typed-null name."""
    bare = ensure_columns(V.bars(spark, sf).select("ts_code", "date", "open"), {"name": "string"})
    return behavioral.features(bare, ["momentum", "volume"])


@query(
    "staged_metrics",
    f"""{ST}, a AS (SELECT *, total_revenue - operate_cost AS gross_profit, total_asset - total_equity AS liabilities FROM statements),
    b AS (SELECT *, gross_profit / total_revenue AS margin, liabilities / total_revenue AS burden FROM a)
    SELECT ts_code, notice_date, {nums({'margin': 'margin', 'margin_sq': 'margin * margin', 'burden': 'burden'}, 5)} FROM b""",
    digits=5,
)
def staged(spark, sf):
    """Two user-defined providers of different depth."""
    margin = FeatureGroup(
        ("margin", "margin_sq"),
        (
            lambda w: {"gross_profit": F.col("total_revenue") - F.col("operate_cost")},
            lambda w: {"margin": F.col("gross_profit") / F.col("total_revenue")},
            lambda w: {"margin_sq": F.col("margin") * F.col("margin")},
        ),
        ("total_revenue", "operate_cost"),
    )
    burden = FeatureGroup(
        ("burden",),
        (
            lambda w: {"liabilities": F.col("total_asset") - F.col("total_equity")},
            lambda w: {"burden": F.col("liabilities") / F.col("total_revenue")},
        ),
        ("total_asset", "total_equity", "total_revenue"),
    )
    return staged_metrics(V.statements(spark, sf), [margin, burden], ["ts_code", "notice_date"], "select")
