"""Parsing of landed raw files (JSON responses, CSV) into normalised tables.

Parsers take a DataFrame, so they work on any reader; the ``read_*`` helpers cover files in a folder.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.codes import normalize_ts_code
from ..functions.dates import normalize_date_column
from ..operators.relational import dedupe_last, sum_by, union_vertical
from .specs import (
    KLINE,
    KLINE_FIELDS,
    INDUSTRY_FIGURES,
    INDUSTRY_LEVELS,
    INDUSTRY_MEMBERS,
    MARGIN,
    MARGIN_DROPPED,
    QUARTER_IDENTS,
    QUARTER_REPORTS,
    SHIBOR,
    STRING_BARS,
    TableSpec,
)


def apply_spec(df: DataFrame, spec: TableSpec, date_format: str | None = None) -> DataFrame:
    """Rename, select and type the columns of a raw table.

    Absent columns are skipped; numbers that do not parse become null. Rows are unique on
    ``spec.unique`` (target names). ``date_format`` names the format of the date column; without it the
    format is detected in one pass over that column.
    """
    numeric = set(spec.numeric)

    def typed(source: str, target: str) -> Column:
        c = F.col(f"`{source}`")
        return (c.try_cast("double") if target in numeric else c).alias(target)

    out = df.select(*[typed(s, t) for s, t in spec.columns.items() if s in df.columns])
    if spec.date_col and spec.date_col in out.columns:
        out = normalize_date_column(out, spec.date_col, fmt=date_format)
    keys = [c for c in spec.unique if c in out.columns]
    return dedupe_last(out, keys, []) if keys else out


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename the columns present."""
    return df.withColumnsRenamed({s: t for s, t in names.items() if s in df.columns})


# ---- bars -------------------------------------------------------------------------------------


def parse_kline(
    pages: DataFrame, body: str = "body", symbol: str = "symbol", date_format: str | None = "yyyy-MM-dd"
) -> DataFrame:
    """``{data: {klines: ["date,open,close,...", ...]}}`` -> one row per bar.

    Only strings of exactly eleven fields count; responses without data give no rows.
    """
    raw = F.from_json(body, "data struct<klines: array<string>>")
    lines = pages.select(F.col(symbol).alias("ts_code"), F.explode(raw["data"]["klines"]).alias("_line"))
    parts = F.split("_line", ",", -1)
    fields = (
        lines.select("ts_code", parts.alias("_parts"))
        .where(F.size("_parts") == len(KLINE_FIELDS))
        .select("ts_code", *[F.col("_parts")[i].alias(f) for i, f in enumerate(KLINE_FIELDS)])
    )
    return apply_spec(fields, KLINE, date_format)


def read_kline(spark: SparkSession, path: str) -> DataFrame:
    """Folder of JSON lines ``{symbol, data: {klines}}``."""
    pages = spark.read.text(path).select(F.get_json_object("value", "$.symbol").alias("symbol"), F.col("value").alias("body"))
    return parse_kline(pages)


def bars_clean(df: DataFrame, date_format: str | None = "yyyy-MM-dd") -> DataFrame:
    """String bars -> typed bars.

    A ticker with any special-treatment row is left out entirely. Empty strings are missing values;
    the status columns are dropped and codes normalised.
    """
    df = rename(df, STRING_BARS)
    flagged = df.where(F.col("is_st") == "1").select("ts_code").distinct()
    kept = df.join(flagged, "ts_code", "left_anti").drop("trade_status", "is_st")
    kept = normalize_date_column(kept, "date", fmt=date_format)
    measures = ("open", "high", "low", "close", "volume", "turnover")
    return kept.withColumns(
        {c: F.nullif(F.col(c), F.lit("")).try_cast("double") for c in measures}
        | {"ts_code": normalize_ts_code("ts_code")}
    )


def index_bars(df: DataFrame, date_format: str | None = None) -> DataFrame:
    """Index bars: the amount column is not kept."""
    return normalize_date_column(df.drop("amount"), "date", fmt=date_format)


def qvix_bars(df: DataFrame, date_format: str | None = None) -> DataFrame:
    """Volatility-index bars: rows with any missing value are dropped."""
    return normalize_date_column(df.na.drop("any"), "date", fmt=date_format)


# ---- reports and members ----------------------------------------------------------------------


def parse_report(
    pages: DataFrame, spec: TableSpec, body: str = "body", date_format: str | None = "yyyy-MM-dd HH:mm:ss"
) -> DataFrame:
    """``{result: {pages, data: [{...}, ...]}}`` -> one row per report; pages without a result give none."""
    record = T.StructType([T.StructField(s, T.StringType()) for s in spec.columns])
    schema = T.StructType(
        [
            T.StructField(
                "result",
                T.StructType([T.StructField("pages", T.IntegerType()), T.StructField("data", T.ArrayType(record))]),
            )
        ]
    )
    rows = pages.select(F.explode(F.from_json(body, schema)["result"]["data"]).alias("_r")).select("_r.*")
    return apply_spec(rows, spec, date_format)


def read_report(spark: SparkSession, path: str, spec: TableSpec) -> DataFrame:
    """Folder of landed report pages, one JSON document per line."""
    return parse_report(spark.read.text(path).withColumnRenamed("value", "body"), spec)


def read_rows(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """CSV with a header, every column a string; a folder of files is one table."""
    schema = T.StructType([T.StructField(f, T.StringType()) for f in fields])
    # A null marker that no file contains keeps "" apart from a missing field.
    return spark.read.csv(path, header=True, schema=schema, enforceSchema=False, emptyValue="", nullValue="\u0000")


def quarter_report(df: DataFrame, kind: str, date_format: str | None = "yyyy-MM-dd") -> DataFrame:
    """One of the six alternate quarterly reports (see ``QUARTER_REPORTS``).

    Values stay strings, as delivered; both dates and the code are normalised.
    """
    out = rename(df, QUARTER_IDENTS | QUARTER_REPORTS[kind])
    for c in ("date", "notice_date"):
        out = normalize_date_column(out, c, fmt=date_format)
    return out.withColumn("ts_code", normalize_ts_code("ts_code"))


# ---- market-wide series -----------------------------------------------------------------------


def northbound_merge(
    channels: list[DataFrame], names: Mapping[str, str] = {}, date_format: str | None = None
) -> DataFrame:
    """Channels of one flow, summed per date."""
    keep = ["date", "net_buy", "fund_inflow", "cum_net_buy"]
    merged = sum_by(union_vertical(*[rename(c, names).select(*keep) for c in channels]), "date")
    return normalize_date_column(merged, "date", fmt=date_format)


def margin_merge(
    exchanges: list[DataFrame], names: Mapping[str, str] = MARGIN, date_format: str | None = None
) -> DataFrame:
    """Margin tables of several exchanges, as doubles, summed per date."""

    def typed(df: DataFrame) -> DataFrame:
        df = rename(df, names).drop(MARGIN_DROPPED)
        return df.select(*[F.col(c) if c == "date" else F.col(c).cast("double").alias(c) for c in df.columns])

    merged = sum_by(union_vertical(*[typed(e) for e in exchanges]), "date")
    return normalize_date_column(merged, "date", fmt=date_format)


def shibor_rename(df: DataFrame, date_format: str | None = None) -> DataFrame:
    return normalize_date_column(rename(df, SHIBOR), "date", fmt=date_format)


# ---- industry classification ------------------------------------------------------------------


def read_sheet(spark: SparkSession, path: str, names: Mapping[str, str]) -> DataFrame:
    """Landed CSV sheet (a file or a folder of them) as strings, with the columns of ``names`` renamed."""
    return rename(spark.read.csv(path, header=True, emptyValue="", nullValue="\u0000"), names)


def read_industry_level(spark: SparkSession, path: str, level: int) -> DataFrame:
    """Level 1, 2 or 3 of the industry hierarchy; figures of level 3 are doubles, those that do not parse null."""
    sheet = read_sheet(spark, path, INDUSTRY_LEVELS[level])
    figures = [c for c in INDUSTRY_FIGURES if c in sheet.columns]
    return sheet.withColumns({c: F.col(c).try_cast("double") for c in figures}) if figures else sheet


def read_industry_members(spark: SparkSession, path: str, date_format: str | None = "yyyy-MM-dd") -> DataFrame:
    """Constituents of the level 3 industries, whose code the landed sheets carry as ``sw_l3_code``."""
    return normalize_date_column(read_sheet(spark, path, INDUSTRY_MEMBERS), "join_date", fmt=date_format)
