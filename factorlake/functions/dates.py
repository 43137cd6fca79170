"""Dates, quarters and book keys."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import as_col

# Accepted spellings of a calendar date, and of a date with time.
DATE_FORMATS = ("yyyyMMdd", "yyyy-M-d", "yyyy/M/d", "yyyy.M.d")
COLUMN_DATE_FORMATS = ("yyyy-M-d", "yyyyMMdd", "yyyy/M/d", "yyyy.M.d", "yyyy年M月d日")
COLUMN_TIME_FORMATS = ("yyyy-M-d HH:mm:ss", "yyyy/M/d HH:mm:ss", "yyyy-M-d HH:mm")


def _try_date(c: Column, fmt: str) -> Column:
    return F.to_date(F.try_to_timestamp(c, F.lit(fmt)))


def parse_date(c: str | Column, *, strict: bool = False) -> Column:
    """First accepted format that fits the trimmed string; otherwise null, or an error when ``strict``."""
    raw = as_col(c)
    text = F.trim(raw)
    out = F.coalesce(*[_try_date(text, f) for f in DATE_FORMATS])
    if strict:
        bad = F.raise_error(F.concat(F.lit("cannot convert to date: "), F.coalesce(raw, F.lit("null"))))
        out = F.coalesce(out, bad.cast("date"))
    return out


def format_ymd(c: str | Column, sep: str = "") -> Column:
    return F.date_format(as_col(c), f"yyyy{sep}MM{sep}dd" if sep else "yyyyMMdd")


def normalize_date_column(
    df: DataFrame,
    name: str,
    *,
    target: str = "date",
    strict: bool = False,
    threshold: float = 0.7,
    fmt: str | None = None,
) -> DataFrame:
    """Turn a column into ``date`` or ``datetime`` (``timestamp_ntz``).

    For strings the format is chosen once for the whole column: the first candidate that parses at least
    ``threshold`` of the rows, else the one that parses most. All candidates are scored in a single
    aggregate over the distinct strings, weighted by their rows; only the scores reach the driver. Pass ``fmt`` to skip scoring. A column that no format
    parses is left as it is, or is an error when ``strict``.
    """
    if name not in df.columns:
        raise ValueError(f"column {name!r} not found")
    c = F.col(name)
    kind = df.schema[name].dataType
    final = "date" if target == "date" else "timestamp_ntz"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return df.withColumn(name, c.cast(final))
    if not isinstance(kind, T.StringType):
        return df.withColumn(name, (c.cast("date") if strict else c.try_cast("date")).cast("date"))
    if fmt is not None:
        return df.withColumn(name, F.try_to_timestamp(c, F.lit(fmt)).cast(final))

    candidates = [F.try_to_timestamp(c, F.lit(f)) for f in (*COLUMN_DATE_FORMATS, *COLUMN_TIME_FORMATS)]
    candidates.append(c.try_cast("timestamp"))
    n, *scores = [r or 0 for r in _scores(df, name, candidates).first()]
    enough = int(n * threshold)
    best = next((i for i, s in enumerate(scores) if s >= enough), None)
    if best is None or scores[best] == 0:
        best = max(range(len(scores)), key=lambda i: scores[i])
    if scores[best] == 0:
        if strict:
            raise ValueError(f"failed to parse {name!r} as date/datetime")
        return df
    return df.withColumn(name, candidates[best].cast(final))


def _scores(df: DataFrame, name: str, candidates: list[Column]) -> DataFrame:
    """Rows, and how many of them each candidate parses. A failed attempt is dear, so each distinct string is tried once."""
    rows = df.groupBy(F.col(name)).agg(F.count(F.lit(1)).alias("_rows"))
    return rows.agg(F.sum("_rows"), *[F.sum(F.when(e.isNotNull(), F.col("_rows"))) for e in candidates])


# ---- quarters ---------------------------------------------------------------------------------


def quarter_key(d: str | Column) -> Column:
    """``2024_Q1`` of a date."""
    d = as_col(d)
    return F.concat(F.year(d).cast("string"), F.lit("_Q"), F.quarter(d).cast("string"))


def quarter_start(key: str | Column) -> Column:
    """First day of a ``YYYY_Qn`` key; null for a malformed key."""
    key = as_col(key)
    ok = key.rlike(r"^\d{4}_Q[1-4]$")
    year = F.when(ok, F.substring(key, 1, 4).try_cast("int"))
    return F.make_date(year, F.when(ok, F.substring(key, 7, 1).try_cast("int")) * 3 - 2, F.lit(1))


def quarter_end(d: str | Column) -> Column:
    """Last day of the quarter that contains ``d``."""
    return F.last_day(F.add_months(F.trunc(as_col(d), "quarter"), 2))


def next_quarter(d: str | Column) -> Column:
    return F.add_months(F.trunc(as_col(d), "quarter"), 3).cast("date")


def previous_quarter(d: str | Column) -> Column:
    return F.add_months(F.trunc(as_col(d), "quarter"), -3).cast("date")


def completed_quarter(d: str | Column) -> Column:
    """First day of the most recent quarter already finished on ``d``."""
    return previous_quarter(d)


def is_year_end(d: str | Column) -> Column:
    return F.quarter(as_col(d)) == 4


def quarters_between(start: Column, end: Column) -> Column:
    """Array of quarter starts covering ``[start, end]``."""
    return F.sequence(F.trunc(start, "quarter"), F.trunc(end, "quarter"), F.expr("interval 3 months"))


def quarter_spine(spark: SparkSession, start: date, end: date) -> DataFrame:
    """All ``(year, quarter, book)`` covering ``[start, end]``; reversed bounds are an error."""
    if start > end:
        raise ValueError("start must be before or equal to end")
    q = F.explode(quarters_between(F.lit(start), F.lit(end))).alias("quarter_start")
    return spark.range(1).select(q).select(
        F.year("quarter_start").alias("year"),
        F.quarter("quarter_start").alias("quarter"),
        quarter_key("quarter_start").alias("book"),
    )


# ---- other book keys --------------------------------------------------------------------------

# The macro books.
MACRO_BOOKS = ("northbound", "marginshort", "shibor", "index", "qvix")


def universe_key(universe: str | Column, d: str | Column) -> Column:
    """``csi500_2024-01-15``; the bare universe when there is no date."""
    return F.concat_ws("_", as_col(universe), F.date_format(as_col(d), "yyyy-MM-dd"))


def split_universe_key(key: str | Column) -> tuple[Column, Column]:
    """``(universe, date)`` of a key, split at its last underscore."""
    key = as_col(key)
    has_date = F.instr(key, "_") > 0
    universe = F.when(has_date, F.regexp_extract(key, r"^(.*)_[^_]*$", 1)).otherwise(key)
    day = F.when(has_date, F.regexp_extract(key, r"_([^_]*)$", 1)).try_cast("date")
    return universe, day


def ticker_to_ts_code(key: str | Column) -> Column:
    """``000001_SZ`` -> ``000001.SZ``."""
    return F.replace(as_col(key), F.lit("_"), F.lit("."))


def check_macro_book(key: str) -> str:
    if key not in MACRO_BOOKS:
        raise ValueError(f"unknown macro book {key!r}")
    return key
