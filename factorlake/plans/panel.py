"""From bars, statements, industries and macro series to one research panel."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import behavioral, fundamental
from ..operators.crosssection import industry_neutral
from ..operators.joins import asof_backward, asof_stored, join_macro_left, universe_filter
from ..operators.relational import dedupe_last, reorder, weekly_sample
from ..operators.skew import MAX_GROUP_ROWS


def market_features(
    bars: DataFrame, order: Sequence[str] = (), *, max_rows: int | None = MAX_GROUP_ROWS
) -> DataFrame:
    """Behavioural features of raw bars.

    ``order`` (say an ingest time and a position in the file) decides which of several bars of a ticker on one day
    stays: the last. Without it the caller vouches for one bar a day. The bars are sorted once either way: the window
    that finds a day's last bar has the order that the features need.
    """
    if order:
        following = F.lead("date").over(Window.partitionBy("ts_code").orderBy("date", *order))
        last = F.col("date").isNotNull() & ~F.col("date").eqNullSafe(F.col("_following"))
        bars = bars.withColumn("_following", following).where(last).drop("_following")
    return behavioral.features(bars, max_rows=max_rows)


def fundamental_features(statements: DataFrame) -> DataFrame:
    """Fundamental factors, one row per code and notice date."""
    return dedupe_last(fundamental.factors(statements), ["ts_code", "notice_date"], ["name"])


def panel_stack(
    market: DataFrame, fundamentals: DataFrame, macro: DataFrame, *, max_rows: int | None = MAX_GROUP_ROWS
) -> DataFrame:
    """Market rows with the latest report known on their date and the macro features of that date.

    Sort by ``(ts_code, date)`` at the sink if an order is needed. With calendar dates on both sides a code has few
    reports, so unless ``max_rows`` is set lower, market rows look up what holds and stay where their features were
    computed; otherwise both sides are dealt and sorted anew.
    """
    drop = [c for c in fundamentals.columns if c in market.columns and c != "ts_code"]
    reports = fundamentals.drop(*drop)
    dated = all(isinstance(t, T.DateType) for t in (market.schema["date"].dataType, reports.schema["notice_date"].dataType))
    if dated and max_rows == MAX_GROUP_ROWS:
        merged = asof_stored(market, reports)
    else:
        merged = asof_backward(market, reports, max_rows=max_rows)
    return join_macro_left(merged, macro)


def panel_dataset(
    market: DataFrame,
    fundamentals: DataFrame,
    macro: DataFrame,
    industry: DataFrame,
    members: DataFrame,
    *,
    factors: Sequence[str],
    start: date,
    end: date,
    label: str,
    period: str | None = "notice_date",
    min_group_size: int = 5,
    max_rows: int | None = MAX_GROUP_ROWS,
) -> DataFrame:
    """The model panel: universe and date range, sector-neutral factors, point-in-time joins, Fridays.

    ``market`` and ``fundamentals`` are feature tables. Fridays are selected before the as-of join, which
    gives the same rows as selecting them afterwards on a fifth of the data. Normalisation runs within
    industry and ``period``; ``period=None`` pools all reports up to ``end``. Reports before ``start`` take part,
    since the one in force on the first dates is older than they are.
    Nothing looks ahead if ``industry`` and ``members`` come with validity spans (``industry_spans``,
    ``membership_spans``): a report is normalised in the industry of its day, a code is in the panel while it is a member.
    """
    span = F.col("date").between(F.lit(start), F.lit(end))
    rows = weekly_sample(universe_filter(market.where(span), members))
    reports = fundamentals.where(F.col("notice_date") <= F.lit(end))
    neutral = industry_neutral(
        reports, industry, factors, by=[period] if period else [], min_group_size=min_group_size
    )
    return reorder(panel_stack(rows, neutral, macro, max_rows=max_rows), label)


def bars_resample(bars: DataFrame, period: str = "week") -> DataFrame:
    """Daily bars to weekly or monthly ones, dated by their last trading day."""
    if period not in ("week", "month"):
        raise ValueError(f"period must be week or month, not {period!r}")
    rules = {
        "open": F.min_by("open", "date"),
        "high": F.max("high"),
        "low": F.min("low"),
        "close": F.max_by("close", "date"),
        "volume": F.sum("volume"),
        "amount": F.sum("amount"),
    }
    aggs = [rule.alias(c) for c, rule in rules.items() if c in bars.columns]
    return bars.groupBy("ts_code", F.trunc("date", period).alias("period_start")).agg(F.max("date").alias("date"), *aggs)


def bars_adjust(
    bars: DataFrame, factors: DataFrame, adjust: str = "hfq", *, max_rows: int | None = MAX_GROUP_ROWS
) -> DataFrame:
    """Prices adjusted by the factor in force on each date.

    Backward adjustment (``hfq``) multiplies, forward adjustment (``qfq``) divides. Before the first
    factor prices are unchanged.
    """
    if adjust not in ("hfq", "qfq"):
        raise ValueError(f"adjust must be hfq or qfq, not {adjust!r}")
    right = factors.select("ts_code", F.col("date").alias("_from"), F.col("factor").alias("_factor"))
    merged = asof_backward(bars, right, right_on="_from", max_rows=max_rows)
    k = F.coalesce("_factor", F.lit(1.0))
    prices = [c for c in ("open", "high", "low", "close") if c in bars.columns]
    return merged.withColumns({c: F.col(c) * k if adjust == "hfq" else F.col(c) / k for c in prices}).select(*bars.columns)
