"""Key, as-of, dimension and universe joins."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codes import not_special_treatment
from .relational import dedupe_last
from .skew import MAX_GROUP_ROWS, carry_last, shared_dir

STATEMENT_KEYS = ("ts_code", "name", "notice_date")


def join_keys(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on shared key names; null keys never match."""
    return left.join(right, list(on), how)


def statement_join(
    income: DataFrame, balance: DataFrame, cashflow: DataFrame, start: date | None = None, end: date | None = None
) -> DataFrame:
    """Income, balance sheet and cash flow side by side on ``(ts_code, name, notice_date)``.

    A column two statements share keeps the first one's values; the range form filters on notice_date
    (pushed to all three scans).
    """
    frames = [income, balance, cashflow]
    if start is not None:
        frames = [f.where(F.col("notice_date") >= F.lit(start)) for f in frames]
    if end is not None:
        frames = [f.where(F.col("notice_date") <= F.lit(end)) for f in frames]
    keys = list(STATEMENT_KEYS)
    out = frames[0]
    for f in frames[1:]:
        taken = [c for c in f.columns if c in out.columns and c not in keys]
        out = out.join(f.drop(*taken), keys)
    return out


def asof_backward(
    left: DataFrame,
    right: DataFrame,
    *,
    left_on: str = "date",
    right_on: str = "notice_date",
    by: str = "ts_code",
    tie_break: Sequence[str] = (),
    max_rows: int | None = MAX_GROUP_ROWS,
) -> DataFrame:
    """Latest right row with ``right_on <= left_on`` per ``by``; keeps every left row.

    Both sides are stacked and the right row travels forward as one struct, so a null field in the newest
    report is not filled from an older one. At equal dates right rows sort first. Of several right rows
    on one date the last by ``tie_break`` is used.
    """
    fields = [c for c in right.columns if c != by]
    clash = [c for c in fields if c in left.columns]
    if clash:
        raise ValueError(f"as-of join would duplicate columns {clash}")
    right = dedupe_last(right.where(F.col(right_on).isNotNull()), [by, right_on], list(tie_break))
    packed = F.struct(*[F.col(c) for c in fields]).alias("_right")
    body = F.struct(*[F.col(c) for c in left.columns]).alias("_left")
    # A left row without a key matches nothing; such rows are spread over many groups by their date, the only other
    # column that the pass over group sizes has to read.
    salt = F.when(F.col(by).isNull(), 1 + F.pmod(F.xxhash64(left_on), F.lit(4096))).otherwise(F.lit(0).cast("long"))
    stacked = left.select(
        F.col(by).alias("_by"), salt.alias("_salt"), F.col(left_on).alias("_at"), F.lit(1).alias("_side"), body
    ).unionByName(
        right.where(F.col(by).isNotNull()).select(
            F.col(by).alias("_by"),
            F.lit(0).cast("long").alias("_salt"),
            F.col(right_on).alias("_at"),
            F.lit(0).alias("_side"),
            packed,
        ),
        allowMissingColumns=True,
    )
    filled = carry_last(stacked, ["_by", "_salt"], ["_at", "_side"], "_right", "_match", max_rows=max_rows)
    kept = filled.where(F.col("_side") == 1)
    return kept.select("_left.*", *[F.col(f"_match.{c}").alias(c) for c in fields])


def join_macro_left(panel: DataFrame, macro: DataFrame, on: str = "date") -> DataFrame:
    """Left join of date-keyed macro features, one row per date (of several the greatest stays, so rows never multiply).

    The features are stored first. Their size is then known when the join is planned (a guess from the rows they were
    summed from is far too large), so the panel is not shuffled for a few thousand dates.
    """
    daily = dedupe_last(macro, [on], [])
    path = f"{shared_dir(daily.sparkSession)}/macro-{uuid.uuid4().hex}"
    daily.write.parquet(path)
    return panel.join(daily.sparkSession.read.schema(daily.schema).parquet(path), on, "left")


def prefix_columns(df: DataFrame, prefix: str, keep: Sequence[str] = ("date",)) -> DataFrame:
    return df.select(*[F.col(c) if c in keep else F.col(c).alias(f"{prefix}_{c}") for c in df.columns])


def join_dates(frames: Sequence[DataFrame], on: str = "date") -> DataFrame:
    """Successive inner joins on date."""
    return reduce(lambda a, b: a.join(b, on), frames)


# ---- what is in force at a date ----------------------------------------------------------------

SPAN = ("valid_from", "valid_to")


def version_spans(versions: DataFrame, by: Sequence[str], since: str, values: Sequence[str]) -> DataFrame:
    """Validity of each version of a dimension: ``by``, ``values``, ``valid_from`` and ``valid_to`` (exclusive, null for
    the version in force).

    ``versions`` has one row per ``by`` and ``since``. A version that repeats the values before it extends them. Versions
    without a key or a date are never in force. A key has one version a day at most, so the calendar bounds its window.
    """
    w = Window.partitionBy(*by).orderBy("valid_from")
    value = F.struct(*values)
    rows = versions.where(F.col(since).isNotNull() & reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in by]))
    rows = rows.select(*by, *values, F.col(since).alias("valid_from"))
    changed = rows.withColumn("_before", F.lag(value).over(w)).where(~F.col("_before").eqNullSafe(value)).drop("_before")
    return changed.withColumn("valid_to", F.lead("valid_from").over(w))


def membership_spans(
    snapshots: DataFrame, on: str = "ts_code", date_col: str = "date", by: Sequence[str] = ()
) -> DataFrame:
    """When each code belonged: ``by``, ``on``, ``valid_from`` and ``valid_to`` (exclusive, null while it still does).

    ``snapshots`` lists all members at each of its dates. A list holds until the next one; before the first there are no
    members. A code that leaves and returns has several spans. Dates are numbered once (they are as few as the
    days of a calendar); consecutive numbers of a code are one island, since number and rank grow together.
    """
    by = list(by)
    rows = snapshots.where(F.col(on).isNotNull() & F.col(date_col).isNotNull()).select(*by, on, F.col(date_col).alias("_day"))
    along = Window.partitionBy(*by or [F.lit(0)]).orderBy("_day")
    days = rows.select(*by, "_day").distinct().withColumns({"_no": F.row_number().over(along), "_next": F.lead("_day").over(along)})
    numbered = rows.distinct().join(days, [*by, "_day"])
    island = F.col("_no") - F.row_number().over(Window.partitionBy(*by, on).orderBy("_no"))
    spans = numbered.withColumn("_island", island).groupBy(*by, on, "_island")
    return spans.agg(F.min("_day").alias("valid_from"), F.max_by("_next", "_no").alias("valid_to")).drop("_island")


def _in_force(df: DataFrame, spans: DataFrame, on: str, at: str) -> tuple[DataFrame, Column]:
    """``spans`` under names of their own, and the condition that one of them holds for a row."""
    named = spans.withColumnsRenamed({c: f"_in_force_{c}" for c in (on, *SPAN)})
    code, since, until = (F.col(f"_in_force_{c}") for c in (on, *SPAN))
    return named, (df[on] == code) & (df[at] >= since) & (until.isNull() | (df[at] < until))


def join_in_force(df: DataFrame, spans: DataFrame, on: str = "ts_code", at: str = "date") -> DataFrame:
    """Attach the version of a dimension (see ``version_spans``) that is in force on each row's date.

    Rows without one drop out. The join is an equality on the key with the dates as a further condition, so a small
    dimension is broadcast and the rows are not shuffled. A key's versions should be few; use ``asof_backward`` on
    a dimension whose keys change daily.
    """
    named, holds = _in_force(df, spans, on, at)
    return df.join(named, holds).drop(*[f"_in_force_{c}" for c in (on, *SPAN)])


def asof_stored(
    left: DataFrame,
    right: DataFrame,
    *,
    left_on: str = "date",
    right_on: str = "notice_date",
    by: str = "ts_code",
    tie_break: Sequence[str] = (),
) -> DataFrame:
    """``asof_backward`` by validity: each right row holds until the next of its key, and left rows look up what holds.

    Left rows are neither sorted nor, if they come from a table bucketed by the key (``write_bucketed``), shuffled; only
    the right side moves. For right sides with few rows per key (reports): a left row is compared with all of its key's.
    """
    fields = [c for c in right.columns if c != by]
    clash = [c for c in fields if c in left.columns]
    if clash:
        raise ValueError(f"as-of join would duplicate columns {clash}")
    right = dedupe_last(right.where(F.col(right_on).isNotNull() & F.col(by).isNotNull()), [by, right_on], list(tie_break))
    until = F.lead(right_on).over(Window.partitionBy(by).orderBy(right_on))
    spans = right.withColumns({"valid_from": F.col(right_on), "valid_to": until})
    named, holds = _in_force(left, spans, by, left_on)
    return left.join(named, holds, "left").drop(*[f"_in_force_{c}" for c in (by, *SPAN)])


def join_industry(df: DataFrame, industry: DataFrame, on: str = "ts_code", at: str = "notice_date") -> DataFrame:
    """Attach the industry of each code; unclassified codes drop out.

    An ``industry`` with validity spans (see ``industry_spans``) is matched on the date ``at`` of each row, so that
    a code that moved keeps the industry it had. Otherwise it holds for all dates.
    """
    return join_in_force(df, industry, on, at) if set(SPAN) <= set(industry.columns) else df.join(industry, on)


def hierarchy_map(l1: DataFrame, l2: DataFrame, l3: DataFrame) -> DataFrame:
    """Flatten the three industry levels into one row per L3 code.

    Parents are found by name, codes then resolve to names and to the upper level. A parent that cannot
    be resolved keeps its original text, and ``is_unmapped`` says so.
    """
    # A few hundred industries: Spark sees their size and broadcasts them by itself.
    n1 = dedupe_last(l1.select(F.col("sw_l1_name").alias("_n1"), F.col("sw_l1_code").alias("_c1")), ["_n1"], ["_c1"])
    up = (
        l2.select("sw_l2_code", "sw_l2_name", "sw_l1_name")
        .join(n1, F.col("sw_l1_name") == F.col("_n1"), "left")
        .select(
            "sw_l2_code",
            "sw_l2_name",
            F.coalesce("_c1", "sw_l1_name").alias("sw_l1_code"),
            F.col("_c1").isNull().alias("_no_l1"),
        )
    )
    n2 = dedupe_last(up.select(F.col("sw_l2_name").alias("_n2"), F.col("sw_l2_code").alias("_c2")), ["_n2"], ["_c2"])
    low = (
        l3.select("sw_l3_code", "sw_l2_name")
        .join(n2, F.col("sw_l2_name") == F.col("_n2"), "left")
        .select("sw_l3_code", F.coalesce("_c2", "sw_l2_name").alias("sw_l2_code"), F.col("_c2").isNull().alias("_no_l2"))
    )
    codes = dedupe_last(up, ["sw_l2_code"], ["sw_l2_name"])
    names = dedupe_last(l1.select("sw_l1_code", "sw_l1_name"), ["sw_l1_code"], ["sw_l1_name"])
    flat = low.join(codes, "sw_l2_code", "left").select(
        "sw_l3_code",
        "sw_l2_code",
        F.coalesce("sw_l2_name", "sw_l2_code").alias("sw_l2_name"),
        F.coalesce("sw_l1_code", "sw_l2_code").alias("sw_l1_code"),
        (F.col("_no_l2") | F.coalesce("_no_l1", F.lit(True))).alias("is_unmapped"),
    )
    return flat.join(names, "sw_l1_code", "left").select(
        "sw_l3_code",
        "sw_l2_code",
        "sw_l2_name",
        "sw_l1_code",
        F.coalesce("sw_l1_name", "sw_l1_code").alias("sw_l1_name"),
        "is_unmapped",
    )


def universe_filter(df: DataFrame, members: DataFrame, on: str = "ts_code", at: str = "date") -> DataFrame:
    """Rows of the member codes only.

    ``members`` with validity spans (see ``membership_spans``) keep a row if its code is a member on its date ``at``.
    """
    if not set(SPAN) <= set(members.columns):
        return df.join(members.select(on), on, "left_semi")
    named, holds = _in_force(df, members.select(on, *SPAN), on, at)
    return df.join(named, holds, "left_semi")


def tradable_universe(
    listed: DataFrame,
    delisted: DataFrame,
    as_of: date,
    *,
    min_listed_days: int = 365,
    remove_st: bool = True,
) -> DataFrame:
    """Codes listed for at least ``min_listed_days`` on ``as_of``, not ST, and not delisted by then."""
    out = listed.where(F.col("publish_date") <= F.date_sub(F.lit(as_of), min_listed_days))
    if remove_st:
        out = out.where(not_special_treatment("name"))
    gone = delisted.where(F.col("off_date") <= F.lit(as_of)).select("ts_code").distinct()
    return out.join(gone, "ts_code", "left_anti").select("ts_code", "name")


def suspended_filter(df: DataFrame, suspended: DataFrame, on: Sequence[str] = ("ts_code", "date")) -> DataFrame:
    """Drop the rows of codes suspended on that date."""
    return df.join(suspended.select(*on).distinct(), list(on), "left_anti")


# ---- industry classification ------------------------------------------------------------------


def build_classification(members: DataFrame, levels: DataFrame, code: Column) -> DataFrame:
    """Constituents joined with the flattened hierarchy, one row per code and join date.

    ``code`` normalises the raw constituent code. Join dates are kept as history, so that
    ``classification_asof`` has something to look back on; of rows sharing a join date the highest
    L3 code stays.
    """
    rows = members.drop("sw_l1_name", "sw_l2_name").join(levels.drop("is_unmapped"), "sw_l3_code")
    rows = rows.withColumn("ts_code", code).drop("ts_code_suffix")
    return dedupe_last(rows, ["ts_code", "join_date"], ["sw_l3_code"])


def classification_asof(classification: DataFrame, as_of: date) -> DataFrame:
    """Latest known classification per code among rows joined on or before ``as_of``."""
    known = classification.where(F.col("join_date") <= F.lit(as_of))
    return dedupe_last(known, ["ts_code"], ["join_date", "sw_l3_code"])


def industry_l1(classification: DataFrame, *, as_of: date | None = None, include_names: bool = False) -> DataFrame:
    """``ts_code -> sw_l1_code [, sw_l1_name]``, unique per code."""
    latest = (
        classification_asof(classification, as_of)
        if as_of
        else dedupe_last(classification, ["ts_code"], ["join_date", "sw_l3_code"])
    )
    return latest.select("ts_code", "sw_l1_code", *(["sw_l1_name"] if include_names else []))


def industry_spans(classification: DataFrame, *, include_names: bool = False) -> DataFrame:
    """``ts_code -> sw_l1_code [, sw_l1_name]`` with the dates from and until which it holds.

    A code is classified from its first join date on. Moves inside an L1 industry do not end a span.
    """
    values = ["sw_l1_code", *(["sw_l1_name"] if include_names else [])]
    rows = dedupe_last(classification, ["ts_code", "join_date"], ["sw_l3_code"])
    return version_spans(rows, ["ts_code"], "join_date", values)
