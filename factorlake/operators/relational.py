"""Dedupe, union, profile and other table-level operators."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dedupe_last(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Keep the last row per key. ``order`` should be total; the rest of the row breaks remaining ties.

    An aggregate, not a window: duplicates of a hot key shrink to one row per task before the shuffle.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    by = F.struct(*order, *[F.col(c) for c in rest])
    row = F.max_by(F.struct(*rest), by) if rest else F.count(F.lit(1))
    out = df.groupBy(*keys).agg(row.alias("_row"))
    return out.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def dedupe_any(df: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """One arbitrary row per key (whole row when no keys are given)."""
    return df.dropDuplicates(list(keys) if keys else None)


def union_vertical(*frames: DataFrame) -> DataFrame:
    """Stack frames of one schema; other column names or types are an error."""
    first = [(f.name, f.dataType) for f in frames[0].schema]
    for other in frames[1:]:
        if [(f.name, f.dataType) for f in other.schema] != first:
            raise ValueError("union_vertical needs identical schemas")
    return reduce(DataFrame.unionByName, frames)


def union_relaxed(*frames: DataFrame) -> DataFrame:
    """Stack frames of the same columns, widening types to their common supertype."""
    names = frames[0].columns
    for other in frames[1:]:
        if sorted(other.columns) != sorted(names):
            raise ValueError("union_relaxed needs the same columns")
    return reduce(DataFrame.unionByName, frames)


def union_diagonal(*frames: DataFrame) -> DataFrame:
    """Stack by name; columns a frame lacks become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def sum_by(df: DataFrame, key: str) -> DataFrame:
    """Sum of every other column per key; a group of only nulls sums to 0."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(*[F.coalesce(F.sum(c), F.lit(0).cast(df.schema[c].dataType)).alias(c) for c in rest])


def any_flag(df: DataFrame, cond: Column, name: str = "any") -> DataFrame:
    """One row: does any row satisfy ``cond``? (False on an empty frame.)"""
    return df.agg(F.coalesce(F.bool_or(cond), F.lit(False)).alias(name))


def null_profile(df: DataFrame) -> DataFrame:
    """Per column: non-null and null counts and ratios. One pass over the data; an empty frame has no rows."""
    total = F.count(F.lit(1))
    per_col = [
        F.struct(F.lit(c).alias("column"), F.count(F.col(c)).alias("non_null"), total.alias("total")) for c in df.columns
    ]
    one = df.agg(F.array(*per_col).alias("p")).select(F.inline("p")).where("total > 0")
    return one.select(
        "column",
        "non_null",
        (F.col("total") - F.col("non_null")).alias("null"),
        (F.col("non_null") / F.col("total")).alias("non_null_ratio"),
        ((F.col("total") - F.col("non_null")) / F.col("total")).alias("null_ratio"),
    )


def coverage_stats(df: DataFrame, code: str = "ts_code", day: str = "date") -> DataFrame:
    """Rows, distinct codes and first/last day."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct(code).alias("codes"),
        F.min(day).alias("first_date"),
        F.max(day).alias("last_date"),
    )


def join_retention(before: DataFrame, after: DataFrame) -> DataFrame:
    """Share of rows, in percent, that a join or filter kept."""
    sizes = before.agg(F.count(F.lit(1)).alias("n"), F.lit(0).alias("after")).unionByName(
        after.agg(F.count(F.lit(1)).alias("n"), F.lit(1).alias("after"))
    )
    return sizes.agg(
        F.max(F.when(F.col("after") == 0, F.col("n"))).alias("rows_before"),
        F.max(F.when(F.col("after") == 1, F.col("n"))).alias("rows_after"),
    ).withColumn("retained_pct", F.try_divide(F.col("rows_after") * 100.0, F.col("rows_before")))


def ensure_columns(df: DataFrame, wanted: dict[str, T.DataType | str]) -> DataFrame:
    """Add absent columns as typed nulls, decided from the schema at plan time."""
    missing = {c: F.lit(None).cast(t) for c, t in wanted.items() if c not in df.columns}
    return df.withColumns(missing) if missing else df


def reorder(df: DataFrame, label: str, first: Sequence[str] = ("date", "ts_code")) -> DataFrame:
    """Identifiers, then the label, then everything else; absent leading columns are skipped."""
    head = [c for c in [*first, label] if c in df.columns]
    return df.select(*head, *[c for c in df.columns if c not in head])


def weekly_sample(df: DataFrame, day: str = "date") -> DataFrame:
    """Fridays only."""
    return df.where(F.weekday(day) == 4)


def valid_filter(df: DataFrame, positive: Sequence[str] = (), present: Sequence[str] = ()) -> DataFrame:
    """Rows whose ``positive`` columns are numbers above zero and whose ``present`` columns are not null."""
    for c in positive:
        df = df.where(~F.isnan(c) & (F.col(c) > 0))
    for c in present:
        df = df.where(F.col(c).isNotNull())
    return df


