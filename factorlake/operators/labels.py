"""Training labels from a factor (usually a forward return)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clip, flag, probit
from .crosssection import attach, group_stats
from .skew import MAX_GROUP_ROWS, group_sizes, rank_and_count, row_position


def label_name(factor: str) -> str:
    return f"label_{factor}"


def label_gaussian(
    df: DataFrame,
    factor: str,
    rank_by: str = "date",
    by: Sequence[str] = (),
    winsor_limits: tuple[float, float] | None = (0.01, 0.99),
    *,
    max_rows: int | None = MAX_GROUP_ROWS,
) -> DataFrame:
    """Rank within ``(rank_by, *by)``, as a standard normal score of ``(rank - 0.5) / n``.

    Rows without the factor are dropped; a group of one row scores 0. Winsorising first ties the tails.
    """
    keys = [rank_by, *by]
    rows = df.where(F.col(factor).isNotNull() & ~F.isnan(factor))
    value, sizes = F.col(factor), None
    if winsor_limits:
        stats = group_stats(rows, keys, [factor], winsor_limits)
        sizes = stats.withColumnRenamed("n", "_count")
        rows = attach(rows, stats, keys)
        value = clip(factor, F.col(f"{factor}_q0"), F.col(f"{factor}_q1"))
    rows = rows.withColumn("_value", value).select(*df.columns, "_value")
    ranked = rank_and_count(rows, keys, "_value", max_rows=max_rows, sizes=sizes)
    score = probit((F.col("_rank") - 0.5) / F.col("_count"))
    return ranked.select(*df.columns, score.alias(label_name(factor)))


def label_discrete(
    df: DataFrame,
    factor: str,
    rank_by: str = "date",
    num_bins: int = 6,
    tie_break: Sequence[str] = ("ts_code",),
    *,
    max_rows: int | None = MAX_GROUP_ROWS,
) -> DataFrame:
    """Bins 0 .. ``num_bins - 1`` of equal size per ``rank_by`` group, the first ones taking any remainder."""
    rows = df.where(F.col(factor).isNotNull() & ~F.isnan(factor))
    sizes = group_sizes(rows, [rank_by])
    placed = row_position(rows, [rank_by], [factor, *tie_break], "_pos", max_rows=max_rows, sizes=sizes)
    at, n = F.col("_pos") - 1, F.col("_count")
    small = F.floor(n / num_bins)
    extra = n % num_bins
    edge = extra * (small + 1)
    bin_ = F.when(at < edge, F.floor(at / (small + 1))).otherwise(
        extra + F.floor((at - edge) / F.greatest(small, F.lit(1)))
    )
    return attach(placed, sizes, [rank_by]).select(*df.columns, bin_.cast("int").alias(label_name(factor)))


def label_binary(df: DataFrame, factor: str, threshold: float = 0.0) -> DataFrame:
    """1 where the factor exceeds the threshold, else 0; null without the factor."""
    return df.withColumn(label_name(factor), flag(F.col(factor) > threshold))


def label_identity(df: DataFrame, factor: str) -> DataFrame:
    """The factor itself, for regression."""
    return df.withColumn(label_name(factor), F.col(factor))
