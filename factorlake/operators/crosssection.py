"""Normalisation within groups of a cross-section (industry, industry and period, date, ...).

Group statistics are aggregates joined back, never a window over the whole group: a handful of
industries must not mean a handful of tasks.
"""

from __future__ import annotations

import logging
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clip, nan_to_null, nearest_index
from .joins import join_industry
from .skew import counts_before, durable, hot_keys, join_nullsafe

log = logging.getLogger(__name__)

# Above this many rows a group's quantile is looked up in a distributed tally instead of a sorted array.
QUANTILE_SORT_ROWS = 20_000

# Fundamental factors normalised within industries by default.
DEFAULT_SECTOR_FACTORS = (
    "gross_margin", "operate_margin", "net_margin", "roe", "roa", "asset_turnover",
    "debt_to_equity", "debt_asset_ratio", "current_ratio", "quick_ratio", "cfo_yield", "ttm_cfo_yield",
    "accrual_ratio", "revenue_growth_yoy", "net_profit_growth_yoy", "asset_growth_yoy", "debt_growth_yoy",
    "ttm_roe",
)


def _bare(df: DataFrame, c: str) -> Column:
    """NaN never takes part in group statistics."""
    return nan_to_null(c) if df.schema[c].dataType.typeName() in ("double", "float") else F.col(c)


def _key_match(left: DataFrame, right: DataFrame, by: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in by:
        cond = cond & left[k].eqNullSafe(right[f"_k_{k}"])
    return cond


def attach(df: DataFrame, stats: DataFrame, by: Sequence[str]) -> DataFrame:
    """Join group statistics back (null keys form a group); adaptive execution picks the join by their size in bytes."""
    keyed = stats.select(*[F.col(k).alias(f"_k_{k}") for k in by], *[c for c in stats.columns if c not in by])
    return df.join(keyed, _key_match(df, keyed, by)).drop(*[f"_k_{k}" for k in by])


def _small_group_stats(
    df: DataFrame, by: Sequence[str], moments: Sequence[Column], qs: dict[str, tuple[str, float]]
) -> DataFrame:
    """Moments, and nearest-rank quantiles by sorting each group's values once (groups of bounded size)."""
    factors = dict.fromkeys(c for c, _ in qs.values())
    lists = [F.collect_list(_bare(df, c)).alias(f"_v_{c}") for c in factors]
    out = df.groupBy(*by).agg(*moments, *lists)
    out = out.withColumns({f"_v_{c}": F.sort_array(f"_v_{c}") for c in factors}) if factors else out
    picks = {name: F.get(f"_v_{c}", nearest_index(F.size(f"_v_{c}"), q)) for name, (c, q) in qs.items()}
    return (out.withColumns(picks) if picks else out).drop(*[f"_v_{c}" for c in factors])


def _tally(df: DataFrame, by: Sequence[str], qs: dict[str, tuple[str, float]], accuracy: int | None) -> DataFrame:
    """Quantiles ``qs`` per group, and ``_n_<factor>``, the number of its values. With ``accuracy``, values that a sketch
    says are far from the wanted one are only counted; a quantile that the sketch misses is null.
    """
    factors = dict.fromkeys(c for c, _ in qs.values())
    x = {c: _bare(df, c).cast("double") for c in factors}
    aggs = [F.count(x[c]).alias(f"_n_{c}") for c in factors]
    if accuracy:
        # A sketch errs by a share of 1 / accuracy of the values.
        ends = lambda q: [max(q - 2 / accuracy, 0.0), min(q + 2 / accuracy, 1.0)]
        for c in factors:
            wanted = [e for f, q in qs.values() if f == c for e in ends(q)]
            aggs.append(F.percentile_approx(x[c], wanted, accuracy).alias(f"_e_{c}"))
    heads = df.groupBy(*by).agg(*aggs)
    heads = durable(heads) if accuracy else heads
    rows, cells, at = attach(df, heads, by) if accuracy else df, [], dict.fromkeys(factors, 0)
    for name, (c, _) in qs.items():
        low, high = (F.col(f"_e_{c}")[at[c] + i] if accuracy else F.lit(None).cast("double") for i in (0, 1))
        at[c] += 2
        value = F.when(F.coalesce(x[c] >= low, F.lit(True)), x[c])
        counted = F.coalesce(x[c] <= high, F.lit(True))
        cells.append(F.struct(F.lit(name).alias("_q"), x[c].alias("_x"), value.alias("_v"), counted.alias("_in")))
    values = rows.select(*by, F.explode(F.array(*cells)).alias("_p")).select(*by, "_p.*").where("_in")
    tally = values.groupBy(*by, "_q", "_v").agg(F.count("_x").alias("_c"))
    ranked = join_nullsafe(counts_before(tally, [*by, "_q"], "_v", "_c"), heads, by)

    def pick(name: str, c: str, q: float) -> Column:
        i = nearest_index(F.col(f"_n_{c}"), q) - F.col("_before")
        return F.max(F.when((F.col("_q") == name) & (i >= 0) & (i < F.col("_c")), F.col("_v")))

    picks = [pick(name, c, q).alias(name) for name, (c, q) in qs.items()]
    return ranked.groupBy(*by).agg(*picks, *[F.max(f"_n_{c}").alias(f"_n_{c}") for c in factors])


def tallied_quantiles(
    df: DataFrame, by: Sequence[str], qs: dict[str, tuple[str, float]], *, accuracy: int = 10_000
) -> DataFrame:
    """Exact nearest-rank quantiles of large groups: distinct values are counted, and ranks are sums of counts.

    A sketch brackets each quantile. Values below the bracket are one number, so only the few inside it are moved; groups
    whose bracket misses are counted again in full. Values are combined per task before their shuffle and then
    range-partitioned, so neither a large group nor a value that many rows share lands in one task.
    """
    by = list(by)
    found = durable(_tally(df, by, qs, accuracy))
    misses = reduce(lambda a, b: a | b, [F.col(name).isNull() & (F.col(f"_n_{c}") > 0) for name, (c, _) in qs.items()])
    missed = found.where(misses).select(*[F.col(k).alias(f"_k_{k}") for k in by])
    if missed.isEmpty():
        return found.select(*by, *qs)
    again = _tally(df.join(missed, _key_match(df, missed, by), "left_semi"), by, qs, None)
    return found.where(~misses).select(*by, *qs).unionByName(again.select(*by, *qs))


def group_stats(
    df: DataFrame,
    by: Sequence[str],
    factors: Sequence[str],
    quantiles: Sequence[float] = (),
    *,
    sort_rows: int | None = QUANTILE_SORT_ROWS,
) -> DataFrame:
    """One row per group: ``n``, and per factor its mean, sample std and nearest-rank quantiles.

    Columns are ``<factor>_mean``, ``<factor>_std`` and ``<factor>_q0``, ``_q1``, ... in the order of
    ``quantiles``. NaN and null take no part. Without groups above ``sort_rows`` nothing is computed here but the
    check for them.
    """
    by = list(by)
    moments = [F.count(F.lit(1)).alias("n")]
    for f in factors:
        moments += [F.avg(_bare(df, f)).alias(f"{f}_mean"), F.stddev_samp(_bare(df, f)).alias(f"{f}_std")]
    qs = {f"{f}_q{i}": (f, q) for f in factors for i, q in enumerate(quantiles)}
    hot = hot_keys(df, by, sort_rows) if qs else None
    if hot is None:
        return _small_group_stats(df, by, moments, qs)
    keyed = hot.select(*[F.col(k).alias(f"_k_{k}") for k in by])
    match = _key_match(df, keyed, by)
    cold = df.join(keyed, match, "left_anti")
    big = df.join(keyed, match, "left_semi")
    small_stats = _small_group_stats(cold, by, moments, qs)
    big_stats = attach(big.groupBy(*by).agg(*moments), tallied_quantiles(big, by, qs), by)
    return small_stats.unionByName(big_stats)


def group_stats_over(
    df: DataFrame, by: Sequence[str], factors: Sequence[str], quantiles: Sequence[float] = (), **kw
) -> DataFrame:
    """Rows of ``df`` with the statistics of their group attached."""
    stats = group_stats(df, by, factors, quantiles, **kw)
    return attach(df, stats.withColumnRenamed("n", "group_size"), by)


def cs_zscore(
    df: DataFrame,
    by: Sequence[str],
    factors: Sequence[str],
    *,
    winsorize: bool = True,
    limits: tuple[float, float] = (0.01, 0.99),
    min_group_size: int = 1,
    namespace: str = "cs",
    zsuffix: str = "z",
    sort_rows: int | None = QUANTILE_SORT_ROWS,
) -> DataFrame:
    """Z-score per group: ``(x_w - mean(x)) / max(std(x), 1e-9)``.

    ``x_w`` is ``x`` clipped to the group's nearest-rank quantiles (also returned as ``cs_<f>_win``), or
    ``x`` itself; mean and std are those of the unclipped values. NaN is treated as null. Groups of fewer
    than ``min_group_size`` rows are dropped.
    """
    stats = group_stats(df, by, factors, limits if winsorize else (), sort_rows=sort_rows)
    if min_group_size > 1:
        stats = stats.where(F.col("n") >= min_group_size)
    prefix = "_stat_"
    stats = stats.select(*by, *[F.col(c).alias(prefix + c) for c in stats.columns if c not in by])
    joined = attach(df, stats, by)
    out = {}
    for f in factors:
        x = _bare(df, f)
        if winsorize:
            x = clip(x, F.col(f"{prefix}{f}_q0"), F.col(f"{prefix}{f}_q1"))
            out[f"{namespace}_{f}_win"] = x
        out[f"{namespace}_{f}_{zsuffix}"] = (x - F.col(f"{prefix}{f}_mean")) / clip(f"{prefix}{f}_std", 1e-9)
    return joined.select(*df.columns, *[v.alias(k) for k, v in out.items()])


def sector_normalize(
    df: DataFrame,
    by: Sequence[str],
    factors: Sequence[str],
    *,
    winsorize: bool = False,
    limits: tuple[float, float] = (0.01, 0.99),
    min_group_size: int = 5,
    zsuffix: str = "z",
) -> DataFrame:
    """Drop small groups, then z-score the factors present; without the group keys the frame is unchanged."""
    missing = [k for k in by if k not in df.columns]
    present = [f for f in factors if f in df.columns]
    if missing or not present:
        log.warning("nothing to normalise: missing keys %s, usable factors %s", missing, present)
        return df
    return cs_zscore(
        df, by, present, winsorize=winsorize, limits=limits, min_group_size=min_group_size, zsuffix=zsuffix
    )


def industry_neutral(
    df: DataFrame,
    industry: DataFrame,
    factors: Sequence[str] = DEFAULT_SECTOR_FACTORS,
    *,
    by: Sequence[str] = (),
    at: str = "notice_date",
    winsorize: bool = True,
    limits: tuple[float, float] = (0.01, 0.99),
    min_group_size: int = 5,
    zsuffix: str = "z",
) -> DataFrame:
    """Attach the L1 industry and normalise within ``[sw_l1_code, *by]``.

    Pass the report period in ``by``: pooling all dates (``by=()``) lets later reports shift earlier
    scores. Pass the industry with its validity spans (``industry_spans``): the one in force on the date ``at`` counts.
    """
    if "ts_code" not in df.columns:
        raise ValueError("missing column ts_code")
    return sector_normalize(
        join_industry(df, industry, at=at),
        ["sw_l1_code", *by],
        factors,
        winsorize=winsorize,
        limits=limits,
        min_group_size=min_group_size,
        zsuffix=zsuffix,
    )
