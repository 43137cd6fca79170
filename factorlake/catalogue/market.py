"""Bars: window primitives and behavioural factor groups."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import behavioral
from ..operators.skew import over_series
from ..plans.panel import bars_adjust, bars_resample, market_features
from ..sources.ingest import index_bars, qvix_bars
from . import views as V
from .registry import clip_sql, corr_sql, flag_sql, lag_sql, nums, query, roll_sql, views

BARS = views("bars")


def _series(spark, sf, stages, back=0, ahead=0, keep=()):
    # One bar per ticker and DATE: the calendar bounds a series, so its size is not checked.
    out = over_series(V.bars(spark, sf), ["ts_code"], ["date"], stages, back=back, ahead=ahead, max_rows=None)
    return out.select("ts_code", "date", *keep)


# ---- window primitives ------------------------------------------------------------------------

FORWARD_SQL = {n: f"{lag_sql('close', -k)} / close - 1" for n, k in behavioral.FORWARD_HORIZONS.items()}


@query("forward_returns", f"{BARS} SELECT ts_code, date, {nums(FORWARD_SQL)} FROM bars")
def forward_returns(spark, sf):
    names = behavioral.FORWARD_HORIZONS
    return _series(
        spark, sf, [lambda w: {n: C.forward_return("close", w, k) for n, k in names.items()}], ahead=261, keep=names
    )


@query(
    "lag_diff",
    f"""{BARS}, s AS (SELECT *, close - {lag_sql('close')} AS diff_1 FROM bars)
    SELECT ts_code, date, {nums({'lag_1': lag_sql('close'), 'lag_5': lag_sql('close', 5), 'diff_1': 'diff_1',
    'diff_2': 'diff_1 - ' + lag_sql('diff_1')})} FROM s""",
)
def lag_diff(spark, sf):
    return _series(
        spark,
        sf,
        [
            lambda w: {
                "lag_1": F.lag("close", 1).over(w),
                "lag_5": F.lag("close", 5).over(w),
                "diff_1": C.diff("close", w),
            },
            lambda w: {"diff_2": C.diff("diff_1", w)},
        ],
        back=5,
        keep=("lag_1", "lag_5", "diff_1", "diff_2"),
    )


@query(
    "pct_change",
    f"""{BARS} SELECT ts_code, date,
    {nums({f'pct_{n}': f"close / {lag_sql('close', n)} - 1" for n in (1, 4, 12)})} FROM bars""",
)
def pct_change(spark, sf):
    return _series(
        spark,
        sf,
        [lambda w: {f"pct_{n}": C.pct_change("close", w, n) for n in (1, 4, 12)}],
        back=12,
        keep=("pct_1", "pct_4", "pct_12"),
    )


MEANS = ((4, 2), (12, 4), (24, 8), (60, 15), (120, 30))


@query(
    "rolling_mean",
    f"{BARS} SELECT ts_code, date, {nums({f'mean_{n}': roll_sql('avg', 'close', n, m) for n, m in MEANS})} FROM bars",
)
def rolling_mean(spark, sf):
    return _series(
        spark,
        sf,
        [lambda w: {f"mean_{n}": C.roll_mean("close", w, n, m) for n, m in MEANS}],
        back=120,
        keep=[f"mean_{n}" for n, _ in MEANS],
    )


@query(
    "rolling_std",
    f"""{BARS} SELECT ts_code, date, {nums({'std_20': roll_sql('stddev_samp', 'close', 20, 10),
    'std_60': roll_sql('stddev_samp', 'close', 60, 20)})} FROM bars""",
)
def rolling_std(spark, sf):
    return _series(
        spark,
        sf,
        [lambda w: {"std_20": C.roll_std("close", w, 20, 10), "std_60": C.roll_std("close", w, 60, 20)}],
        back=60,
        keep=("std_20", "std_60"),
    )


@query(
    "rolling_var",
    f"{BARS} SELECT ts_code, date, {nums({'var_60': roll_sql('var_samp', 'ln(close)', 60, 20)})} FROM bars",
)
def rolling_var(spark, sf):
    return _series(
        spark,
        sf,
        [lambda w: {"_ln": C.log(F.col("close"))}, lambda w: {"var_60": C.roll_var("_ln", w, 60, 20)}],
        back=60,
        keep=("var_60",),
    )


@query(
    "rolling_min_max",
    f"""{BARS} SELECT ts_code, date, {nums({'high_20': roll_sql('max', 'high', 20, 5), 'low_20': roll_sql('min', 'low', 20, 5),
    'high_50': roll_sql('max', 'high', 50, 10), 'low_50': roll_sql('min', 'low', 50, 10)})} FROM bars""",
)
def rolling_min_max(spark, sf):
    def stage(w):
        return {
            f"{side}_{n}": fn(side, w, n, m)
            for n, m in ((20, 5), (50, 10))
            for side, fn in (("high", C.roll_max), ("low", C.roll_min))
        }

    return _series(spark, sf, [stage], back=50, keep=("high_20", "low_20", "high_50", "low_50"))


@query(
    "rolling_quantile",
    f"""{BARS}, s AS (SELECT ts_code, date, list_sort(list(volume) OVER
      (PARTITION BY ts_code ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)) AS v FROM bars)
    SELECT ts_code, date, {nums({'q95': 'CASE WHEN len(v) >= 20 THEN v[1 + round((len(v) - 1) * 0.95::DOUBLE)::INT] END'})} FROM s""",
)
def rolling_quantile(spark, sf):
    return _series(
        spark, sf, [lambda w: {"q95": C.roll_quantile("volume", w, 60, 0.95, 20)}], back=60, keep=("q95",)
    )


@query(
    "rolling_corr",
    f"""{BARS}, s AS (SELECT *, {lag_sql('close')} AS c1, {lag_sql('close', 5)} AS c5 FROM bars)
    SELECT ts_code, date, {nums({'corr_1': corr_sql('close', 'c1', 60, 20), 'corr_5': corr_sql('close', 'c5', 60, 20)})}
    FROM s""",
)
def rolling_corr(spark, sf):
    return _series(
        spark,
        sf,
        [
            lambda w: {"_c1": F.lag("close", 1).over(w), "_c5": F.lag("close", 5).over(w)},
            lambda w: {
                "corr_1": C.roll_corr("close", "_c1", w, 60, 20),
                "corr_5": C.roll_corr("close", "_c5", w, 60, 20),
            },
        ],
        back=65,
        keep=("corr_1", "corr_5"),
    )


@query(
    "rolling_by_running_sums",
    f"""{BARS}, s AS (SELECT *, ln(close) - {lag_sql('ln(close)')} AS r FROM bars), t AS (SELECT *, {lag_sql('r')} AS r1 FROM s)
    SELECT ts_code, date, {nums({'mean_20': f"round({roll_sql('avg', 'close', 20, 5)}, 3)",
    'std_60': roll_sql('stddev_samp', 'r', 60, 20), 'corr_1': corr_sql('r', 'r1', 60, 20)})} FROM t""",
)
def running(spark, sf):
    """The same figures at a cost per row that does not depend on the window."""
    return _series(
        spark,
        sf,
        [
            lambda w: {"r": C.diff(C.log(F.col("close")), w)} | C.window_sums("close20", "close", w, 20),
            lambda w: {"r1": F.lag("r").over(w), "mean_20": F.round(C.mean_of("close20", 5), 3)},
            lambda w: C.window_sums("r60", "r", w, 60, squares=True) | C.window_sums("ac", "r", w, 60, y="r1"),
            lambda w: {"std_60": C.std_of("r60", 20), "corr_1": C.corr_of("ac", 20)},
        ],
        back=62,
        keep=("mean_20", "std_60", "corr_1"),
    )


_LEVEL = "1e6::DOUBLE + close * 1e-6::DOUBLE"


@query(
    "rolling_on_levels",
    f"""{BARS}, s AS (SELECT ts_code, date, {_LEVEL} AS x FROM bars), t AS (SELECT *, {lag_sql('x')} AS x1 FROM s)
    SELECT ts_code, date, {nums({'mean_20': f"({roll_sql('avg', 'x - 1e6::DOUBLE', 20, 5)}) * 1000", 'std_60': f"{roll_sql('stddev_samp', 'x - 1e6::DOUBLE', 60, 20)} * 1000",
    'z': clip_sql(f"(x - 1e6::DOUBLE - {roll_sql('avg', 'x - 1e6::DOUBLE', 20, 5)}) / {roll_sql('stddev_samp', 'x - 1e6::DOUBLE', 60, 20)}", -10, 10),
    'corr_1': corr_sql('x - 1e6::DOUBLE', 'x1 - 1e6::DOUBLE', 60, 20)}, 5)} FROM t""",
    digits=5,
)
def on_levels(spark, sf):
    """Levels of a million that move by thousandths: sums from the first level keep the digits of the moves."""

    def moments(w):
        out = C.window_sums("m20", "x", w, 20, anchor="_at") | C.window_sums("s60", "x", w, 60, squares=True, anchor="_at")
        return out | C.window_sums("ac", "x", w, 60, y="x1", anchor="_at", y_anchor="_at")

    def derived(w):
        mean, std = C.mean_of("m20", 5, F.col("_at") - 1e6), C.std_of("s60", 20)
        z = C.clip((F.col("x") - 1e6 - mean) / std, -10, 10)
        return {"mean_20": mean * 1000, "std_60": std * 1000, "z": z, "corr_1": C.corr_of("ac", 20)}

    return _series(
        spark,
        sf,
        [
            lambda w: {"x": F.lit(1e6) + F.col("close") * 1e-6},
            lambda w: {"x1": F.lag("x").over(w), "_at": C.first_level("x", w)},
            moments,
            derived,
        ],
        back=62,
        keep=("mean_20", "std_60", "z", "corr_1"),
    )


@query(
    "rolling_zscore",
    f"""{BARS}, s AS (SELECT ts_code, date, close, {roll_sql('avg', 'close', 20, 6)} AS m,
      {roll_sql('stddev_samp', 'close', 60, 20)} AS sd FROM bars)
    SELECT ts_code, date, {nums({'z': clip_sql('(close - m) / greatest(sd, 1e-8) + 0 * sd', -10, 10)})} FROM s""",
)
def rolling_zscore(spark, sf):
    return _series(
        spark,
        sf,
        [
            lambda w: {"_m": C.roll_mean("close", w, 20, 6), "_sd": C.roll_std("close", w, 60, 20)},
            lambda w: {"z": C.zscore("close", "_m", "_sd")},
        ],
        back=60,
        keep=("z",),
    )


# ---- factor groups ----------------------------------------------------------------------------

LN2 = math.log(2)

MOMENTUM_STAGE = f"""
m1 AS (SELECT *, {', '.join(f"{e} AS {n}" for n, e in FORWARD_SQL.items())},
    {roll_sql('avg', 'close', 4, 2)} AS ma_4, {roll_sql('avg', 'close', 12, 4)} AS ma_12,
    {roll_sql('avg', 'close', 24, 8)} AS ma_24, close / {lag_sql('close', 4)} - 1 AS roc_4,
    close / {lag_sql('close', 12)} - 1 AS roc_12,
    {roll_sql('max', 'high', 20, 5)} AS ch_hi, {roll_sql('min', 'low', 20, 5)} AS ch_lo FROM %s)"""
MOMENTUM_COLS = nums(
    {n: f"round({n}, 3)" for n in ("ma_4", "ma_12", "ma_24")}
    | {n: n for n in (*FORWARD_SQL, "roc_4", "roc_12")}
    | {
        "ma12_dev": clip_sql("close / ma_12 - 1", -10, 10),
        "ma24_dev": clip_sql("close / ma_24 - 1", -10, 10),
        "ch_pos": clip_sql("(close - ch_lo) / greatest(ch_hi - ch_lo, 1e-8)", 0, 1),
    }
) + f", {flag_sql('close > ma_12')} AS above_ma12, {flag_sql('ma_4 > ma_12')} AS ma_cross_up"

VOLATILITY_STAGES = f"""
v1 AS (SELECT *, ln(close) - {lag_sql('ln(close)')} AS lr, {lag_sql('close')} AS pc FROM %s),
v2 AS (SELECT *, CASE WHEN pc IS NULL THEN high - low ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr,
    sqrt(ln(high / low) ** 2 / (4 * {LN2!r}::DOUBLE)) AS pk,
    sqrt(0.5::DOUBLE * ln(high / low) ** 2 - {2 * LN2 - 1!r}::DOUBLE * ln(close / open) ** 2) AS gk FROM v1),
v3 AS (SELECT *, {roll_sql('avg', 'pk', 20, 5)} AS vola_parkinson, {roll_sql('avg', 'gk', 20, 5)} AS vola_gk,
    {roll_sql('stddev_samp', 'lr', 20, 10)} AS vola_20, {roll_sql('stddev_samp', 'lr', 60, 20)} AS vola_60,
    {roll_sql('avg', 'tr', 14, 5)} AS atr FROM v2)"""
VOLATILITY_COLS = nums(
    {n: n for n in ("tr", "vola_parkinson", "vola_gk", "vola_20", "vola_60")}
    | {
        "atr_pct": clip_sql("atr / close", 0, 1),
        "vola_regime_ratio": clip_sql("vola_20 / greatest(vola_60, 1e-8) + 0 * vola_60", 0.1, 10),
    }
)
# Without amount or volume the same stages apply; a volatility index has no volume features.
VOLUME_STAGE = f"""
u1 AS (SELECT *, {roll_sql('avg', 'volume', 20, 5)} AS v20, {roll_sql('avg', 'volume', 60, 10)} AS v60 FROM %s)"""
VOLUME_COLS = (
    nums(
        {
            "vol_dev20": clip_sql("volume / v20 - 1", -5, 5),
            "vol_dev60": clip_sql("volume / v60 - 1", -5, 5),
        }
    )
    + f", {flag_sql('volume > v20 * 2')} AS vol_spike"
)
TRADED_COLS = nums(
    {
        "vwap_dev_1d": clip_sql("close / greatest(amount / (volume + 1e-8), 1e-6) - 1", -0.5, 0.5),
        "avg_trade_price": "greatest(amount / (volume + 1e-8), 1e-6)",
    }
)
STRUCTURE_STAGES = f"""
t1 AS (SELECT *, ln(close) - {lag_sql('ln(close)')} AS slr, {lag_sql('close')} AS spc,
    {roll_sql('max', 'high', 50, 10)} AS hi50, {roll_sql('min', 'low', 50, 10)} AS lo50 FROM %s),
t2 AS (SELECT *, slr - {lag_sql('slr')} AS dlr, {lag_sql('slr')} AS lr1, {lag_sql('slr', 5)} AS lr5 FROM t1),
t3 AS (SELECT *, {roll_sql('var_samp', 'dlr', 60, 20)} AS vd, {roll_sql('var_samp', 'slr', 60, 20)} AS vr,
    {corr_sql('slr', 'lr1', 60, 20)} AS ac_1, {corr_sql('slr', 'lr5', 60, 20)} AS ac_5 FROM t2)"""
STRUCTURE_COLS = nums(
    {
        "vr_2": clip_sql("vd / (2 * vr + 1e-9)", 0.1, 5),
        "ac_1": "ac_1",
        "ac_5": "ac_5",
        "near_high": clip_sql("close / hi50 - 1", -1, 0.5),
        "near_low": clip_sql("close / lo50 - 1", -0.5, 1),
        "gap": clip_sql("(open - spc) / greatest(spc, 1e-8) + 0 * spc", -0.2, 0.2),
    }
)
ALL_STAGES = (
    MOMENTUM_STAGE % "{src}" + "," + VOLATILITY_STAGES % "m1" + "," + VOLUME_STAGE % "v3" + "," + STRUCTURE_STAGES % "u1"
)
BEHAVIORAL_COLS = ", ".join([MOMENTUM_COLS, VOLATILITY_COLS, VOLUME_COLS, TRADED_COLS, STRUCTURE_COLS])


def _prices(df):
    """Averages on the scale of prices are compared to three digits."""
    return df.withColumns({c: F.round(c, 3) for c in ("ma_4", "ma_12", "ma_24") if c in df.columns})


def _group(name, stages, last, cols):
    @query(f"beh_{name}", f"{BARS}, {stages % 'bars'} SELECT date, ts_code, {cols} FROM {last}")
    def group(spark, sf):
        return _prices(behavioral.features(V.bars(spark, sf), [name]))


_group("momentum", MOMENTUM_STAGE, "m1", MOMENTUM_COLS)
_group("volatility", VOLATILITY_STAGES, "v3", VOLATILITY_COLS)
_group("volume", VOLUME_STAGE, "u1", f"{VOLUME_COLS}, {TRADED_COLS}")
_group("structure", STRUCTURE_STAGES, "t3", STRUCTURE_COLS)


@query("beh_metrics", f"{BARS}, {ALL_STAGES.format(src='bars')} SELECT date, ts_code, {BEHAVIORAL_COLS} FROM t3")
def beh_metrics(spark, sf):
    return _prices(market_features(V.bars(spark, sf)))


def _single(sql: str) -> str:
    """The same SQL over one series."""
    return sql.replace("PARTITION BY ts_code ", "")


@query(
    "beh_index",
    _single(
        f"{views('index_bars')}, {ALL_STAGES.format(src='index_bars')} SELECT date, "
        + ", ".join([MOMENTUM_COLS, VOLATILITY_COLS, VOLUME_COLS, STRUCTURE_COLS])
        + " FROM t3"
    ),
)
def beh_index(spark, sf):
    return _prices(behavioral.features(index_bars(V.index_raw(spark, sf)), by=None))


@query(
    "beh_qvix",
    _single(
        f"{views('qvix_bars')}, {MOMENTUM_STAGE % 'qvix_bars'}, {VOLATILITY_STAGES % 'm1'}, {STRUCTURE_STAGES % 'v3'} "
        f"SELECT date, {MOMENTUM_COLS}, {VOLATILITY_COLS}, {STRUCTURE_COLS}, NULL::DOUBLE AS vol_dev20, "
        "NULL::DOUBLE AS vol_dev60, NULL::TINYINT AS vol_spike, NULL::DOUBLE AS vwap_dev_1d, "
        "NULL::DOUBLE AS avg_trade_price FROM t3"
    ),
)
def beh_qvix(spark, sf):
    return _prices(behavioral.features(qvix_bars(V.qvix_raw(spark, sf)), by=None))


# ---- resampling and adjustment ----------------------------------------------------------------


def _resample_sql(period: str) -> str:
    return f"""{BARS} SELECT ts_code, date_trunc('{period}', date)::DATE AS period_start, max(date) AS date,
    {nums({'open': 'arg_min(open, date)', 'high': 'max(high)', 'low': 'min(low)', 'close': 'arg_max(close, date)',
    'volume': 'sum(volume)', 'amount': 'sum(amount)'}, 4)} FROM bars GROUP BY 1, 2"""


@query("bars_resample", _resample_sql("week"), digits=4)
def resample_week(spark, sf):
    return bars_resample(V.bars(spark, sf), "week")


@query("bars_resample_month", _resample_sql("month"), digits=4)
def resample_month(spark, sf):
    return bars_resample(V.bars(spark, sf), "month")


@query(
    "bars_adjust",
    views("bars", "statements")
    + f""", f AS (SELECT ts_code, report_period AS from_date, 1 + total_debt / total_revenue AS factor FROM statements)
    SELECT ts_code, date, {nums({c: f'{c} * coalesce(factor, 1)' for c in ('open', 'high', 'low', 'close')})},
    {nums(['volume', 'amount'])} FROM (SELECT bars.*, factor FROM bars ASOF LEFT JOIN f
    ON bars.ts_code = f.ts_code AND bars.date >= f.from_date)""",
)
def adjust(spark, sf):
    factors = V.statements(spark, sf).select(
        "ts_code",
        F.col("report_period").alias("date"),
        (1 + F.col("total_debt") / F.col("total_revenue")).alias("factor"),
    )
    return bars_adjust(V.bars(spark, sf), factors)
