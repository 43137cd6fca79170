"""Price, volatility, volume and structure factors of daily bars.

Groups work for stocks (keyed by ``ts_code``), an index or a volatility index (one series). Inputs must
hold one row per series and date. Optional columns (high, low, open, volume, amount) switch their
features off when absent. Windows never cross tickers.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import (
    clip,
    corr_of,
    diff,
    div,
    flag,
    forward_return,
    log,
    mean_of,
    pct_change,
    roll_max,
    roll_min,
    row_max,
    std_of,
    var_of,
    window_sums,
)
from .skew import MAX_GROUP_ROWS
from .staged import FeatureGroup, staged_metrics

# Horizons, in rows, of the forward returns.
FORWARD_HORIZONS = {"ret_1": 1, "ret_4": 4, "ret_12": 12, "ret_1m": 22, "ret_1q": 65, "ret_1y": 261}

# Moving-average window -> its minimum.
MEAN_WINDOWS = {4: 2, 12: 4, 24: 8}

# These look ahead: use them as labels, never as features.
LABEL_COLUMNS = tuple(FORWARD_HORIZONS)

_LN2 = math.log(2)


def _log_return(w):
    return {"_log_ret": diff(log(F.col("close")), w)}


def momentum(cols: Sequence[str]) -> FeatureGroup:
    """Forward returns, moving averages and their deviations, rate of change, channel position."""
    if "close" not in cols:
        return FeatureGroup()
    channel = "high" in cols and "low" in cols

    def base(w):
        out = {name: forward_return("close", w, n) for name, n in FORWARD_HORIZONS.items()}
        for n in MEAN_WINDOWS:
            out |= window_sums(f"close{n}", "close", w, n)
        out |= {f"roc_{n}": pct_change("close", w, n) for n in (4, 12)}
        if channel:
            out |= {"_ch_high": roll_max("high", w, 20, 5), "_ch_low": roll_min("low", w, 20, 5)}
        return out

    def averaged(w):
        return {f"ma_{n}": mean_of(f"close{n}", m) for n, m in MEAN_WINDOWS.items()}

    def derived(w):
        close = F.col("close")
        out = {f"ma{n}_dev": clip(div(close, F.col(f"ma_{n}")) - 1, -10, 10) for n in (12, 24)}
        if channel:
            width = clip(F.col("_ch_high") - F.col("_ch_low"), 1e-8)
            out["ch_pos"] = clip((close - F.col("_ch_low")) / width, 0, 1)
        else:
            out["ch_pos"] = F.lit(None).cast("double")
        out["above_ma12"] = flag(close > F.col("ma_12"))
        out["ma_cross_up"] = flag(F.col("ma_4") > F.col("ma_12"))
        return out

    names = (
        *FORWARD_HORIZONS, "ma_4", "ma_12", "ma_24", "ma12_dev", "ma24_dev",
        "roc_4", "roc_12", "ch_pos", "above_ma12", "ma_cross_up",
    )
    return FeatureGroup(names, (base, averaged, derived), ("close",), back=24, ahead=261)


def volatility(cols: Sequence[str]) -> FeatureGroup:
    """Parkinson, Garman-Klass and realised volatility, true range, short/long regime ratio."""
    if "close" not in cols:
        return FeatureGroup()
    ranged = "high" in cols and "low" in cols
    full = ranged and "open" in cols

    def base(w):
        out = _log_return(w)
        if ranged:
            high, low, last = F.col("high"), F.col("low"), F.lag("close").over(w)
            out["tr"] = row_max([high - low, F.abs(high - last), F.abs(low - last)])
            out["_hl"] = log(div(high, low)) * log(div(high, low))
            out["_range"] = F.sqrt(out["_hl"] / (4 * _LN2))
        if full:
            change = log(div(F.col("close"), F.col("open")))
            out["_gk"] = F.sqrt(0.5 * out["_hl"] - (2 * _LN2 - 1) * change * change)
        return out

    def summed(w):
        out = window_sums("ret20", "_log_ret", w, 20, squares=True)
        out |= window_sums("ret60", "_log_ret", w, 60, squares=True)
        if ranged:
            out |= window_sums("range20", "_range", w, 20) | window_sums("tr14", "tr", w, 14)
        if full:
            out |= window_sums("gk20", "_gk", w, 20)
        return out

    def rolled(w):
        out = {"vola_20": std_of("ret20", 10), "vola_60": std_of("ret60", 20)}
        if ranged:
            out["vola_parkinson"] = mean_of("range20", 5)
            out["atr_pct"] = clip(div(mean_of("tr14", 5), F.col("close")), 0, 1)
        if full:
            out["vola_gk"] = mean_of("gk20", 5)
        return out

    def derived(w):
        return {"vola_regime_ratio": clip(F.col("vola_20") / clip("vola_60", 1e-8), 0.1, 10)}

    names = (
        *(("tr", "vola_parkinson") if ranged else ()),
        *(("vola_gk",) if full else ()),
        "vola_20", "vola_60",
        *(("atr_pct",) if ranged else ()),
        "vola_regime_ratio",
    )
    return FeatureGroup(names, (base, summed, rolled, derived), ("close",), back=61, ahead=0)


VOLUME_OUTPUTS = ("vol_dev20", "vol_dev60", "vol_spike", "vwap_dev_1d", "avg_trade_price")


def volume(cols: Sequence[str]) -> FeatureGroup:
    """Volume against its own average, spikes, deviation from the average traded price.

    Without a volume column all outputs are null; an all-null column gives the same.
    """
    if "volume" not in cols:
        types = {c: "byte" if c == "vol_spike" else "double" for c in VOLUME_OUTPUTS}
        return FeatureGroup(VOLUME_OUTPUTS, (lambda w: {c: F.lit(None).cast(t) for c, t in types.items()},), back=0, ahead=0)
    traded = "amount" in cols and "close" in cols

    def base(w):
        return window_sums("vol20", "volume", w, 20) | window_sums("vol60", "volume", w, 60)

    def averaged(w):
        return {"_vol20": mean_of("vol20", 5), "_vol60": mean_of("vol60", 10)}

    def derived(w):
        v = F.col("volume")
        out = {
            "vol_dev20": clip(div(v, F.col("_vol20")) - 1, -5, 5),
            "vol_dev60": clip(div(v, F.col("_vol60")) - 1, -5, 5),
            "vol_spike": flag(v > F.col("_vol20") * 2),
        }
        if traded:
            price = clip(div(F.col("amount"), v + 1e-8), 1e-6)
            out["vwap_dev_1d"] = clip(F.col("close") / price - 1, -0.5, 0.5)
            out["avg_trade_price"] = price
        return out

    return FeatureGroup(VOLUME_OUTPUTS if traded else VOLUME_OUTPUTS[:3], (base, averaged, derived), ("volume",), back=60, ahead=0)


def structure(cols: Sequence[str]) -> FeatureGroup:
    """Variance ratio, autocorrelation of log returns, distance to highs and lows, opening gap."""
    if "close" not in cols:
        return FeatureGroup()

    def base(w):
        out = _log_return(w)
        if "high" in cols:
            out["_high50"] = roll_max("high", w, 50, 10)
        if "low" in cols:
            out["_low50"] = roll_min("low", w, 50, 10)
        if "open" in cols:
            out["_prev_close"] = F.lag("close").over(w)
        return out

    def lagged(w):
        return {
            "_ret_diff": diff("_log_ret", w),
            "_ret_lag1": F.lag("_log_ret", 1).over(w),
            "_ret_lag5": F.lag("_log_ret", 5).over(w),
        }

    def summed(w):
        out = window_sums("diff60", "_ret_diff", w, 60, squares=True)
        out |= window_sums("ret60", "_log_ret", w, 60, squares=True)
        for k in (1, 5):
            out |= window_sums(f"ac{k}", "_log_ret", w, 60, y=f"_ret_lag{k}")
        return out

    def derived(w):
        close = F.col("close")
        out = {"vr_2": clip(var_of("diff60", 20) / (2 * var_of("ret60", 20) + 1e-9), 0.1, 5)}
        out |= {f"ac_{k}": corr_of(f"ac{k}", 20) for k in (1, 5)}
        if "high" in cols:
            out["near_high"] = clip(div(close, F.col("_high50")) - 1, -1, 0.5)
        if "low" in cols:
            out["near_low"] = clip(div(close, F.col("_low50")) - 1, -0.5, 1)
        if "open" in cols:
            prev = F.col("_prev_close")
            out["gap"] = clip((F.col("open") - prev) / clip(prev, 1e-8), -0.2, 0.2)
        return out

    names = ("vr_2", "ac_1", "ac_5") + tuple(
        n for n, c in (("near_high", "high"), ("near_low", "low"), ("gap", "open")) if c in cols
    )
    return FeatureGroup(names, (base, lagged, summed, derived), ("close",), back=66, ahead=0)


GROUPS = {"momentum": momentum, "volatility": volatility, "volume": volume, "structure": structure}


def features(
    df: DataFrame,
    groups: Sequence[str] = tuple(GROUPS),
    *,
    by: str | None = "ts_code",
    idents: Sequence[str] = ("ts_code", "name"),
    max_rows: int | None = MAX_GROUP_ROWS,
) -> DataFrame:
    """Date, the identifiers present, and the features of the chosen groups.

    ``by=None`` treats the frame as one series (index, volatility index). A frame without a date column
    has nothing to compute and is an error. With a calendar date as key a series has at most 366 rows a year, so unless
    ``max_rows`` is set lower its size is not checked.
    """
    if "date" not in df.columns:
        raise ValueError("bars need a date column")
    if isinstance(df.schema["date"].dataType, T.DateType) and max_rows == MAX_GROUP_ROWS:
        max_rows = None
    keep = dict.fromkeys(["date", *([by] if by else []), *[c for c in idents if c in df.columns]])
    return staged_metrics(
        df,
        [GROUPS[g](df.columns) for g in groups],
        list(keep),
        "select",
        by=[by] if by else [],
        order=["date"],
        max_rows=max_rows,
    )
