"""Numeric column helpers shared by all factor groups.

Arithmetic follows IEEE-754 (``x/0`` is infinite, ``ln(0)`` is ``-inf``) rather than Spark's ANSI
errors, nulls propagate, and a rolling value is null until its frame holds ``min_samples`` non-null
inputs (NaN counts as a value).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

INF = float("inf")
NAN = float("nan")


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_missing(c: Column) -> Column:
    return c.isNull() | F.isnan(c)


def nan_to_null(c: str | Column) -> Column:
    c = as_col(c)
    return F.when(~F.isnan(c), c)


def div(n: Column, d: Column) -> Column:
    """IEEE division: a zero denominator gives +-inf (or NaN for 0/0) instead of an error."""
    return F.when(d == 0, n * F.lit(INF)).otherwise(F.try_divide(n, d))


def log(c: Column) -> Column:
    """Natural log with ``-inf`` at zero and NaN below it."""
    return F.when(c > 0, F.ln(c)).when(c == 0, F.lit(-INF)).when(c < 0, F.lit(NAN))


def clip(c: str | Column, lo: float | Column | None = None, hi: float | Column | None = None) -> Column:
    """Bound ``c``; nulls and NaN pass through, a null bound leaves the value unbounded on that side."""
    if isinstance(c, Column) and not isinstance(lo, Column) and not isinstance(hi, Column):
        return with_value(c, lambda v: _clip(v, lo, hi))  # an expression is evaluated once, not in each branch
    return _clip(as_col(c), lo, hi)


def _clip(c: Column, lo: float | Column | None, hi: float | Column | None) -> Column:
    out = c
    if lo is not None:
        out = F.greatest(out, lo if isinstance(lo, Column) else F.lit(float(lo)))
    if hi is not None:
        out = F.least(out, hi if isinstance(hi, Column) else F.lit(float(hi)))
    return F.when(is_missing(c), c).otherwise(out)


def flag(cond: Column) -> Column:
    """0/1 byte; null where the comparison is null."""
    return cond.cast("byte")


def safe_div(
    num: str | Column,
    den: str | Column,
    *,
    min_den: float = 1e-6,
    negative: str = "null",
    fill: float | None = None,
) -> Column:
    """``num / max(den, min_den)``.

    ``negative`` says what a denominator <= 0 means: ``"null"`` gives null, ``"abs"`` divides by its
    magnitude, ``"keep"`` clamps it to ``min_den`` (a very large ratio, kept as the source defines it).
    ``fill`` replaces null results.
    """
    n, d = as_col(num), as_col(den)
    if negative not in ("null", "abs", "keep"):
        raise ValueError(f"negative must be null, abs or keep, not {negative!r}")
    guarded = clip(F.abs(d) if negative == "abs" else d, min_den)
    out = n / guarded
    if negative == "null":
        out = F.when(d <= 0, F.lit(None).cast("double")).otherwise(out)
    return out if fill is None else F.coalesce(out, F.lit(float(fill)))


def safe_ratio(
    num: str | Column, den: str | Column, *, min_den: float = 1e-6, lo: float = 0.0, hi: float | None = None
) -> Column:
    """Ratio over a denominator floored at ``min_den``, clipped to ``[lo, hi]``."""
    return clip(as_col(num) / clip(den, min_den), lo, hi)


def with_value(c: str | Column, of: Callable[[Column], Column]) -> Column:
    """``of(c)`` with ``c`` evaluated once per row, however often ``of`` uses it."""
    return F.get(F.transform(F.array(as_col(c)), of), F.lit(0))


# ---- horizontal reductions --------------------------------------------------------------------


def row_max(cols: Iterable[str | Column]) -> Column:
    cols = [as_col(c) for c in cols]
    return cols[0] if len(cols) == 1 else F.greatest(*cols)


def row_mean(cols: Iterable[str | Column]) -> Column:
    """Mean of the non-null columns of a row; null when all are null."""
    cols = [as_col(c).cast("double") for c in cols]
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cols[1:]), F.coalesce(cols[0], F.lit(0.0)))
    n = sum((c.isNotNull().cast("int") for c in cols[1:]), cols[0].isNotNull().cast("int"))
    return F.when(n > 0, F.try_divide(total, n))


def row_any(cols: Iterable[str | Column]) -> Column:
    """Three-valued OR over the columns as booleans (non-zero is true), as a 0/1 byte."""
    cols = [as_col(c).cast("boolean") for c in cols]
    out = cols[0]
    for c in cols[1:]:
        out = out | c
    return flag(out)


def row_std(cols: Sequence[str | Column]) -> Column:
    """Sample standard deviation over the non-null columns of a row; null below two values."""
    vals = F.filter(F.array(*[as_col(c).cast("double") for c in cols]), lambda v: v.isNotNull())
    n = F.size(vals)
    mean = F.try_divide(F.aggregate(vals, F.lit(0.0), lambda a, v: a + v), n)
    ss = F.aggregate(vals, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean))
    return F.when(n > 1, F.sqrt(F.try_divide(ss, n - 1)))


# ---- windows over an ordered series -----------------------------------------------------------


def trailing(w: WindowSpec, n: int) -> WindowSpec:
    """The last ``n`` rows up to and including the current one."""
    return w.rowsBetween(-(n - 1), 0)


def before(w: WindowSpec, n: int) -> WindowSpec:
    """Everything up to and including the row ``n`` rows ago."""
    return w.rowsBetween(Window.unboundedPreceding, -n)


def window_count(x: str | Column, w: WindowSpec, n: int) -> Column:
    """Non-null values among the last ``n`` rows, as the difference of two running counts."""
    x = as_col(x)
    return F.count(x).over(before(w, 0)) - F.count(x).over(before(w, n))


def roll(agg: Callable[[Column], Column], x: str | Column, w: WindowSpec, n: int, min_samples: int) -> Column:
    """``agg`` over the last ``n`` rows. Every frame is evaluated afresh: exact, at a cost of ``n`` per row."""
    x = as_col(x)
    return F.when(window_count(x, w, n) >= min_samples, agg(x).over(trailing(w, n)))


def roll_mean(x, w, n, min_samples) -> Column:
    return roll(F.avg, x, w, n, min_samples)


def roll_std(x, w, n, min_samples) -> Column:
    return roll(F.stddev_samp, x, w, n, min_samples)


def roll_var(x, w, n, min_samples) -> Column:
    return roll(F.var_samp, x, w, n, min_samples)


def roll_min(x, w, n, min_samples) -> Column:
    return roll(F.min, x, w, n, min_samples)


def roll_max(x, w, n, min_samples) -> Column:
    return roll(F.max, x, w, n, min_samples)


# ---- the same from running sums ---------------------------------------------------------------
#
# A difference of two running sums costs the same per row whatever the window. ``window_sums`` gives the
# differences as columns for one stage; ``mean_of``, ``var_of``, ``std_of`` and ``corr_of`` combine them in
# a later one, so that no sum is evaluated twice.
#
# The sums cover finite values only; a window holding a NaN or infinity is NaN. Rounding errors are
# relative to the running sum: negligible for means, and for moments of returns, whose size does not
# drift and which are exactly zero while a price rests. Levels (prices, balances) are large against their moves: sum
# them as differences from an ``anchor``, the first value of the series, staged ahead. What then counts is how far a
# level has moved since, not how high it is.


def _finite(x: Column) -> Column:
    return F.when((x - x) == 0, x)


def first_level(x: str | Column, w: WindowSpec) -> Column:
    """First finite value of the series up to each row: an anchor for ``window_sums`` of a later stage."""
    return F.first(_finite(as_col(x)), ignorenulls=True).over(before(w, 0))


def _less(x: Column, anchor: str | Column | None) -> Column:
    return x if anchor is None else x - as_col(anchor)


def window_sums(
    name: str,
    x: str | Column,
    w: WindowSpec,
    n: int,
    *,
    squares: bool = False,
    y: str | Column | None = None,
    anchor: str | Column | None = None,
    y_anchor: str | Column | None = None,
) -> dict[str, Column]:
    """Columns ``_<name>_n`` (values), ``_ok`` (finite ones), ``_x`` (sum) and, as asked, ``_xx``; with ``y``
    the same over complete pairs, plus ``_y``, ``_yy`` and ``_xy``. With an ``anchor`` (see ``first_level``; ``y_anchor`` for
    ``y``) the sums are of differences from it: give it to ``mean_of``, too."""
    x = as_col(x)
    if y is not None:
        y = as_col(y)
        both = x + y
        fx, fy = (F.when(_finite(both).isNotNull(), _less(v, a)) for v, a in ((x, anchor), (y, y_anchor)))
        parts = {"x": fx, "xx": fx * fx, "y": fy, "yy": fy * fy, "xy": fx * fy}
    else:
        both, fx = x, _less(_finite(x), anchor)
        parts = {"x": fx} | ({"xx": fx * fx} if squares else {})
    upto, left, zero = before(w, 0), before(w, n), F.lit(0.0)
    out = {}
    for k, v in {"n": both, "ok": _finite(both)}.items():
        agg = F.count(v)
        out[f"_{name}_{k}"] = agg.over(upto) - agg.over(left)
    for k, v in parts.items():
        agg = F.sum(v)
        # The older sum is null at the start of a series.
        out[f"_{name}_{k}"] = F.coalesce(agg.over(upto) - agg.over(left), agg.over(upto), zero)
    return out


def _gated(name: str, value: Column, min_samples: int) -> Column:
    have, ok = F.col(f"_{name}_n"), F.col(f"_{name}_ok")
    return F.when(have >= min_samples, F.when(ok < have, F.lit(NAN)).otherwise(value))


def mean_of(name: str, min_samples: int, anchor: str | Column | None = None) -> Column:
    mean = F.try_divide(F.col(f"_{name}_x"), F.col(f"_{name}_n"))
    return _gated(name, mean if anchor is None else mean + as_col(anchor), min_samples)


def _moment(name: str, a: str, b: str) -> Column:
    sums = F.col(f"_{name}_{a}") * F.col(f"_{name}_{b}")
    out = F.col(f"_{name}_{a}{b}") - F.try_divide(sums, F.col(f"_{name}_n"))
    return F.greatest(out, F.lit(0.0)) if a == b else out


def var_of(name: str, min_samples: int) -> Column:
    """Sample variance."""
    return _gated(name, F.try_divide(_moment(name, "x", "x"), F.col(f"_{name}_n") - 1), max(min_samples, 2))


def std_of(name: str, min_samples: int) -> Column:
    return F.sqrt(var_of(name, min_samples))


def corr_of(name: str, min_samples: int) -> Column:
    """Pearson correlation; NaN where a side does not vary."""
    spread = F.sqrt(_moment(name, "x", "x") * _moment(name, "y", "y"))
    return _gated(name, clip(div(_moment(name, "x", "y"), spread), -1, 1), min_samples)


def nearest_index(n: Column, q: float) -> Column:
    """Zero-based index of the q-quantile of ``n`` sorted values, nearest rank."""
    return F.round((n - 1) * F.lit(float(q))).cast("int")


def roll_quantile(x, w: WindowSpec, n: int, q: float, min_samples: int) -> Column:
    """Nearest-rank quantile of the frame; the frame bounds the list to ``n`` values."""
    x, frame = as_col(x), trailing(w, n)
    vals = F.sort_array(F.collect_list(x).over(frame))
    return F.when(F.size(vals) >= min_samples, F.get(vals, nearest_index(F.size(vals), q)))


def roll_corr(x, y, w: WindowSpec, n: int, min_samples: int) -> Column:
    """Pearson correlation over the complete pairs of the frame."""
    x, y = as_col(x), as_col(y)
    pairs = window_count(F.when(x.isNotNull() & y.isNotNull(), 1), w, n)
    return F.when(pairs >= min_samples, F.corr(x, y).over(trailing(w, n)))


def zscore(x: str | Column, mean: str | Column, std: str | Column, bound: float = 10.0) -> Column:
    """``(x - mean) / max(std, 1e-8)``, clipped to ``+-bound``; moments are usually staged columns."""
    return clip((as_col(x) - as_col(mean)) / clip(std, 1e-8), -bound, bound)


def diff(x: str | Column, w: WindowSpec, n: int = 1) -> Column:
    return as_col(x) - F.lag(as_col(x), n).over(w)


def pct_change(x: str | Column, w: WindowSpec, n: int = 1) -> Column:
    return div(as_col(x), F.lag(as_col(x), n).over(w)) - 1


def forward_return(x: str | Column, w: WindowSpec, n: int) -> Column:
    """Return over the next ``n`` rows: look-ahead by design, a label and never a feature."""
    return div(F.lead(as_col(x), n).over(w), as_col(x)) - 1


# ---- inverse normal ---------------------------------------------------------------------------

# Coefficients of P. J. Acklam's published rational approximation of the inverse normal.
PROBIT_A = (
    -3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
    1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00,
)
PROBIT_B = (
    -5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
    6.680131188771972e01, -1.328068155288572e01,
)
PROBIT_C = (
    -7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
    -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00,
)
PROBIT_D = (
    7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00,
)
PROBIT_TAIL = 0.02425


def _poly(coefs: Sequence[float], x: Column) -> Column:
    out = F.lit(coefs[0])
    for c in coefs[1:]:
        out = out * x + F.lit(c)
    return out


def probit(p: str | Column) -> Column:
    """Inverse of the standard normal distribution (absolute error below 1e-8)."""
    p = as_col(p)
    q = p - 0.5
    centre = _poly(PROBIT_A, q * q) * q / _poly((*PROBIT_B, 1.0), q * q)

    def tail(mass: Column) -> Column:
        t = F.sqrt(-2 * log(mass))
        return _poly(PROBIT_C, t) / _poly((*PROBIT_D, 1.0), t)

    return (
        F.when((p <= 0) | (p >= 1), F.lit(None).cast("double"))
        .when(p < PROBIT_TAIL, tail(p))
        .when(p > 1 - PROBIT_TAIL, -tail(1 - p))
        .otherwise(centre)
    )
