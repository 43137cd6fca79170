"""Time-ordered train/test splits without leakage.

Fold bounds are computed on the distinct dates (bounded by the calendar). A fold is a pair of date intervals, so the
folds of a row follow from its date; no data row passes through the driver or a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .skew import durable


def purged_time_split(
    df: DataFrame,
    split_date: date,
    *,
    horizon_days: int = 0,
    embargo_days: int = 0,
    date_col: str = "date",
    label_end_col: str | None = None,
    check: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Train before ``split - horizon`` (labels ending before it too), test from ``split + embargo`` on.

    ``check`` runs one narrow aggregate and raises if a side is empty.
    """
    cutoff = F.lit(split_date - timedelta(days=horizon_days))
    is_train = F.col(date_col) < cutoff
    if label_end_col:
        is_train = is_train & (F.col(label_end_col) < cutoff)
    is_test = F.col(date_col) >= F.lit(split_date + timedelta(days=embargo_days))
    if check:
        n_train, n_test = df.agg(F.count_if(is_train), F.count_if(is_test)).first()
        if not n_train or not n_test:
            raise ValueError(f"empty split: {n_train} training rows, {n_test} test rows")
    return df.where(is_train), df.where(is_test)


def _rows_per_day(df: DataFrame, date_col: str, label_end_col: str | None) -> DataFrame:
    """Rows per date (and end of label), computed once: all that fold bounds and sizes depend on."""
    if not isinstance(df.schema[date_col].dataType, T.DateType):
        raise ValueError(f"{date_col} must be a DATE column, so that the calendar bounds its values")
    ends = F.col(label_end_col).cast("date") if label_end_col else F.lit(None).cast("date")
    rows = df.where(F.col(date_col).isNotNull()).groupBy(F.col(date_col).alias("_day"), ends.alias("_end"))
    return durable(rows.agg(F.count(F.lit(1)).alias("_rows")))


@dataclass(frozen=True)
class Fold:
    """Dates of one fold: train on ``[train_from, cutoff)``, test on ``[test_from, test_to]``."""

    fold: int
    train_from: date
    cutoff: date
    test_from: date
    test_to: date


def _halved(at: Column, cuts: list[date], values: list[Column]) -> Column:
    """The value of the interval that holds ``at``: ``values[0]`` before ``cuts[0]``, ``values[i + 1]`` from ``cuts[i]`` on."""
    if not cuts:
        return values[0]
    m = len(cuts) // 2
    later = _halved(at, cuts[m + 1 :], values[m + 1 :])
    return F.when(at >= F.lit(cuts[m]), later).otherwise(_halved(at, cuts[:m], values[: m + 1]))


@dataclass(frozen=True)
class Folds:
    """Folds as date intervals. What a row belongs to is an expression of its date, so rows are neither joined nor copied."""

    spans: tuple[Fold, ...]
    date_col: str = "date"
    label_end_col: str | None = None

    def in_train(self, f: Fold) -> Column:
        hit = (F.col(self.date_col) >= F.lit(f.train_from)) & (F.col(self.date_col) < F.lit(f.cutoff))
        return hit & (F.col(self.label_end_col) < F.lit(f.cutoff)) if self.label_end_col else hit

    def in_test(self, f: Fold) -> Column:
        return F.col(self.date_col).between(F.lit(f.test_from), F.lit(f.test_to))

    def memberships(self) -> Column:
        """``array<struct<fold, role>>`` of a row, in fold order; empty for rows in no fold.

        Between two neighbouring bounds of folds all dates belong to the same ones, so these are constants, found by
        halving; only ends of labels, where they matter, are compared row by row.
        """
        after = [f.test_to + timedelta(days=1) for f in self.spans if f.test_to < date.max]
        cuts = sorted({c for f in self.spans for c in (f.train_from, f.cutoff, f.test_from)} | set(after))
        kind = f"struct<fold: int, role: string{', until: date' if self.label_end_col else ''}>"

        def constant(at: date) -> Column:
            """The folds of all days from ``at`` to the next cut, with the day that ends of labels have to come before."""
            each = []
            for f in self.spans:
                role = "test" if f.test_from <= at <= f.test_to else "train" if f.train_from <= at < f.cutoff else None
                until = f", 'until', {f"DATE '{f.cutoff}'" if role == 'train' else 'CAST(NULL AS DATE)'}" if self.label_end_col else ""
                each += [f"named_struct('fold', {f.fold}, 'role', '{role}'{until})"] if role else []
            return F.expr(f"CAST(array({', '.join(each)}) AS array<{kind}>)")

        found = _halved(F.col(self.date_col), cuts, [F.expr(f"CAST(array() AS array<{kind}>)"), *map(constant, cuts)])
        if not self.label_end_col:
            return found
        holds = F.filter(found, lambda m: m["until"].isNull() | (F.col(self.label_end_col) < m["until"]))
        return F.transform(holds, lambda m: F.struct(m["fold"].alias("fold"), m["role"].alias("role")))

    def tag(self, df: DataFrame, name: str = "folds") -> DataFrame:
        """Every row once, with its memberships."""
        return df.withColumn(name, self.memberships())

    def expand(self, df: DataFrame) -> DataFrame:
        """Rows tagged ``fold`` and ``role``, one copy for each fold a row belongs to."""
        return self.tag(df, "_folds").select(F.inline("_folds"), *df.columns)


def _spans(
    per_day: DataFrame,
    bounds: list[tuple[int, int, int, int]],
    date_col: str,
    gap_days: int,
    label_end_col: str | None,
    min_train_size: int,
) -> Folds:
    """Dates of ``bounds``: (fold, first train index, first test index, end of test), in numbers of distinct dates.

    A fold with too few training rows is an error. Only the bounding dates and one count per fold reach the driver.
    """
    # At most one row per calendar day, so one window.
    days = per_day.select("_day").distinct().withColumn("_i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_day")) - 1)
    wanted = sorted({i for _, a, b, c in bounds for i in (a, b, c - 1)})
    at = {r["_i"]: r["_day"] for r in days.where(F.col("_i").isin(wanted)).collect()}
    spans = [Fold(k, at[a], at[b] - timedelta(days=gap_days), at[b], at[c - 1]) for k, a, b, c in bounds]
    by_day = Folds(tuple(spans), "_day", "_end" if label_end_col else None)
    sizes = per_day.agg(*[F.sum(F.when(by_day.in_train(f), F.col("_rows"))).alias(f"_{f.fold}") for f in spans]).first()
    small = {f.fold: sizes[f"_{f.fold}"] or 0 for f in spans if (sizes[f"_{f.fold}"] or 0) < min_train_size}
    if small:
        raise ValueError(f"training rows per fold {small}, fewer than {min_train_size}")
    return Folds(tuple(spans), date_col, label_end_col)


def kfold_spans(
    df: DataFrame,
    n_splits: int = 5,
    *,
    horizon_days: int = 0,
    embargo_days: int = 0,
    min_train_size: int = 1,
    date_col: str = "date",
    label_end_col: str | None = None,
) -> Folds:
    """``n_splits`` forward folds.

    The dates are cut into ``n_splits + 1`` equal blocks (the last takes the remainder); fold *k* tests
    on block *k + 1* and trains on what lies before ``test start - (horizon + embargo)`` calendar days. It is an error
    if there are too few dates, or if a fold would train on fewer than ``min_train_size`` rows.
    """
    per_day = _rows_per_day(df, date_col, label_end_col)
    n = per_day.select("_day").distinct().count()
    size = n // (n_splits + 1)
    if size < 1:
        raise ValueError(f"Not enough unique dates: {n} for {n_splits} splits")
    bounds = [(k, 0, (k + 1) * size, (k + 2) * size if k < n_splits - 1 else n) for k in range(n_splits)]
    return _spans(per_day, bounds, date_col, horizon_days + embargo_days, label_end_col, min_train_size)


def walk_forward_spans(
    df: DataFrame,
    n_windows: int | None = 5,
    *,
    window_size: int | None = None,
    step_size: int | None = None,
    horizon_days: int = 0,
    embargo_days: int = 0,
    min_train_size: int = 1,
    expanding: bool = False,
    date_col: str = "date",
    label_end_col: str | None = None,
) -> Folds:
    """``n_windows`` windows moving forward by ``step_size`` dates.

    A window trains on ``window_size`` dates (or on everything so far, if ``expanding``) and tests on the
    next ``step_size`` dates, minus the horizon and embargo. By default the dates are divided evenly, and dates beyond
    the last whole window (fewer than there are windows) are not tested. It is an error if the dates do not hold so
    many whole windows, or if one would train on fewer than ``min_train_size`` rows.
    ``n_windows=None`` takes all whole windows that there are, and the last also tests on the dates that remain.
    """
    if n_windows is None and not window_size:
        raise ValueError("give n_windows or window_size")
    per_day = _rows_per_day(df, date_col, label_end_col)
    n = per_day.select("_day").distinct().count()
    window = window_size or n // (n_windows + 1)
    step = step_size or window
    whole = (n - window) // step if window else 0
    count = whole if n_windows is None else n_windows
    if not 1 <= count <= whole:
        raise ValueError(f"Not enough unique dates: {n} for {count} windows of {window} + {step}")
    bounds = [(k, 0 if expanding else k * step, k * step + window, k * step + window + step) for k in range(count)]
    if n_windows is None:
        bounds[-1] = (*bounds[-1][:3], n)
    return _spans(per_day, bounds, date_col, horizon_days + embargo_days, label_end_col, min_train_size)


def purged_kfold(df: DataFrame, n_splits: int = 5, **options) -> DataFrame:
    """The folds of ``kfold_spans`` as rows tagged ``(fold, role)``: a row is copied for each fold it belongs to.

    ``kfold_spans(df, ...).tag(df)`` keeps every row once.
    """
    return kfold_spans(df, n_splits, **options).expand(df)


def walk_forward(df: DataFrame, n_windows: int | None = 5, **options) -> DataFrame:
    """The windows of ``walk_forward_spans`` as rows tagged ``(fold, role)``: a row is copied for each fold it belongs to."""
    return walk_forward_spans(df, n_windows, **options).expand(df)


def folds(tagged: DataFrame) -> Iterator[tuple[int, DataFrame, DataFrame]]:
    """(fold, train, test) per fold of a tagged frame, in fold order."""
    for row in tagged.select("fold").distinct().orderBy("fold").collect():  # one row per fold
        part = tagged.where(F.col("fold") == row["fold"])
        yield row["fold"], *(part.where(F.col("role") == r).drop("fold", "role") for r in ("train", "test"))


def fold_sizes(tagged: DataFrame) -> DataFrame:
    """Training and test rows of each fold."""
    of = {r: F.count_if(F.col("role") == r).alias(f"n_{r}") for r in ("train", "test")}
    return tagged.groupBy("fold").agg(of["train"], of["test"])
