"""Scoring, ranking and evaluation."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .skew import MAX_GROUP_ROWS, durable, row_position, shared_dir
from .splits import Folds, folds


def rank_scores(
    df: DataFrame, score: str = "predict_score", date_col: str = "date", *, max_rows: int | None = MAX_GROUP_ROWS
) -> DataFrame:
    """Add ``rank`` (1 = best) per date. Nulls rank last; equal scores are ordered by ts_code.

    Sort by ``(date, rank)`` at the sink to list the best names of each day.
    """
    keyed = df.withColumn("_last", F.col(score).isNull()).withColumn("_down", -F.col(score))
    return row_position(keyed, [date_col], ["_last", "_down", "ts_code"], "rank", max_rows=max_rows).drop(
        "_last", "_down"
    )


def topk_per_rebalance(
    df: DataFrame,
    score: str = "predict_score",
    *,
    top_k: int = 50,
    max_weight: float = 0.05,
    period: str = "month",
    date_col: str = "date",
) -> DataFrame:
    """The ``top_k`` names on the last date of each period, equally weighted up to ``max_weight``.

    Spark prunes to the best ``top_k`` rows in every task before the shuffle.
    """
    p = F.trunc(date_col, period)
    last = df.groupBy(p.alias("_period")).agg(F.max(date_col).alias("_day"))
    # One row per period of the calendar.
    on_day = df.join(last.select("_day"), F.col(date_col) == F.col("_day"), "left_semi")
    w = Window.partitionBy(date_col).orderBy(F.col(score).desc_nulls_last(), "ts_code")
    best = on_day.where(F.col(score).isNotNull()).withColumn("rank", F.row_number().over(w)).where(
        F.col("rank") <= top_k
    )
    held = Window.partitionBy(date_col)  # at most top_k rows each
    weight = F.least(F.lit(1.0) / F.count(F.lit(1)).over(held), F.lit(float(max_weight)))
    return best.select(date_col, "ts_code", score, "rank", weight.alias("weight"))


# Ensemble weights per horizon.
DEFAULT_BLEND = {"20d": 0.3, "60d": 0.4, "252d": 0.3}


def blend_scores(
    frames: Mapping[str, DataFrame],
    weights: Mapping[str, float] = DEFAULT_BLEND,
    score: str = "predict_score",
    keys: Sequence[str] = ("date", "ts_code"),
) -> DataFrame:
    """Weighted sum of the scores of several horizons, for rows scored by all of them."""
    keys = list(keys)
    parts = [frames[h].select(*keys, F.col(score).alias(f"_{h}")) for h in weights]
    joined = reduce(lambda a, b: a.join(b, keys), parts)
    total = reduce(lambda a, b: a + b, [F.col(f"_{h}") * w for h, w in weights.items()])
    return joined.select(*keys, total.alias(score))


def ndcg_at_k(
    df: DataFrame,
    score: str = "predict_score",
    label: str = "label",
    ks: Sequence[int] = (5, 10, 20),
    date_col: str = "date",
    tie_break: str = "ts_code",
) -> DataFrame:
    """NDCG at each cut-off per date, gain ``2^label - 1``; 1 for a date without any gain.

    Only the best ``max(ks)`` rows per date, by score and by label, leave a task.
    """
    top = max(ks)
    rows = df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).select(
        F.col(date_col), F.col(score).alias("_s"), F.col(label).cast("double").alias("_l"), F.col(tie_break).alias("_t")
    )

    def gains(order: str, prefix: str) -> DataFrame:
        w = Window.partitionBy(date_col).orderBy(F.col(order).desc(), "_t")
        best = rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top)
        gain = (F.pow(F.lit(2.0), F.col("_l")) - 1) / F.log2(F.col("_r") + 1.0)
        return best.groupBy(date_col).agg(
            *[F.sum(F.when(F.col("_r") <= k, gain)).alias(f"{prefix}{k}") for k in ks]
        )

    # Both sides hold one row per date.
    both = gains("_s", "_dcg").join(gains("_l", "_idcg"), date_col)
    return both.select(
        date_col,
        *[F.when(F.col(f"_idcg{k}") > 0, F.col(f"_dcg{k}") / F.col(f"_idcg{k}")).otherwise(1.0).alias(f"ndcg_{k}") for k in ks],
    )


def score_linear(df: DataFrame, weights: Mapping[str, float], score: str = "predict_score") -> DataFrame:
    """Weighted sum of features, missing values counting as 0."""
    total = reduce(lambda a, b: a + b, [F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0)) * w for c, w in weights.items()])
    return df.withColumn(score, total)


def score_model(df: DataFrame, model: PipelineModel, score: str = "predict_score") -> DataFrame:
    """Apply a fitted ``pyspark.ml`` pipeline; its prediction becomes ``score``."""
    scored = model.transform(df)
    return scored.select(*df.columns, F.col("prediction").alias(score))


def regression_pipeline(features: Sequence[str], label: str, regressor=None) -> Pipeline:
    """Impute, assemble and regress (gradient-boosted trees unless given another regressor)."""
    filled = [f"_f_{f}" for f in features]
    return Pipeline(
        stages=[
            Imputer(inputCols=list(features), outputCols=filled, strategy="median"),
            VectorAssembler(inputCols=filled, outputCol="_features", handleInvalid="keep"),
            (regressor or GBTRegressor(maxIter=10, maxDepth=3, seed=42)).copy().setParams(
                featuresCol="_features", labelCol=label
            ),
        ]
    )


def fit_trees_walk_forward(tagged: DataFrame, features: Sequence[str], label: str, regressor=None) -> DataFrame:
    """Fit one tree model (or another regressor) per window of a tagged frame (see ``splits``); metrics per window.

    Each fit is a distributed Spark ML job; only the metrics reach the driver.
    """
    usable = tagged.select("fold", "role", *features, label).where(F.col(label).isNotNull() & ~F.isnan(label))
    # A window reads its rows several times: they are computed once, and lie in a folder of their own, so that no pass reads
    # the rows of other windows.
    path = f"{shared_dir(tagged.sparkSession)}/windows-{uuid.uuid4().hex}"
    usable.write.partitionBy("fold", "role").parquet(path)
    usable = tagged.sparkSession.read.schema(usable.schema).parquet(path)
    miss = F.col("prediction") - F.col(label)
    rows = []
    for k, train, test in folds(usable):
        scored = regression_pipeline(features, label, regressor).fit(train).transform(test)
        n_test, rmse, mae = scored.agg(F.count(F.lit(1)), F.sqrt(F.avg(miss * miss)), F.avg(F.abs(miss))).first()
        rows.append((k, train.count(), n_test, rmse, mae))
    return tagged.sparkSession.createDataFrame(rows, "fold int, n_train long, n_test long, rmse double, mae double")


def daily_moments(df: DataFrame, of: Folds, features: Sequence[str], label: str) -> DataFrame:
    """Sufficient statistics of linear models per date (and end of label): ``n`` and the sums of all products of two of
    ``1``, the features and the label, as columns ``m_<i>_<j>`` with ``i <= j``.

    One aggregate, combined per task; the calendar bounds its rows, whatever the number of folds.
    """
    x = [F.lit(1.0), *[_filled(c) for c in features], F.col(label).cast("double")]
    keys = [of.date_col, *([of.label_end_col] if of.label_end_col else [])]
    products = {f"m_{i}_{j}": F.sum(x[i] * x[j]) for i in range(len(x)) for j in range(i, len(x))}
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[p.alias(name) for name, p in products.items()])


def _filled(c: str) -> Column:
    """A feature, missing values counting as 0."""
    return F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))


def ridge_walk_forward(df: DataFrame, of: Folds, features: Sequence[str], label: str, alpha: float = 1.0) -> dict[int, tuple[int, list[float]]]:
    """Ridge coefficients per fold (intercept first, not penalised), and the rows each was trained on.

    The moments of each fold are sums over its dates, taken anew for each fold: differences of running sums would lose the
    digits of quiet dates behind loud ones. They are some hundred numbers a fold, and all that reaches the driver.
    """
    size = len(features) + 2
    names = [f"m_{i}_{j}" for i in range(size) for j in range(i, size)]
    fold = F.explode(F.array_compact(F.array(*[F.when(of.in_train(f), F.lit(f.fold)) for f in of.spans])))
    sums = daily_moments(df, of, features, label).withColumn("_fold", fold).groupBy("_fold")
    out = {}
    for row in sums.agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in names]).collect():
        m = np.zeros((size, size))
        for i in range(size):
            for j in range(i, size):
                m[i, j] = m[j, i] = row[f"m_{i}_{j}"]
        penalty = np.diag([0.0] + [alpha] * len(features))
        out[row["_fold"]] = row["n"], np.linalg.solve(m[:-1, :-1] + penalty, m[:-1, -1]).tolist()
    return out


def fit_walk_forward(df: DataFrame, of: Folds, features: Sequence[str], label: str, alpha: float = 1.0) -> DataFrame:
    """A ridge model per fold: ``fold``, ``n_train``, ``n_test``, ``rmse``, ``mae``, ``intercept`` and ``w_<feature>``.

    All folds come from two passes over the rows, none of which is copied: one gathers moments per date, one scores each
    row with the model of the fold that tests it. Rows without a label are left out; missing features count as 0.
    Test intervals must not overlap. A fold without rows to train on has no model and no row; one without test rows
    has null errors.
    """
    rows = df.where(F.col(label).isNotNull() & ~F.isnan(label))
    models = ridge_walk_forward(rows, of, features, label, alpha)
    weights = {f.fold: models[f.fold][1] for f in of.spans if f.fold in models}
    schema = "fold int, n_train long, " + ", ".join(f"`{c}` double" for c in ("intercept", *[f"w_{c}" for c in features]))
    fitted = df.sparkSession.createDataFrame([(k, models[k][0], *w) for k, w in weights.items()], schema)
    if not weights:
        return fitted.select("fold", "n_train", *[F.lit(0).cast(t).alias(c) for c, t in (("n_test", "long"), ("rmse", "double"), ("mae", "double"))], *fitted.columns[2:])
    at = F.coalesce(*[F.when(of.in_test(f), F.lit(f.fold)) for f in of.spans if f.fold in weights])

    def weight(i: int) -> Column:
        return F.coalesce(*[F.when(F.col("fold") == k, F.lit(w[i])) for k, w in weights.items()])

    predicted = reduce(lambda a, b: a + b, [weight(0), *[weight(i + 1) * _filled(c) for i, c in enumerate(features)]])
    tested = rows.withColumn("fold", at).where(F.col("fold").isNotNull()).withColumn("_miss", predicted - F.col(label))
    errors = tested.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n_test"), F.sqrt(F.avg(F.col("_miss") * F.col("_miss"))).alias("rmse"), F.avg(F.abs("_miss")).alias("mae")
    )
    return fitted.join(errors, "fold", "left").select(
        "fold", "n_train", F.coalesce("n_test", F.lit(0)).alias("n_test"), "rmse", "mae", *fitted.columns[2:]
    )
