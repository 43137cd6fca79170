"""Labels, splits, scoring and evaluation."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import functions as F

from ..functions.columns import PROBIT_A, PROBIT_B, PROBIT_C, PROBIT_D, PROBIT_TAIL
from ..operators import evaluate, labels, splits
from ..operators.joins import join_industry
from .crosssection import industry
from .panel import LABELLED, labelled_panel, stored_panel
from .registry import flag_sql, nums, query, views

BASE = f"{views('bars')}, {LABELLED}"
FEATURES = ["roc_4", "roc_12", "ma12_dev", "vola_20"]

# ---- labels -----------------------------------------------------------------------------------


def _poly_sql(coefs, x):
    out = f"{coefs[0]!r}::DOUBLE"
    for c in coefs[1:]:
        out = f"({out} * {x} + {c!r}::DOUBLE)"
    return out


def _tail_sql(mass):
    t = f"sqrt(-2 * ln({mass}))"
    return f"{_poly_sql(PROBIT_C, t)} / {_poly_sql((*PROBIT_D, 1.0), t)}"


PROBIT_SQL = (
    f"CASE WHEN p < {PROBIT_TAIL} THEN {_tail_sql('p')} WHEN p > 1 - {PROBIT_TAIL} THEN -({_tail_sql('(1 - p)')}) ELSE "
    f"{_poly_sql(PROBIT_A, '((p - 0.5::DOUBLE) * (p - 0.5::DOUBLE))')} * (p - 0.5::DOUBLE) / "
    f"{_poly_sql((*PROBIT_B, 1.0), '((p - 0.5::DOUBLE) * (p - 0.5::DOUBLE))')} END"
)


def _gaussian_sql(src: str, by: str, limits) -> str:
    w = f"PARTITION BY {by}"
    if limits:
        lst = f"list_sort(list(ret_1m) OVER ({w}))"
        q = [f"{lst}[1 + round((len({lst}) - 1) * {x}::DOUBLE)::INT]" for x in limits]
        x = f"least(greatest(ret_1m, {q[0]}), {q[1]})"
    else:
        x = "ret_1m"
    return f"""g0 AS (SELECT *, {x} AS x FROM {src} WHERE ret_1m IS NOT NULL),
    g1 AS (SELECT *, (rank() OVER ({w} ORDER BY x) - 0.5::DOUBLE) / count(*) OVER ({w}) AS p FROM g0)
    SELECT ts_code, date, {nums({'label_ret_1m': PROBIT_SQL})} FROM g1"""


@query(
    "label_gaussian",
    f"""{views('bars', 'industry')}, {LABELLED}, li AS (SELECT lp.*, sw_l1_code FROM lp JOIN industry USING (ts_code)),
    {_gaussian_sql('li', 'date, sw_l1_code', (0.05, 0.95))}""",
)
def gaussian(spark, sf):
    df = join_industry(stored_panel(spark, sf), industry(spark, sf))
    return labels.label_gaussian(df, "ret_1m", "date", ["sw_l1_code"], (0.05, 0.95)).select(
        "ts_code", "date", "label_ret_1m"
    )


@query("label_gaussian_plain", f"{BASE}, {_gaussian_sql('lp', 'date', None)}")
def gaussian_plain(spark, sf):
    return labels.label_gaussian(stored_panel(spark, sf), "ret_1m", winsor_limits=None).select(
        "ts_code", "date", "label_ret_1m"
    )


DISCRETE = """d AS (SELECT *, (ntile(6) OVER (PARTITION BY date ORDER BY ret_1m, ts_code) - 1)::INT AS label_ret_1m
    FROM lp WHERE ret_1m IS NOT NULL)"""


def discrete_panel(spark, sf):
    return labels.label_discrete(stored_panel(spark, sf), "ret_1m")


@query("label_discrete", f"{BASE}, {DISCRETE} SELECT ts_code, date, label_ret_1m FROM d")
def discrete(spark, sf):
    return discrete_panel(spark, sf).select("ts_code", "date", "label_ret_1m")


@query("label_binary", f"{BASE} SELECT ts_code, date, {flag_sql('ret_1m > 0.02')} AS label_ret_1m FROM lp")
def binary(spark, sf):
    return labels.label_binary(labelled_panel(spark, sf), "ret_1m", 0.02).select("ts_code", "date", "label_ret_1m")


@query("label_identity", f"{BASE} SELECT ts_code, date, {nums({'label_ret_1m': 'ret_1m'})} FROM lp")
def identity(spark, sf):
    return labels.label_identity(labelled_panel(spark, sf), "ret_1m").select("ts_code", "date", "label_ret_1m")


# ---- splits -----------------------------------------------------------------------------------

SPLIT, HORIZON, EMBARGO = date(1999, 1, 1), 21, 5
_CUT = SPLIT - timedelta(days=HORIZON)


@query(
    "purged_time_split",
    f"""{BASE} SELECT 'train' AS role, ts_code, date, {nums(['ret_1m'])} FROM lp WHERE date < DATE '{_CUT}' AND date + 30 < DATE '{_CUT}'
    UNION ALL SELECT 'test', ts_code, date, {nums(['ret_1m'])} FROM lp WHERE date >= DATE '{SPLIT + timedelta(days=EMBARGO)}'""",
)
def time_split(spark, sf):
    df = stored_panel(spark, sf).withColumn("label_end", F.date_add("date", 30))
    train, test = splits.purged_time_split(
        df, SPLIT, horizon_days=HORIZON, embargo_days=EMBARGO, label_end_col="label_end"
    )
    tagged = [f.select(F.lit(r).alias("role"), "ts_code", "date", "ret_1m") for r, f in (("train", train), ("test", test))]
    return tagged[0].unionByName(tagged[1])


DAYS = "ds AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM lp))"
GAP = HORIZON + EMBARGO


@query(
    "purged_kfold",
    f"""{BASE}, {DAYS}, fo AS (SELECT unnest([0, 1, 2, 3, 4]) AS fold),
    b AS (SELECT fold, (fold + 1) * (n // 6) AS lo, CASE WHEN fold = 4 THEN n ELSE (fold + 2) * (n // 6) END AS hi
      FROM fo, (SELECT max(n) AS n FROM ds)),
    c AS (SELECT b.*, date - {GAP} AS cutoff FROM b JOIN ds ON i = lo),
    r AS (SELECT fold::INT AS fold, CASE WHEN i >= lo THEN 'test' WHEN date < cutoff THEN 'train' END AS role, date
      FROM ds JOIN c ON i < hi)
    SELECT fold, role, ts_code, date, {nums(['ret_1m'])} FROM r JOIN lp USING (date) WHERE role IS NOT NULL""",
)
def kfold(spark, sf):
    tagged = splits.purged_kfold(stored_panel(spark, sf), 5, horizon_days=HORIZON, embargo_days=EMBARGO, min_train_size=10)
    return tagged.select("fold", "role", "ts_code", "date", "ret_1m")


def _walk_sql(expanding: bool) -> str:
    start = "0" if expanding else "fold * 150"
    return f"""{BASE}, {DAYS}, fo AS (SELECT unnest(range((n - 400) // 150)) AS fold, n FROM (SELECT max(n) AS n FROM ds)),
    b AS (SELECT fold, {start} AS fr, fold * 150 + 400 AS lo,
      CASE WHEN fold = (n - 400) // 150 - 1 THEN n ELSE fold * 150 + 550 END AS hi FROM fo),
    c AS (SELECT b.*, date - {GAP} AS cutoff FROM b JOIN ds ON i = lo),
    r AS (SELECT fold::INT AS fold, CASE WHEN i >= lo THEN 'test' WHEN date < cutoff THEN 'train' END AS role, date
      FROM ds JOIN c ON i >= fr AND i < hi)
    SELECT fold, role, ts_code, date, {nums(['ret_1m'])} FROM r JOIN lp USING (date) WHERE role IS NOT NULL"""


def _walk(spark, sf, expanding):
    """Windows over all dates there are."""
    return splits.walk_forward(
        stored_panel(spark, sf), None, window_size=400, step_size=150, horizon_days=HORIZON, embargo_days=EMBARGO,
        expanding=expanding,
    ).select("fold", "role", "ts_code", "date", "ret_1m")


query("walk_forward", _walk_sql(False))(lambda spark, sf: _walk(spark, sf, False))
query("walk_forward_expanding", _walk_sql(True))(lambda spark, sf: _walk(spark, sf, True))

# ---- scores -----------------------------------------------------------------------------------

WEIGHTS = {"roc_4": 0.5, "ma12_dev": -0.25, "vola_20": 0.1}
SCORE_SQL = " + ".join(f"coalesce({c}, 0) * {w}::DOUBLE" for c, w in WEIGHTS.items())
SCORED = f"sc AS (SELECT *, {SCORE_SQL} AS predict_score FROM lp)"


def scored(spark, sf, df=None):
    return evaluate.score_linear(labelled_panel(spark, sf) if df is None else df, WEIGHTS)


@query("score_linear", f"{BASE}, {SCORED} SELECT ts_code, date, {nums(['predict_score'])} FROM sc")
def linear(spark, sf):
    return scored(spark, sf).select("ts_code", "date", "predict_score")


# Scores are ranked on a rounded value: engines differ in the last bit, and ties are broken by code.
RANKED = "rs AS (SELECT ts_code, date, round(predict_score, 4) AS predict_score FROM sc)"


def rounded_scores(spark, sf):
    return scored(spark, sf, stored_panel(spark, sf)).select("ts_code", "date", F.round("predict_score", 4).alias("predict_score"))


@query(
    "rank_scores",
    f"""{BASE}, {SCORED}, {RANKED} SELECT ts_code, date, {nums(['predict_score'])},
    row_number() OVER (PARTITION BY date ORDER BY predict_score DESC, ts_code) AS rank FROM rs""",
)
def ranks(spark, sf):
    return evaluate.rank_scores(rounded_scores(spark, sf)).orderBy("date", "rank")


@query(
    "topk_per_rebalance",
    f"""{BASE}, {SCORED}, {RANKED}, m AS (SELECT date_trunc('month', date) AS mo, max(date) AS date FROM rs GROUP BY 1),
    k AS (SELECT rs.*, row_number() OVER (PARTITION BY date ORDER BY predict_score DESC, ts_code)::INT AS rank
      FROM rs JOIN m USING (date)), t AS (SELECT * FROM k WHERE rank <= 50)
    SELECT ts_code, date, {nums(['predict_score'])}, rank,
    {nums({'weight': 'least(1.0 / count(*) OVER (PARTITION BY date), 0.05)'})} FROM t""",
)
def topk(spark, sf):
    return evaluate.topk_per_rebalance(rounded_scores(spark, sf))


@query(
    "blend_scores",
    f"{BASE} SELECT ts_code, date, {nums({'predict_score': 'roc_4 * 0.3::DOUBLE + roc_12 * 0.4::DOUBLE + ma12_dev * 0.3::DOUBLE'})} FROM lp",
)
def blend(spark, sf):
    p = stored_panel(spark, sf)
    frames = {
        h: p.select("date", "ts_code", F.col(c).alias("predict_score"))
        for h, c in (("20d", "roc_4"), ("60d", "roc_12"), ("252d", "ma12_dev"))
    }
    return evaluate.blend_scores(frames)


def _ndcg_sql() -> str:
    def side(order, name):
        gains = ", ".join(
            f"sum(CASE WHEN r <= {k} THEN (pow(2, label) - 1) / log2(r + 1) END) AS {name}{k}" for k in (5, 10, 20)
        )
        return f"""{name} AS (SELECT date, {gains} FROM (SELECT date, label, row_number() OVER (PARTITION BY date
        ORDER BY {order} DESC, ts_code) AS r FROM e) GROUP BY date)"""

    cols = nums({f"ndcg_{k}": f"CASE WHEN i{k} > 0 THEN d{k} / i{k} ELSE 1 END" for k in (5, 10, 20)})
    return f"""{BASE}, {DISCRETE}, {SCORED}, {RANKED}, e AS (SELECT d.ts_code, d.date, label_ret_1m AS label, predict_score
    FROM d JOIN rs ON rs.ts_code = d.ts_code AND rs.date = d.date), {side('predict_score', 'd_').replace('d_5', 'd5').replace('d_10', 'd10').replace('d_20', 'd20')},
    {side('label', 'i_').replace('i_5', 'i5').replace('i_10', 'i10').replace('i_20', 'i20')}
    SELECT date, {cols} FROM d_ JOIN i_ USING (date)"""


@query("ndcg_at_k", _ndcg_sql())
def ndcg(spark, sf):
    df = scored(spark, sf, discrete_panel(spark, sf)).withColumn("predict_score", F.round("predict_score", 4))
    return evaluate.ndcg_at_k(df, label="label_ret_1m")


_WINDOWS = f"""{DAYS}, fo AS (SELECT unnest([0, 1, 2]) AS fold), b AS (SELECT fold, fold * (n // 4) AS fr, (fold + 1) * (n // 4) AS lo,
      (fold + 2) * (n // 4) AS hi FROM fo, (SELECT max(n) AS n FROM ds)),
    c AS (SELECT b.*, date - {GAP} AS cutoff FROM b JOIN ds ON i = lo),
    r AS (SELECT fold::INT AS fold, CASE WHEN i >= lo THEN 'test' WHEN date < cutoff THEN 'train' END AS role, date
      FROM ds JOIN c ON i >= fr AND i < hi),
    tr AS (SELECT fold, role, lp.* FROM r JOIN lp USING (date) WHERE ret_1m IS NOT NULL AND NOT isnan(ret_1m) AND role IS NOT NULL)"""


def _ridge_sql(features: list[str], label: str, alpha: float) -> str:
    """Normal equations per fold, solved by Gaussian elimination: a stage per unknown, then from the last one back."""
    x = ["1", *[f"coalesce(CASE WHEN NOT isnan({c}) THEN {c} END, 0)" for c in features]]
    p = range(len(x))
    sums = [f"sum({x[i]} * {x[j]}){f' + {alpha}::DOUBLE' if i == j > 0 else ''} AS a{i}_{j}" for i in p for j in p]
    sums += [f"sum({x[i]} * {label}) AS b{i}" for i in p]
    stages = [f"e0 AS (SELECT fold, count(*) AS n_train, {', '.join(sums)} FROM tr WHERE role = 'train' GROUP BY fold)"]
    for k in p[:-1]:
        cols = ["fold", "n_train"]
        for i in p:
            f = f"a{i}_{k} / a{k}_{k}"
            cols += [f"a{i}_{j} - {f} * a{k}_{j} AS a{i}_{j}" if i > k else f"a{i}_{j}" for j in p]
            cols.append(f"b{i} - {f} * b{k} AS b{i}" if i > k else f"b{i}")
        stages.append(f"e{k + 1} AS (SELECT {', '.join(cols)} FROM e{k})")
    last = f"e{len(x) - 1}"
    for i in reversed(p):
        known = "".join(f" - a{i}_{j} * w{j}" for j in p if j > i)
        stages.append(f"s{i} AS (SELECT *, (b{i}{known}) / a{i}_{i} AS w{i} FROM {last})")
        last = f"s{i}"
    predicted = " + ".join(f"w{i} * {x[i]}" for i in p)
    stages.append(f"""er AS (SELECT fold, count(*) AS n_test, sqrt(avg(miss * miss)) AS rmse, avg(abs(miss)) AS mae FROM (
        SELECT fold, {predicted} - {label} AS miss FROM tr JOIN {last} USING (fold) WHERE role = 'test') GROUP BY fold)""")
    named = {"rmse": "rmse", "mae": "mae", "intercept": "w0"} | {f"w_{c}": f"w{i + 1}" for i, c in enumerate(features)}
    return f"{', '.join(stages)} SELECT fold, n_train, n_test, {nums(named)} FROM {last} JOIN er USING (fold)"


def _windows(spark, sf):
    panel = stored_panel(spark, sf)
    return panel, splits.walk_forward_spans(panel, 3, horizon_days=HORIZON, embargo_days=EMBARGO)


@query("fit_walk_forward", f"{BASE}, {_WINDOWS}, {_ridge_sql(FEATURES, 'ret_1m', 1.0)}")
def fit(spark, sf):
    """Ridge models of three walk-forward windows from one aggregate of moments per date."""
    panel, windows = _windows(spark, sf)
    return evaluate.fit_walk_forward(panel, windows, FEATURES, "ret_1m")


@query("fit_walk_forward_trees")
def fit_trees(spark, sf):
    """Gradient-boosted trees on the same windows; no SQL counterpart."""
    panel, windows = _windows(spark, sf)
    return evaluate.fit_trees_walk_forward(windows.expand(panel), FEATURES, "ret_1m")


@query(
    "fold_memberships",
    f"""{BASE}, {_WINDOWS}, ro AS (SELECT ts_code, date, string_agg(fold || role, ',' ORDER BY fold) AS folds
      FROM (SELECT * FROM r WHERE role IS NOT NULL) JOIN lp USING (date) GROUP BY ts_code, date)
    SELECT lp.ts_code, lp.date, coalesce(folds, '') AS folds FROM lp LEFT JOIN ro ON ro.ts_code = lp.ts_code AND ro.date = lp.date""",
)
def memberships(spark, sf):
    """Every row once, with the folds it belongs to."""
    panel, windows = _windows(spark, sf)
    text = F.array_join(F.transform("folds", lambda m: F.concat(m["fold"].cast("string"), m["role"])), ",")
    return windows.tag(panel).select("ts_code", "date", text.alias("folds"))


@query(
    "fold_sizes",
    f"""{BASE}, {_WINDOWS} SELECT fold, count(*) FILTER (role = 'train') AS n_train, count(*) FILTER (role = 'test') AS n_test
    FROM tr GROUP BY fold""",
)
def sizes(spark, sf):
    """Rows that each window of ``fit_walk_forward`` trains and tests on."""
    tagged = splits.walk_forward(stored_panel(spark, sf), 3, horizon_days=HORIZON, embargo_days=EMBARGO)
    return splits.fold_sizes(tagged.where(F.col("ret_1m").isNotNull() & ~F.isnan("ret_1m")))
