"""The route for hot groups gives the same rows as the plain one."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from factorlake.operators import behavioral, crosssection, evaluate, labels
from factorlake.operators.joins import asof_backward
from factorlake.operators.skew import hot_keys, positions
from factorlake.operators.staged import FeatureGroup, staged_metrics

DAY = date(1999, 3, 8)


@pytest.fixture(scope="module")
def bars(spark):
    rnd = random.Random(3)
    rows = []
    for code, n in (("hot", 900), ("cold", 80), ("tiny", 3)):
        close = 100.0
        for i in range(n):
            close *= 1 + rnd.gauss(0, 0.02)
            o = close * (1 + rnd.gauss(0, 0.005))
            rows.append(
                (code, DAY + timedelta(days=i), o, max(o, close) * 1.01, min(o, close) * 0.99, close, rnd.uniform(1, 9) * 1e4)
            )
    df = spark.createDataFrame(
        rows, "ts_code string, date date, open double, high double, low double, close double, volume double"
    )
    return df.withColumn("amount", F.col("volume") * F.col("close"))


def table(df, keys):
    return {tuple(r[k] for k in keys): r.asDict() for r in df.collect()}


def assert_same(a, b, keys):
    a, b = table(a, keys), table(b, keys)
    assert a.keys() == b.keys()
    for k, row in a.items():
        for c, v in row.items():
            w = b[k][c]
            if isinstance(v, float) and isinstance(w, float):
                assert v == pytest.approx(w, rel=1e-7, abs=1e-9, nan_ok=True), (k, c)
            else:
                assert v == w, (k, c)


def test_hot_keys(bars):
    assert hot_keys(bars, ["ts_code"], 1000) is None
    assert hot_keys(bars, ["ts_code"], None) is None
    assert [r[0] for r in hot_keys(bars, ["ts_code"], 100).collect()] == ["hot"]


def test_positions_are_exact(bars):
    got = positions(bars, ["ts_code"], ["date"]).collect()
    assert all(r["_pos"] == (r["date"] - DAY).days for r in got)


def test_features_in_blocks(bars):
    # 300 rows per ticker at most: the hot one is cut into blocks shorter than its longest horizon allows.
    assert_same(
        behavioral.features(bars, max_rows=None), behavioral.features(bars, max_rows=300), ["ts_code", "date"]
    )


def test_asof_in_blocks(spark, bars):
    reports = spark.createDataFrame(
        [("hot", DAY + timedelta(days=d), float(d), None if d == 400 else 1.0) for d in (10, 20, 400)]
        + [("cold", DAY + timedelta(days=5), 5.0, 2.0)],
        "ts_code string, notice_date date, v double, w double",
    )
    plain = asof_backward(bars, reports, max_rows=None)
    assert_same(plain, asof_backward(bars, reports, max_rows=100), ["ts_code", "date"])


def test_ranks_in_blocks(spark):
    rnd = random.Random(5)
    # Many ties, and one date holding most of the rows.
    rows = [(f"c{i}", DAY if i < 400 else DAY + timedelta(days=1), float(rnd.randint(0, 40))) for i in range(450)]
    df = spark.createDataFrame(rows, "ts_code string, date date, x double")
    for fn in (
        lambda m: labels.label_gaussian(df, "x", winsor_limits=None, max_rows=m),
        lambda m: labels.label_gaussian(df, "x", winsor_limits=(0.05, 0.95), max_rows=m),
        lambda m: labels.label_discrete(df, "x", max_rows=m),
        lambda m: evaluate.rank_scores(df, "x", max_rows=m),
    ):
        assert_same(fn(None), fn(100), ["ts_code"])


@pytest.mark.parametrize("q", [0.0, 0.01, 0.25, 0.5, 0.95, 0.99, 1.0])
def test_tallied_quantile_against_brute_force(spark, q):
    rnd = random.Random(11)
    groups = {"big": [rnd.gauss(0, 1) for _ in range(3000)] + [0.0] * 1500, "ties": [1.0] * 2000, "few": [3.0, 1.0, 2.0]}
    rows = [(g, x) for g, xs in groups.items() for x in xs] + [("big", None), ("big", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(7)
    got = {r["g"]: r["v"] for r in crosssection.tallied_quantiles(df, ["g"], {"v": ("x", q)}).collect()}
    for g, xs in groups.items():
        xs = sorted(xs)
        assert got[g] == xs[int((len(xs) - 1) * q + 0.5)], g
    assert got.get("none") is None


def test_zscore_of_hot_groups(spark):
    rnd = random.Random(13)
    rows = [("a" if i < 600 else None, i, rnd.gauss(5, 2), rnd.random()) for i in range(640)]
    df = spark.createDataFrame(rows, "g string, i int, x double, y double")
    assert_same(
        crosssection.cs_zscore(df, ["g"], ["x", "y"], sort_rows=None),
        crosssection.cs_zscore(df, ["g"], ["x", "y"], sort_rows=100),
        ["i"],
    )


def test_user_providers_on_both_routes(spark):
    """Lags, rolling windows and running totals give the same whether a series is cut into blocks or not."""
    rows = [("a", i, float(i % 7), None if i % 11 == 0 else float(i)) for i in range(90)] + [("b", i, 1.0, None) for i in range(5)]
    df = spark.createDataFrame(rows, "k string, i int, x double, y double")
    lagged = FeatureGroup(("back3",), (lambda w: {"back3": F.lag("x", 3).over(w)},), back=3, ahead=0)
    rolled = FeatureGroup(
        ("mean4", "next2"),
        (lambda w: {"mean4": F.avg("x").over(w.rowsBetween(-3, 0))}, lambda w: {"next2": F.lead("mean4", 2).over(w)}),
        back=3,
        ahead=2,
    )
    total = FeatureGroup(("share",), (lambda w: {"share": F.col("x") / (F.col("sum_x") + 1)},), back=0, ahead=0, running={"sum_x": F.col("x")})
    gaps = FeatureGroup(("sum_y",), back=0, ahead=0, running={"sum_y": F.col("y")})

    def run(max_rows):
        return staged_metrics(df, [lagged, rolled, total, gaps], ["k", "i"], "select", by=["k"], order=["i"], max_rows=max_rows)

    assert_same(run(None), run(40), ["k", "i"])


def test_size_check_of_asof_reads_keys_only(spark):
    """The pass over group sizes computes none of the features of the left side."""
    from factorlake.operators import joins, skew

    seen = []
    plain = skew.hot_keys

    def spy(df, by, max_rows=None, sizes=None):
        seen.append(df.groupBy(*by).count()._jdf.queryExecution().optimizedPlan().toString())
        return plain(df, by, max_rows, sizes)

    left = spark.createDataFrame([("a", DAY, 1.0)], "ts_code string, date date, x double")
    left = left.withColumn("feature", F.avg("x").over(Window.partitionBy("ts_code").orderBy("date")))
    reports = spark.createDataFrame([("a", DAY, 1.0)], "ts_code string, notice_date date, v double")
    skew.hot_keys = spy
    try:
        assert joins.asof_backward(left, reports).count() == 1
    finally:
        skew.hot_keys = plain
    assert seen and all("Window" not in p for p in seen)


def test_null_keys_can_be_hot(spark):
    rows = [(None if i < 300 else "a", DAY + timedelta(days=i), float(i), i) for i in range(340)]
    df = spark.createDataFrame(rows, "ts_code string, date date, x double, i int")
    undated = df.withColumn("ts_code", F.lit("z")).withColumn("date", F.when(F.col("i") >= 300, F.col("date")))
    assert_same(
        evaluate.rank_scores(undated, "x", max_rows=None), evaluate.rank_scores(undated, "x", max_rows=50), ["i"]
    )
    reports = spark.createDataFrame([("a", DAY, 1.0)], "ts_code string, notice_date date, v double")
    out = asof_backward(df, reports, max_rows=50)
    assert out.count() == 340 and out.where("v is not null").count() == 40


def test_windows_of_bars_read_them_once(spark, monkeypatch):
    """The calendar bounds a ticker's bars, so a rolling query does not count them first."""
    from factorlake.catalogue import QUERIES
    from factorlake.operators import skew

    given = []
    whole = skew.hot_keys
    monkeypatch.setattr(skew, "hot_keys", lambda df, by, max_rows=None, sizes=None: given.append(max_rows) or whole(df, by, max_rows, sizes))
    QUERIES["rolling_mean"](spark, "/root/testdata/sf0.001")
    assert given == [None]
