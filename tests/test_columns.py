"""Column helpers on hand-written edge cases: null, NaN, zero and negative denominators, short windows."""

import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from factorlake.functions import codes, columns as C, dates as D

NAN, INF = float("nan"), float("inf")


def values(df, *cols):
    out = [tuple("nan" if isinstance(v, float) and math.isnan(v) else v for v in r) for r in df.select(*cols).collect()]
    return [r[0] for r in out] if len(cols) == 1 else out


def frame(spark, rows, schema="x double, y double"):
    return spark.createDataFrame(rows, schema)


def test_safe_div_modes(spark):
    df = frame(spark, [(1.0, 2.0), (1.0, 0.0), (1.0, -4.0), (None, 2.0), (1.0, None)])
    assert values(df, C.safe_div("x", "y")) == [0.5, None, None, None, None]
    assert values(df, C.safe_div("x", "y", negative="abs")) == [0.5, 1e6, 0.25, None, None]
    assert values(df, C.safe_div("x", "y", negative="keep")) == [0.5, 1e6, 1e6, None, None]
    assert values(df, C.safe_div("x", "y", fill=NAN)) == [0.5, "nan", "nan", "nan", "nan"]
    assert values(df, C.safe_div("x", "y", min_den=4.0)) == [0.25, None, None, None, None]
    with pytest.raises(ValueError):
        C.safe_div("x", "y", negative="other")


def test_clip_keeps_null_and_nan(spark):
    df = frame(spark, [(5.0, 1.0), (-5.0, 1.0), (None, 1.0), (NAN, 1.0), (5.0, None)])
    assert values(df, C.clip("x", -1, 2)) == [2.0, -1.0, None, "nan", 2.0]
    assert values(df, C.clip("x", hi=F.col("y"))) == [1.0, -5.0, None, "nan", 5.0]


def test_ieee_division_and_log(spark):
    df = frame(spark, [(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (1.0, 4.0)])
    assert values(df, C.div(F.col("x"), F.col("y"))) == [INF, -INF, "nan", 0.25]
    assert values(df, C.log(F.col("x"))) == [0.0, "nan", -INF, 0.0]


def test_horizontal(spark):
    df = frame(spark, [(1.0, 3.0), (1.0, None), (None, None)])
    assert values(df, C.row_mean(["x", "y"])) == [2.0, 1.0, None]
    assert values(df, C.row_max(["x", "y"])) == [3.0, 1.0, None]
    assert values(df, C.row_std(["x", "y"])) == [pytest.approx(math.sqrt(2)), None, None]
    flags = spark.createDataFrame([(True, None), (False, None), (False, False)], "x boolean, y boolean")
    assert values(flags, C.row_any(["x", "y"])) == [1, None, 0]


@pytest.fixture
def W(spark):
    return Window.partitionBy("k").orderBy("t")


def series(spark, xs):
    return spark.createDataFrame([("a", i, x) for i, x in enumerate(xs)], "k string, t int, x double")


def test_min_samples_counts_nan_but_not_null(spark, W):
    df = series(spark, [1.0, None, 3.0, NAN, 5.0, 7.0])
    expected = [None, None, 2.0, "nan", "nan", "nan"]
    assert values(df.orderBy("t"), C.roll_mean("x", W, 3, 2)) == expected
    staged = df.withColumns(C.window_sums("m", "x", W, 3, squares=True)).orderBy("t")
    assert values(staged, C.mean_of("m", 2)) == expected
    # The NaN leaves the window again.
    longer = series(spark, [1.0, NAN, 3.0, 4.0, 5.0]).withColumns(C.window_sums("m", "x", W, 3, squares=True))
    assert values(longer.orderBy("t"), C.mean_of("m", 2)) == [None, "nan", "nan", "nan", 4.0]


def test_running_moments_agree_with_fresh_ones(spark, W):
    import random

    rnd = random.Random(7)
    xs = [None if rnd.random() < 0.1 else rnd.gauss(0, 0.02) for _ in range(300)]
    df = series(spark, xs).withColumn("y", F.lag("x", 1).over(W))
    df = df.withColumns(C.window_sums("m", "x", W, 20, squares=True) | C.window_sums("c", "x", W, 20, y="y"))
    rows = df.select(
        C.roll_std("x", W, 20, 5).alias("a"), C.std_of("m", 5).alias("b"),
        C.roll_corr("x", "y", W, 20, 5).alias("c"), C.corr_of("c", 5).alias("d"),
    ).collect()
    for r in rows:
        assert (r["a"] is None) == (r["b"] is None) and (r["c"] is None) == (r["d"] is None)
        assert r["a"] is None or r["a"] == pytest.approx(r["b"], rel=1e-9)
        assert r["c"] is None or r["c"] == pytest.approx(r["d"], abs=1e-9)


def test_moments_of_levels_keep_their_digits(spark, W):
    """A level of a million that drifts and moves by thousandths, with gaps: sums from the first level against fresh frames."""
    import random

    rnd, level, xs = random.Random(8), 1e6, []
    for _ in range(400):
        level += rnd.gauss(0.0002, 0.001)
        xs.append(None if rnd.random() < 0.1 else level)
    df = series(spark, [None, *xs]).withColumns({"y": F.lag("x", 1).over(W), "at": C.first_level("x", W)})
    sums = C.window_sums("m", "x", W, 20, squares=True, anchor="at") | C.window_sums("c", "x", W, 20, y="y", anchor="at", y_anchor="at")
    df = df.withColumns(sums)
    rows = df.select(
        C.roll_std("x", W, 20, 5).alias("a"), C.std_of("m", 5).alias("b"), C.roll_corr("x", "y", W, 20, 5).alias("c"),
        C.corr_of("c", 5).alias("d"), C.roll_mean("x", W, 20, 5).alias("e"), C.mean_of("m", 5, "at").alias("f"),
    ).collect()
    assert sum(r["a"] is not None for r in rows) > 300
    for r in rows:
        for one, two, rel, abs_ in (("a", "b", 1e-6, 0), ("c", "d", 0, 1e-6), ("e", "f", 1e-12, 0)):
            assert (r[one] is None) == (r[two] is None)
            assert r[one] is None or r[two] == pytest.approx(r[one], rel=rel, abs=abs_)


def test_resting_price_has_zero_deviation(spark, W):
    xs = [0.01, -0.02, 0.03] + [0.0] * 10
    df = series(spark, xs).withColumns(C.window_sums("m", "x", W, 5, squares=True)).orderBy("t")
    assert values(df, C.std_of("m", 2))[-3:] == [0.0, 0.0, 0.0]


def test_rolling_quantile_is_nearest_rank(spark, W):
    df = series(spark, [float(i) for i in range(34)])
    # 34 values: index round(33 * 0.95) = 31.
    assert values(df.orderBy("t"), C.roll_quantile("x", W, 60, 0.95, 20))[-1] == 31.0
    assert values(df.orderBy("t"), C.roll_quantile("x", W, 60, 0.95, 20))[18] is None


def test_probit(spark):
    from statistics import NormalDist

    ps = [0.001, 0.01, 0.024, 0.3, 0.5, 0.7, 0.98, 0.999]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    for p, got in zip(ps, values(df, C.probit("p"))):
        assert got == pytest.approx(NormalDist().inv_cdf(p), abs=1e-7)


def test_codes(spark):
    df = spark.createDataFrame([("sh600519",), ("600519.SH",), ("519",), ("1234567",), ("abc",), (None,)], "c string")
    assert values(df, codes.normalize_ts_code("c")) == ["600519", "600519", "000519", "234567", None, None]
    assert values(df, codes.normalize_ts_code("c", add_exchange=True))[:3] == ["600519.SH", "600519.SH", "000519.SZ"]
    assert values(df, codes.suffix_ts_code("c")) == [None, "600519.SH", None, None, None, None]
    assert values(df, codes.strip_ts_code("c")) == [None, "600519", None, None, None, None]
    two = spark.createDataFrame([("6a0b0519",)], "c string")
    assert values(two, codes.normalize_ts_code("c"), codes.normalize_ts_code_all_digits("c")) == [("000006", "600519")]
    for bad in (codes.normalize_ts_code_all_digits("c", strict=True), codes.suffix_ts_code("c", strict=True)):
        with pytest.raises(Exception, match="abc|digits|invalid"):
            df.select(bad.alias("v")).collect()


def test_dates(spark):
    from datetime import date

    df = spark.createDataFrame([("20240105",), (" 2024-01-05 ",), ("2024/1/5",), ("2024.01.05",), ("5 Jan",)], "c string")
    assert values(df, D.parse_date("c")) == [date(2024, 1, 5)] * 4 + [None]
    with pytest.raises(Exception, match="cannot convert"):
        df.select(D.parse_date("c", strict=True)).collect()
    mixed = spark.createDataFrame([("2024年01月05日",)] * 8 + [("?",)] * 2, "c string")
    assert values(D.normalize_date_column(mixed, "c"), "c") == [date(2024, 1, 5)] * 8 + [None] * 2
    junk = spark.createDataFrame([("x",), ("y",)], "c string")
    assert values(D.normalize_date_column(junk, "c"), "c") == ["x", "y"]
    with pytest.raises(ValueError):
        D.normalize_date_column(junk, "c", strict=True)
    with pytest.raises(ValueError):
        D.normalize_date_column(junk, "missing")


def test_quarters(spark):
    from datetime import date

    got = D.quarter_spine(spark, date(2023, 11, 5), date(2024, 7, 1)).orderBy("book").collect()
    assert [r["book"] for r in got] == ["2023_Q4", "2024_Q1", "2024_Q2", "2024_Q3"]
    with pytest.raises(ValueError):
        D.quarter_spine(spark, date(2024, 1, 2), date(2024, 1, 1))
    keys = spark.createDataFrame([("2024_Q3",), ("2024_Q5",), ("x",)], "k string")
    assert values(keys, D.quarter_start("k")) == [date(2024, 7, 1), None, None]
    u = spark.createDataFrame([("csi_500_2024-01-15",), ("csi500",)], "k string")
    assert values(u, *D.split_universe_key("k")) == [("csi_500", date(2024, 1, 15)), ("csi500", None)]
    assert D.check_macro_book("qvix") == "qvix"
    with pytest.raises(ValueError):
        D.check_macro_book("oil")


def test_a_clipped_expression_is_evaluated_once(spark):
    """Repeated in each branch, it makes generated methods that the JVM does not compile."""
    df = spark.createDataFrame([(4.0,), (-9.0,), (float("nan"),), (None,)], "x double")
    out = df.select(C.clip(F.cbrt("x"), -1, 1).alias("y"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("CBRT") == 1
    got = [r["y"] for r in out.collect()]
    assert got[:2] == [1.0, -1.0] and got[2] != got[2] and got[3] is None
