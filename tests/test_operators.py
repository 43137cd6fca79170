"""Invariants and edge cases of operators, on small seeded frames."""

import json
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from factorlake.operators import behavioral, evaluate, fundamental, joins, labels, macro, relational, splits
from factorlake.operators.crosssection import cs_zscore, industry_neutral, sector_normalize
from factorlake.operators.staged import FeatureGroup, staged_metrics
from factorlake.plans.panel import bars_adjust, bars_resample, market_features, panel_stack
from factorlake.sources import ingest, specs, tables

DAY = date(1999, 3, 8)


def panel(spark, n_stocks=4, n_days=100, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n_stocks):
        close = 100.0
        for d in range(n_days):
            close = max(1.0, close + rnd.gauss(0, 2))
            rows.append((DAY + timedelta(days=d), f"K{i}", close, rnd.gauss(0, 0.02), "ABC"[i % 3]))
    return spark.createDataFrame(rows, "date date, ts_code string, close double, ret double, sw_l1_code string")


# ---- splits -----------------------------------------------------------------------------------


def test_time_split_purges_and_embargoes(spark):
    df = panel(spark)
    cut = DAY + timedelta(days=50)
    train, test = splits.purged_time_split(df, cut, horizon_days=21, embargo_days=5)
    assert train.agg(F.max("date")).first()[0] < cut - timedelta(days=21)
    assert test.agg(F.min("date")).first()[0] == cut + timedelta(days=5)
    ended = df.withColumn("end", F.date_add("date", 21))
    train, _ = splits.purged_time_split(ended, cut, horizon_days=21, embargo_days=5, label_end_col="end")
    assert train.agg(F.max("end")).first()[0] < cut - timedelta(days=21)
    for bad in (date(2025, 1, 1), date(1990, 1, 1)):
        with pytest.raises(ValueError):
            splits.purged_time_split(df, bad)


def test_kfold_moves_forward_without_leakage(spark):
    df = panel(spark, 3, 300).withColumn("end", F.date_add("date", 21))
    tagged = splits.purged_kfold(df, 3, horizon_days=21, embargo_days=5, min_train_size=10, label_end_col="end").cache()
    parts = list(splits.folds(tagged))
    assert len(parts) == 3
    last_end = None
    for _, train, test in parts:
        start, end, n_test = test.agg(F.min("date"), F.max("date"), F.count("*")).first()
        latest, n_train = train.agg(F.max("end"), F.count("*")).first()
        assert n_train >= 10 and n_test > 0
        assert latest < start - timedelta(days=26)
        assert last_end is None or start > last_end
        last_end = end
    assert last_end == DAY + timedelta(days=299)
    with pytest.raises(ValueError, match="Not enough unique dates"):
        splits.purged_kfold(panel(spark, 2, 3), 3)
    with pytest.raises(ValueError, match="training rows per fold"):
        splits.purged_kfold(panel(spark, 2, 5), 3, horizon_days=21, embargo_days=5)
    with pytest.raises(ValueError, match="DATE"):
        splits.purged_kfold(df.withColumn("date", F.col("date").cast("timestamp")), 3)


@pytest.mark.parametrize("expanding", [True, False])
def test_walk_forward_sizes(spark, expanding):
    tagged = splits.walk_forward(
        panel(spark, 2, 300), 3, window_size=100, step_size=50, horizon_days=21, embargo_days=5, expanding=expanding
    )
    sizes = [r["count"] for r in tagged.where("role = 'train'").groupBy("fold").count().orderBy("fold").collect()]
    assert len(sizes) == 3
    assert sizes == sorted(sizes) if expanding else max(sizes) - min(sizes) <= 50
    with pytest.raises(ValueError, match="Not enough unique dates"):
        splits.walk_forward(panel(spark, 2, 300), 5, window_size=100, step_size=50, expanding=expanding)
    every = splits.walk_forward(panel(spark, 2, 310), None, window_size=100, step_size=50, expanding=expanding)
    last = every.where("role = 'test'").groupBy("fold").agg(F.count_distinct("date")).orderBy("fold").collect()
    assert [r[1] for r in last] == [50, 50, 50, 60]


# ---- labels and evaluation --------------------------------------------------------------------


def test_gaussian_label_is_monotone_and_complete(spark):
    df = panel(spark, 10, 20)
    out = labels.label_gaussian(df, "ret", by=[]).select("date", "ret", "label_ret").collect()
    assert len(out) == 200 and all(r["label_ret"] is not None for r in out)
    by_day = {}
    for r in out:
        by_day.setdefault(r["date"], []).append((r["ret"], r["label_ret"]))
    for rows in by_day.values():
        ordered = [y for _, y in sorted(rows)]
        assert ordered == sorted(ordered)
        assert sum(ordered) == pytest.approx(0, abs=1e-6)
    alone = labels.label_gaussian(df, "ret", by=["ts_code"]).agg(F.min("label_ret"), F.max("label_ret")).first()
    assert tuple(alone) == (0.0, 0.0)
    holes = df.withColumn("ret", F.when(F.col("ts_code") != "K0", F.col("ret")))
    assert labels.label_gaussian(holes, "ret").count() == 180


def test_discrete_label_bins_are_even(spark):
    out = labels.label_discrete(panel(spark, 10, 5), "ret", num_bins=4)
    sizes = out.groupBy("date", "label_ret").count().groupBy("label_ret").agg(F.collect_set("count")).collect()
    assert {r[0]: r[1] for r in sizes} == {0: [3], 1: [3], 2: [2], 3: [2]}


def test_topk_and_ndcg(spark):
    rows = [(DAY + timedelta(days=d), f"s{i}", float(i), float(i)) for d in (0, 10, 25) for i in range(30)]
    df = spark.createDataFrame(rows, "date date, ts_code string, predict_score double, label double")
    picked = evaluate.topk_per_rebalance(df, top_k=10, max_weight=0.05).collect()
    # Two months: the last date of each.
    assert {r["date"] for r in picked} == {DAY + timedelta(days=10), DAY + timedelta(days=25)}
    assert {r["ts_code"] for r in picked} == {f"s{i}" for i in range(20, 30)}
    assert {r["weight"] for r in picked} == {0.05}
    best = evaluate.ndcg_at_k(df).first()
    assert (best["ndcg_5"], best["ndcg_20"]) == (1.0, 1.0)
    worst = evaluate.ndcg_at_k(df.withColumn("predict_score", -F.col("predict_score"))).first()
    assert worst["ndcg_5"] < 0.01
    flat = evaluate.ndcg_at_k(df.withColumn("label", F.lit(0.0))).first()
    assert flat["ndcg_10"] == 1.0


# ---- features ---------------------------------------------------------------------------------


def ohlcv(spark, n=120):
    df = panel(spark, 2, n)
    return df.select(
        "date", "ts_code", (F.col("close") * 0.99).alias("open"), (F.col("close") * 1.02).alias("high"),
        (F.col("close") * 0.98).alias("low"), "close", (F.col("close") * 1000).alias("volume"),
    )


def test_no_feature_looks_ahead(spark):
    df = ohlcv(spark)
    cut = DAY + timedelta(days=80)
    whole = behavioral.features(df).drop(*behavioral.LABEL_COLUMNS).where(F.col("date") <= cut)
    past = behavioral.features(df.where(F.col("date") <= cut)).drop(*behavioral.LABEL_COLUMNS)
    assert whole.exceptAll(past).count() == 0 and past.exceptAll(whole).count() == 0


def test_tickers_do_not_mix(spark):
    df = ohlcv(spark)
    both = behavioral.features(df).where("ts_code = 'K1'")
    alone = behavioral.features(df.where("ts_code = 'K1'"))
    assert both.exceptAll(alone).count() == 0


def test_missing_inputs(spark):
    close = ohlcv(spark).select("date", "ts_code", "close")
    cols = behavioral.features(close).columns
    assert "vola_20" in cols and "tr" not in cols and "near_high" not in cols and "vol_dev20" in cols
    assert behavioral.features(close.drop("close")).columns == [
        "date", "ts_code", "vol_dev20", "vol_dev60", "vol_spike", "vwap_dev_1d", "avg_trade_price",
    ]
    with pytest.raises(ValueError):
        behavioral.features(close.drop("date"))
    nulls = ohlcv(spark).withColumn("volume", F.lit(None).cast("double"))
    assert behavioral.features(nulls, ["volume"]).where("vol_dev20 is not null or vol_spike is not null").count() == 0
    dates = close.select("date")
    assert macro.northbound(dates.distinct()).columns == ["date"]
    assert macro.margin_short(dates.distinct()).columns == ["date"]
    assert macro.shibor(dates.distinct()).columns == ["date"]


def test_duplicate_bars_keep_the_last(spark):
    df = ohlcv(spark, 30)
    first = df.withColumn("close", F.col("close") * 2).withColumn("seq", F.lit(1))
    twice = df.withColumn("seq", F.lit(2)).unionByName(first)
    got = market_features(twice, ["seq"])
    assert got.exceptAll(market_features(df)).isEmpty() and got.count() == df.count()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count(" Sort [") == 1, "bars are sorted once"


def test_fundamental_edges(spark):
    k = "ts_code string, name string, notice_date date"
    base = spark.createDataFrame(
        [("a", "A", DAY), ("a", "A", DAY + timedelta(days=90)), ("b", None, DAY)], k
    ).withColumns({"net_profit": F.lit(10.0), "total_equity": F.lit(-5.0), "total_revenue": F.lit(100.0), "operate_cost": F.lit(60.0)})
    out = fundamental.factors(base)
    rows = out.orderBy("notice_date").collect()
    assert len(rows) == 2  # a null identifier matches nothing
    assert rows[0]["gross_margin"] == 0.4 and rows[0]["roe"] != rows[0]["roe"]
    assert rows[0]["debt_to_equity"] is None and rows[0]["cfo_to_net_profit"] == 0.0 and rows[1]["roe_last"] == 0.0


def test_ttm_windows(spark):
    rows = [("a", date(2020, m, 1), 10.0, 1.0, 5.0, -1.0, 50.0 + m, 100.0) for m in (1, 4, 7, 10)]
    df = spark.createDataFrame(
        rows,
        "ts_code string, notice_date date, total_revenue double, net_profit double, cfo double, cfi double, "
        "total_equity double, total_asset double",
    )
    out = {r["report_date"]: r for r in fundamental.trailing_twelve_months(df).collect()}
    assert set(out) == {date(2019, 7, 1), date(2019, 10, 1), date(2020, 1, 1), date(2020, 4, 1)} - {date(2019, 7, 1)}
    full = out[date(2020, 1, 1)]
    assert (full["ttm_revenue"], full["ttm_fcf"]) == (40.0, 16.0)
    assert full["ttm_roe"] == pytest.approx(4.0 / 60.0)
    assert full["profit_momentum"] == pytest.approx(4.0 / 3.0 - 1)


# ---- joins ------------------------------------------------------------------------------------


def test_asof_edges(spark):
    left = spark.createDataFrame(
        [("a", DAY + timedelta(days=d)) for d in (0, 5, 9, 10)] + [("b", DAY), (None, DAY)], "ts_code string, date date"
    )
    right = spark.createDataFrame(
        [("a", DAY + timedelta(days=5), 1.0, 7.0), ("a", DAY + timedelta(days=10), 2.0, None), (None, DAY, 3.0, 3.0)],
        "ts_code string, notice_date date, v double, w double",
    )
    got = {(r["ts_code"], r["date"]): (r["v"], r["w"]) for r in joins.asof_backward(left, right).collect()}
    day = lambda d: DAY + timedelta(days=d)
    assert got == {
        ("a", day(0)): (None, None), ("a", day(5)): (1.0, 7.0), ("a", day(9)): (1.0, 7.0),
        ("a", day(10)): (2.0, None),  # a null field of the newest report stays null
        ("b", day(0)): (None, None), (None, day(0)): (None, None),
    }
    with pytest.raises(ValueError):
        joins.asof_backward(left.withColumn("v", F.lit(1)), right)


def test_panel_is_point_in_time(spark):
    market = panel(spark, 2, 60).select("ts_code", "date", "close")
    reports = spark.createDataFrame(
        [("K0", DAY + timedelta(days=d), float(d)) for d in (10, 30)], "ts_code string, notice_date date, roe double"
    )
    flow = market.select("date").distinct().withColumn("z", F.lit(1.0))
    out = panel_stack(market, reports, flow)
    assert out.count() == 120 and out.where("notice_date > date").count() == 0
    assert out.where("ts_code = 'K1' and roe is not null").count() == 0


def test_sector_normalisation(spark):
    df = panel(spark, 7, 1).select("ts_code", "ret", "sw_l1_code")  # groups of 3, 2 and 2
    out = sector_normalize(df, ["sw_l1_code"], ["ret"], min_group_size=3)
    assert out.count() == 3
    mean, std = out.agg(F.avg("cs_ret_z"), F.stddev_samp("cs_ret_z")).first()
    assert mean == pytest.approx(0, abs=1e-9) and std == pytest.approx(1)
    assert sector_normalize(df, ["nope"], ["ret"]).columns == df.columns
    assert sector_normalize(df, ["sw_l1_code"], ["nope"]).columns == df.columns
    with pytest.raises(ValueError):
        industry_neutral(df.drop("ts_code"), df)
    one = cs_zscore(df.limit(1), ["sw_l1_code"], ["ret"]).first()
    assert one["cs_ret_z"] is None  # no deviation in a group of one


# ---- relational -------------------------------------------------------------------------------


def test_unions_and_profile(spark):
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(2.5,)], "x double")
    with pytest.raises(ValueError):
        relational.union_vertical(a, b)
    with pytest.raises(ValueError):
        relational.union_relaxed(a, b.withColumnRenamed("x", "y"))
    assert relational.union_relaxed(a, b).schema["x"].dataType.typeName() == "double"
    assert relational.null_profile(a.limit(0)).count() == 0
    assert relational.any_flag(a.limit(0), F.col("x") > 0).first()[0] is False
    assert relational.sum_by(spark.createDataFrame([("k", None)], "k string, v double"), "k").first()["v"] == 0.0


def test_staged_metrics_contract(spark):
    df = spark.createDataFrame([(1.0,)], "x double")
    double = FeatureGroup(("d",), (lambda w: {"d": F.col("x") * 2},), ("x",))
    assert staged_metrics(df, [double]).columns == ["x", "d"]
    assert staged_metrics(df, [double], [], "select").columns == ["d"]
    with pytest.raises(ValueError):
        staged_metrics(df, [FeatureGroup(inputs=("nope",))])
    with pytest.raises(ValueError):
        staged_metrics(df, [double], [], "other")
    with pytest.raises(ValueError, match="must declare"):  # whatever the size of the data
        staged_metrics(df, [double], order=["x"])


def test_resample_and_adjust(spark):
    bars = ohlcv(spark, 14)
    weekly = bars_resample(bars, "week").where("ts_code = 'K0'").orderBy("date").collect()
    assert [r["date"] for r in weekly] == [DAY + timedelta(days=6), DAY + timedelta(days=13)]
    factors = spark.createDataFrame([("K0", DAY + timedelta(days=7), 2.0)], "ts_code string, date date, factor double")
    for how, ratio in (("hfq", 2.0), ("qfq", 0.5)):
        got = bars_adjust(bars, factors, how).join(bars.select("ts_code", "date", F.col("close").alias("raw")), ["ts_code", "date"])
        late = F.col("date") >= DAY + timedelta(days=7)
        expect = F.when(late & (F.col("ts_code") == "K0"), ratio).otherwise(1.0)
        assert got.where(F.abs(F.col("close") / F.col("raw") - expect) > 1e-12).count() == 0


# ---- sources ----------------------------------------------------------------------------------


def test_landed_files(spark, tmp_path):
    line = "2024-01-02,1,2,3,0.5,100,200,1,1,1,x"
    docs = [
        {"symbol": "600519", "data": {"klines": [line, line, line + ",9", "2024-01-03,1"]}},
        {"symbol": "000001", "data": None},
    ]
    (tmp_path / "k.json").write_text("\n".join(json.dumps(d) for d in docs))
    rows = ingest.read_kline(spark, str(tmp_path / "k.json")).collect()
    assert len(rows) == 1 and rows[0]["date"] == date(2024, 1, 2)
    assert rows[0]["close"] == 2.0 and rows[0]["turnover"] is None

    page = {"result": {"pages": 1, "data": [{"SECURITY_CODE": "600519", "NOTICE_DATE": "2024-04-30 00:00:00", "SALES_SERVICES": 1.5e10}]}}
    (tmp_path / "r.json").write_text(json.dumps(page) + "\n" + json.dumps({"result": None}))
    report = ingest.read_report(spark, str(tmp_path / "r.json"), specs.CASHFLOW).collect()
    assert len(report) == 1 and report[0]["cfo"] == 1.5e10 and report[0]["name"] is None

    (tmp_path / "rows.csv").write_text('date,code\n2024-01-02,"sz.000001"\n2024-01-03,""\n')
    assert [r["code"] for r in ingest.read_rows(spark, str(tmp_path / "rows.csv"), ["date", "code"]).collect()] == ["sz.000001", ""]


def test_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, 2020), (2, 2021)], "x int, year int")
    tables.write_table(df, path, ["year"])
    tables.write_table(spark.createDataFrame([(9, 2021)], "x int, year int"), path, ["year"])
    assert sorted(r["x"] for r in tables.read_table(spark, path).collect()) == [1, 9]
    assert tables.read_table(spark, str(tmp_path / "none"), "x int").count() == 0
    assert tables.quarter_books(date(2023, 12, 31), date(2024, 4, 1)) == ["2023_Q4", "2024_Q1", "2024_Q2"]
    with pytest.raises(ValueError):
        tables.quarter_books(date(2024, 1, 1), date(2023, 1, 1))
    stored = tables.read_table(spark, path).withColumn("date", F.make_date("year", F.lit(6), F.lit(1)))
    plan = tables.range_read(stored, date(2021, 1, 1), date(2021, 12, 31))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan
    tables.write_predictions(stored, str(tmp_path / "csv"), date(2020, 1, 1), date(2020, 12, 31), fmt="csv")
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 1


# ---- what is in force at a date ----------------------------------------------------------------


def test_industry_in_force(spark):
    from factorlake.operators.joins import industry_spans, join_industry

    d = date
    rows = [
        ("a", d(2000, 1, 10), "L1", "x1"), ("a", d(2000, 2, 10), "L1", "x2"), ("a", d(2001, 1, 1), "L2", "y1"), ("a", d(2002, 1, 1), "L1", "x1"),
        ("b", d(2000, 5, 1), "L2", "y1"), ("c", None, "L2", "y1"), (None, d(2000, 1, 1), "L1", "x1"),
    ]
    cls = spark.createDataFrame(rows, "ts_code string, join_date date, sw_l1_code string, sw_l3_code string")
    spans = {(r["ts_code"], r["sw_l1_code"], r["valid_from"], r["valid_to"]) for r in industry_spans(cls).collect()}
    assert spans == {
        ("a", "L1", d(2000, 1, 10), d(2001, 1, 1)), ("a", "L2", d(2001, 1, 1), d(2002, 1, 1)), ("a", "L1", d(2002, 1, 1), None),
        ("b", "L2", d(2000, 5, 1), None),
    }
    days = [("a", d(2000, 1, 9)), ("a", d(2000, 1, 10)), ("a", d(2000, 12, 31)), ("a", d(2001, 1, 1)), ("a", d(2030, 1, 1)), ("b", None), ("c", d(2030, 1, 1)), (None, d(2030, 1, 1))]
    reports = spark.createDataFrame(days, "ts_code string, notice_date date")
    got = {tuple(r) for r in join_industry(reports, industry_spans(cls)).collect()}
    assert got == {("a", d(2000, 1, 10), "L1"), ("a", d(2000, 12, 31), "L1"), ("a", d(2001, 1, 1), "L2"), ("a", d(2030, 1, 1), "L1")}


def test_membership_by_date(spark):
    from factorlake.operators.joins import membership_spans, universe_filter

    d = date
    lists = {d(2000, 1, 1): "ab", d(2000, 4, 1): "b", d(2000, 7, 1): "abc", d(2000, 10, 1): "ac"}
    rows = [(day, code) for day, codes in lists.items() for code in codes] + [(d(2000, 1, 1), "a"), (d(2000, 1, 1), None)]
    spans = membership_spans(spark.createDataFrame(rows, "date date, ts_code string"))
    assert {tuple(r) for r in spans.collect()} == {
        ("a", d(2000, 1, 1), d(2000, 4, 1)), ("a", d(2000, 7, 1), None), ("b", d(2000, 1, 1), d(2000, 10, 1)), ("c", d(2000, 7, 1), None),
    }
    asked = [(c, day) for c in "abc" for day in (d(1999, 12, 31), d(2000, 1, 1), d(2000, 3, 31), d(2000, 4, 1), d(2000, 9, 30), d(2000, 10, 1), None)]
    bars = spark.createDataFrame(asked, "ts_code string, date date")
    got = {tuple(r) for r in universe_filter(bars, spans).collect()}
    held = lambda day: next((lists[s] for s in sorted(lists, reverse=True) if s <= day), "")
    assert got == {(c, day) for c, day in asked if day and c in held(day)}


def test_spans_of_several_indexes(spark):
    from factorlake.operators.joins import membership_spans

    rows = [("i", 1, "a"), ("i", 2, "a"), ("j", 1, "a"), ("j", 3, "b")]
    df = spark.createDataFrame(rows, "idx string, n int, ts_code string").selectExpr("idx", "ts_code", "date_add(date'2000-01-01', n) AS date")
    got = {(r["idx"], r["ts_code"], r["valid_from"].day, r["valid_to"] and r["valid_to"].day) for r in membership_spans(df, by=["idx"]).collect()}
    assert got == {("i", "a", 2, None), ("j", "a", 2, 4), ("j", "b", 4, None)}


def test_the_future_changes_no_past_row_of_the_panel(spark):
    """Classification, lists, reports and bars that come in later leave the panel as it was."""
    from factorlake.catalogue import panel as P
    from factorlake.catalogue import views as V
    from factorlake.catalogue.crosssection import classification
    from factorlake.operators.joins import industry_spans, membership_spans
    from factorlake.plans.panel import fundamental_features, market_features, panel_dataset
    from factorlake.operators.skew import durable

    sf, cut = "/root/testdata/sf0.001", date(1998, 6, 30)
    bars, reports = durable(V.bars(spark, sf)), durable(V.statements(spark, sf))
    kinds, lists = durable(classification(spark, sf)), durable(P.snapshots(spark, sf))
    macro = bars.groupBy("date").agg(F.count("*").alias("n_bars"))

    def panel(until):
        keep = lambda df, c: df.where(F.col(c) <= F.lit(until))
        market = market_features(keep(bars, "date")).select("ts_code", "date", "roc_4", "vola_20", "ret_1q")
        return panel_dataset(
            market, fundamental_features(keep(reports, "notice_date")).select("ts_code", "name", "notice_date", "roe"),
            keep(macro, "date"), industry_spans(keep(kinds, "join_date")), membership_spans(keep(lists, "date")),
            factors=["roe"], start=date(1996, 1, 1), end=date(2000, 12, 31), label="ret_1q", min_group_size=1,
        ).where(F.col("date") <= F.lit(cut)).drop("ret_1q")

    early, late = panel(cut).collect(), panel(date(2100, 1, 1)).collect()
    assert len(early) > 20 and sum(r["cs_roe_z"] is not None for r in early) > 5
    assert {r["sw_l1_code"] for r in early} - {None}
    key = lambda rows: sorted(map(str, rows))
    assert key(early) == key(late)


# ---- tables that grow --------------------------------------------------------------------------


def test_appended_rows_recompute_what_they_reach(spark, tmp_path):
    """Any cut of a series into appends gives the table of one append; only bounded state is read."""
    from factorlake.operators.skew import over_series
    from factorlake.sources.incremental import GrowingFeatures

    pick = random.Random(8)
    rows = [(c, d, pick.random() if pick.random() > 0.1 else None) for c, n in (("a", 40), ("b", 3), ("c", 25), (None, 12)) for d in range(n)]
    df = spark.createDataFrame(rows, "k string, d int, x double")
    group = FeatureGroup(
        ("ahead2", "back3", "both", "total"),
        (lambda w: {"ahead2": F.lead("x", 2).over(w), "back3": F.sum("x").over(w.rowsBetween(-3, 0))}, lambda w: {"both": F.lag("ahead2", 4).over(w)}),
        ("x",), back=7, ahead=2, running={"total": F.col("x")},
    )
    want = staged_metrics(df, [group], ["k", "d"], "select", by=["k"], order=["d"]).collect()
    key = lambda r: (r["k"] or "", r["d"])

    def same(got):
        assert len(got) == len(want)
        for g, w in zip(sorted(got, key=key), sorted(want, key=key)):
            assert (g["k"], g["d"]) == (w["k"], w["d"])
            for c in group.outputs:
                assert g[c] == (None if w[c] is None else pytest.approx(w[c], abs=1e-12)), (g, w, c)

    for name, cuts in (("once", [100]), ("three", [5, 12, 13, 100]), ("daily", [1, 2, 3, 4, 30, 31, 100])):
        table = GrowingFeatures(spark, str(tmp_path / name), [group], ["k"], "d", ["k", "d"])
        with pytest.raises(ValueError):
            table.read()
        before = -1
        for cut in cuts:
            table.append(df.where((F.col("d") > before) & (F.col("d") <= cut)))
            before = cut
            sizes = dict(table.state().groupBy("k").count().collect())
            assert all(sizes[c] == min(9, n, cut + 1) for c, n in (("a", 40), ("b", 3), ("c", 25), (None, 12)))
        same(table.read().collect())
    table.append(df.where("false"))
    same(table.read().collect())
    with pytest.raises(ValueError, match="not later"):
        table.append(df.where("k = 'a' and d = 39"))
    same(table.read().collect())


def test_a_failed_append_is_repeated(spark, tmp_path):
    from factorlake.sources.incremental import GrowingFeatures

    df = spark.createDataFrame([("a", i, float(i)) for i in range(10)], "k string, d int, x double")
    group = FeatureGroup(("next",), (lambda w: {"next": F.lead("x").over(w)},), ("x",), back=0, ahead=1)
    table = GrowingFeatures(spark, str(tmp_path / "t"), [group], ["k"], "d", ["k", "d"])
    table.append(df.where("d < 4"))
    for part in ("settled", "open"):  # written, but without the state that makes them valid
        table.read().where("d < 2").write.parquet(table._folder(part, 2))
    assert table.last_batch() == 1 and table.read().count() == 4
    table.append(df.where("d >= 4"))
    assert [r["next"] for r in table.read().orderBy("d").collect()] == [*map(float, range(1, 10)), None]


def test_an_append_stores_every_row_once(spark, tmp_path):
    """No checkpoint of the wide intermediate rows, and no second copy of what is settled."""
    from pathlib import Path

    from factorlake.operators.skew import shared_dir
    from factorlake.sources.incremental import GrowingFeatures

    days = [date(2000, 1, 1) + timedelta(days=i) for i in range(30)]
    df = spark.createDataFrame([(c, d, float(i)) for c in "ab" for i, d in enumerate(days)], "k string, d date, x double")
    group = FeatureGroup(("next",), (lambda w: {"next": F.lead("x").over(w)},), ("x",), back=2, ahead=1)
    table = GrowingFeatures(spark, str(tmp_path / "t"), [group], ["k"], "d", ["k", "d"])
    held = lambda: {str(f) for f in Path(shared_dir(spark).removeprefix("file:")).rglob("part-*")}
    before = held()
    table.append(df)
    assert held() == before
    assert spark.read.parquet(str(tmp_path / "t" / "rows")).count() == 60 == table.read().count()


@pytest.mark.parametrize("max_rows", [2_000_000, 12])
def test_appends_store_outputs_and_inputs_once(spark, tmp_path, max_rows):
    """An append of a few rows writes no more than those and what became final; a read computes the open rows. Also of
    series that are cut into blocks."""
    from factorlake.sources.incremental import GrowingFeatures

    df = spark.createDataFrame([(c, i, float(i)) for c in "ab" for i in range(40)], "k string, d int, x double")
    group = FeatureGroup(("next3",), (lambda w: {"next3": F.lead("x", 3).over(w)},), ("x",), back=5, ahead=3, running={"total": F.col("x")})
    total = FeatureGroup(("total",))
    table = GrowingFeatures(spark, str(tmp_path / "t"), [group, total], ["k"], "d", ["k", "d"], max_rows)
    rows = lambda: spark.read.parquet(str(tmp_path / "t" / "rows"))
    before = -1
    for cut in (19, 20, 21, 39):
        table.append(df.where((F.col("d") > before) & (F.col("d") <= cut)))
        before = cut
        assert rows().where("_part < 2").count() == 2 * (cut + 1 - 3)  # outputs, each once
        got = {(r["k"], r["d"]): (r["next3"], r["total"]) for r in table.read().collect()}
        assert got == {(c, i): (i + 3.0 if i + 3 <= cut else None, i * (i + 1) / 2) for c in "ab" for i in range(cut + 1)}
    assert rows().where("_part > 0").count() == 2 * (8 + 1 + 1 + 18)  # inputs: 8 of the first append, then the new rows
    assert not list(tmp_path.rglob("_part=*"))  # which would have the rows sorted once more


def test_totals_without_reach_go_on(spark, tmp_path):
    """A table of running totals only keeps one row of each series, by which it also knows late rows."""
    from factorlake.sources.incremental import GrowingFeatures

    df = spark.createDataFrame([(i, 1.0) for i in range(9)], "d int, x double").withColumn("k", F.lit("a"))
    group = FeatureGroup(("total",), back=0, ahead=0, running={"total": F.col("x")})
    table = GrowingFeatures(spark, str(tmp_path / "t"), [group], ["k"], "d", ["k", "d"])
    for since, until in ((0, 4), (4, 5), (5, 9)):
        table.append(df.where(f"d >= {since} and d < {until}"))
        assert table.state().count() == 1
    assert [r["total"] for r in table.read().orderBy("d").collect()] == [float(i) for i in range(1, 10)]
    with pytest.raises(ValueError, match="not later"):
        table.append(df.where("d = 8"))


def test_tickers_of_a_write_move_together(spark, tmp_path):
    """A write is moved into place in a bounded number of folders, not in one for each ticker."""
    path = tmp_path / "many"
    df = spark.range(600).select(F.format_string("%06d", "id").alias("ts_code"), F.col("id").cast("double").alias("close"))
    tables.write_tickers(df, str(path))
    (lot,) = [p for p in path.iterdir() if p.is_dir()]
    assert len([p for p in lot.iterdir() if p.is_dir()]) <= tables.DEALS
    assert tables.market_stack_read(spark, str(path)).columns == ["close", "ts_code"]
    assert tables.market_stack_read(spark, str(path)).where("cast(ts_code as int) = close").count() == 600


def test_many_tickers_share_files(spark, tmp_path):
    """A write makes a bounded number of files; few and many tickers, and lots with other columns, are one table."""
    path = tmp_path / "shared"
    code = F.format_string("%06d", "id").alias("ts_code")
    many = spark.range(3000).select(code, F.lit(date(2000, 1, 1)).alias("date"), F.col("id").cast("double").alias("amount"))
    tables.write_tickers(many.unionByName(many.limit(1).withColumn("ts_code", F.lit(None).cast("string"))), str(path))
    assert len(list(path.rglob("*.parquet"))) <= 2 * tables.DEALS
    tables.write_tickers(spark.range(2990, 3010).select(code, F.lit(date(2000, 1, 2)).alias("date"), F.col("id").alias("volume")), str(path))
    stack = tables.market_stack_read(spark, str(path))
    assert stack.columns == ["date", "volume", "amount", "ts_code"] and stack.count() == 3021 and stack.where("ts_code is null").count() == 1
    asked = ["000007", "002995", "003005"]
    frame = spark.createDataFrame([(c,) for c in asked * 2], "ts_code string")
    for wanted, schema in ((asked, None), (frame, stack.schema), (frame, "ts_code string, date date, amount double, volume bigint")):
        some = tables.market_stack_read(spark, str(path), wanted, schema)
        got = sorted(tuple(r) for r in some.select("ts_code", F.dayofmonth("date"), "amount", "volume").collect())
        assert got == [("000007", 1, 7.0, None), ("002995", 1, 2995.0, None), ("002995", 2, None, 2995), ("003005", 2, None, 3005)]
    listed = tables.market_stack_read(spark, str(path), ["000007"])
    scans = [n for n in listed._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in n]
    assert len(scans) == 2 and "_deal#" in scans[1].split("PartitionFilters")[1] and "EqualTo(ts_code,000007)" in scans[1]  # one deal, the ticker in it
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tables.market_stack_read(spark, str(tmp_path / "absent"))


def test_a_code_is_searched_once(spark):
    from factorlake.functions.codes import normalize_ts_code, normalize_ts_code_all_digits

    df = spark.createDataFrame([("sh600001",), ("1",), ("abc",), (None,)], "c string")
    for n, search, last in ((normalize_ts_code_all_digits, "regexp_replace", "SH.600001"), (normalize_ts_code, "regexp_extract", "SH.600001")):
        out = df.select(n("c", add_exchange=True, position="prefix").alias("n"))
        assert out._jdf.queryExecution().optimizedPlan().toString().count(search) == 1
        assert [r["n"] for r in out.collect()] == [last, "SZ.000001", None, None]


def test_formats_are_tried_once_per_distinct_string(spark):
    from factorlake.functions import dates

    df = spark.createDataFrame([("2020-01-02",)] * 10 + [("20200103",)] * 4 + [(None,)], "d string")
    forms = [F.try_to_timestamp("d", F.lit(f)) for f in dates.COLUMN_DATE_FORMATS[:2]]
    scores = dates._scores(df, "d", forms)
    assert tuple(scores.first()) == (15, 10, 4)
    assert "Aggregate [d" in scores._jdf.queryExecution().optimizedPlan().toString()
    assert dates.normalize_date_column(df.where("false"), "d").count() == 0


def test_tickers_are_one_scan(spark, tmp_path):
    path = str(tmp_path / "tickers")
    for i in range(40):
        columns = "ts_code string, date date, close double" + (", amount double" if i % 2 else ", volume bigint")
        row = (f"{i:06d}", date(2000, 1, 1 + i % 9), float(i), float(i) if i % 2 else i)
        tables.write_tickers(spark.createDataFrame([row], columns), path)
    stack = tables.market_stack_read(spark, path)
    plan = stack._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "Union" not in plan
    got = {r["ts_code"]: r for r in stack.collect()}
    assert len(got) == 40 and got["000007"]["amount"] == 7.0 and got["000007"]["volume"] is None and got["000008"]["volume"] == 8
    some = tables.market_stack_read(spark, path, ["000003", "000004"])
    assert {r["ts_code"] for r in some.collect()} == {"000003", "000004"}
    scan = some._jdf.queryExecution().executedPlan().toString()
    assert "IN (000003,000004)]" in scan and "PushedFilters: []" in scan and "Filter " not in scan  # folders only
    again = tables.market_stack_read(spark, path, spark.createDataFrame([("000003",), ("000003",)], "ts_code string"), stack.schema)
    assert again.count() == 1


def test_folds_of_a_row(spark):
    from factorlake.operators.splits import purged_kfold, walk_forward_spans

    df = spark.createDataFrame([(date(2000, 1, 1) + timedelta(days=i), i) for i in range(60)], "date date, i int")
    spans = walk_forward_spans(df, 3, horizon_days=2)
    tagged = spans.tag(df)
    assert tagged.count() == 60 and "Join" not in tagged._jdf.queryExecution().executedPlan().toString()
    rows = {r["i"]: [(m["fold"], m["role"]) for m in r["folds"]] for r in tagged.collect()}
    assert rows[0] == [(0, "train")] and rows[13] == [] and rows[15] == [(0, "test"), (1, "train")] and rows[59] == [(2, "test")]
    wide = {(r["i"], r["fold"], r["role"]) for r in spans.expand(df).collect()}
    assert wide == {(i, *m) for i, ms in rows.items() for m in ms}
    assert "Join" not in purged_kfold(df, 3)._jdf.queryExecution().executedPlan().toString()


def test_ridge_per_fold(spark):
    import numpy as np

    from factorlake.operators.evaluate import fit_walk_forward
    from factorlake.operators.splits import walk_forward_spans

    rng = np.random.default_rng(3)
    rows = []
    for i in range(120):
        for c in "abc":
            x, y = rng.normal(size=2)
            rows.append((date(2000, 1, 1) + timedelta(days=i), c, float(x), None if c == "a" and i % 9 == 0 else float(y), float(2 * x - y + rng.normal() / 9) if i % 7 else None))
    df = spark.createDataFrame(rows, "date date, ts_code string, x double, y double, z double")
    spans = walk_forward_spans(df, 2, horizon_days=3, expanding=True)
    got = {r["fold"]: r for r in fit_walk_forward(df, spans, ["x", "y"], "z", alpha=0.5).collect()}
    for f in spans.spans:
        part = [(np.array([1, r[2], r[3] or 0]), r[4], r[0]) for r in rows if r[4] is not None]
        train = [(a, b) for a, b, d in part if f.train_from <= d < f.cutoff]
        test = [(a, b) for a, b, d in part if f.test_from <= d <= f.test_to]
        a, b = np.array([t[0] for t in train]), np.array([t[1] for t in train])
        w = np.linalg.solve(a.T @ a + np.diag([0, 0.5, 0.5]), a.T @ b)
        r = got[f.fold]
        assert (r["n_train"], r["n_test"]) == (len(train), len(test))
        assert [r["intercept"], r["w_x"], r["w_y"]] == pytest.approx(w.tolist())
        miss = np.array([t[0] @ w - t[1] for t in test])
        assert r["rmse"] == pytest.approx(float(np.sqrt((miss**2).mean()))) and r["mae"] == pytest.approx(float(np.abs(miss).mean()))
    assert fit_walk_forward(df.where("z is null"), spans, ["x"], "z").count() == 0


def test_books_without_rows_are_computed_once(spark, tmp_path):
    asked = []

    def compute(books):
        asked.append(list(books))
        return spark.createDataFrame([(b, 1) for b in books if b != "empty"], "book string, x int")

    path = str(tmp_path / "books")
    for _ in range(2):
        assert tables.read_through(spark, path, ["a", "empty"], compute).count() == 1
    assert tables.read_through(spark, path, ["a", "b", "empty"], compute, stale=["empty"]).count() == 2
    assert asked == [["a", "empty"], ["b", "empty"]]


def test_asof_of_a_bucketed_table_moves_only_the_right_side(spark, tmp_path):
    from factorlake.operators.joins import asof_stored

    pick = random.Random(5)
    days = [(f"{pick.randrange(9)}" if pick.random() > 0.05 else None, date(2000, 1, 1) + timedelta(days=pick.randrange(300)), i) for i in range(900)]
    reports = [(f"{pick.randrange(12)}" if pick.random() > 0.05 else None, date(2000, 1, 1) + timedelta(days=pick.randrange(300)) if pick.random() > 0.05 else None, i) for i in range(90)]
    bars = spark.createDataFrame(days, "ts_code string, date date, i int")
    right = spark.createDataFrame(reports, "ts_code string, notice_date date, n int")
    tables.write_bucketed(bars, "bucketed_bars", str(tmp_path / "bars"), "ts_code", "date")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = asof_stored(spark.table("bucketed_bars"), right, tie_break=["n"])
        plan = got._jdf.queryExecution().executedPlan().toString()
        left = plan[plan.index("SortMergeJoin") : plan.index("bucketed_bars")]
        assert "Bucketed: true" in plan and "Exchange" not in left
        rows = sorted(map(str, got.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE bucketed_bars")
    assert rows == sorted(map(str, joins.asof_backward(bars, right, tie_break=["n"]).collect()))


def test_single_codes_read_few_row_groups(spark, tmp_path):
    """Rows that the scan gives out for one code, of a table clustered by code and of the same rows as they come."""
    df = spark.range(0, 200_000, 1, 4).selectExpr("format_string('%06d', id * 7919 % 500) AS ts_code", "date_add(date'2000-01-01', cast(id / 500 AS int)) AS date", "rand(1) AS close")
    clustered, plain = str(tmp_path / "clustered"), str(tmp_path / "plain")
    tables.write_clustered(df, clustered, "ts_code", "date", row_group_bytes=1 << 16)
    df.write.option("parquet.block.size", str(1 << 16)).parquet(plain)

    def scanned(path):
        found = spark.read.parquet(path).where("ts_code = '000123'")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            plan = found._jdf.queryExecution().executedPlan()
            assert plan.executeCollect().__len__() == 400
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", "true")
        leaf = plan.collectLeaves().head()
        return leaf.metrics().apply("numOutputRows").value()

    few, all_ = scanned(clustered), scanned(plain)
    assert all_ > 100_000 and few < 20_000
