"""Steps whose cost once grew faster than their input: plans that move rows once, and results on both of their routes."""

from datetime import date, timedelta
from pathlib import Path

from pyspark.sql import Window
from pyspark.sql import functions as F

from factorlake.catalogue import QUERIES
from factorlake.catalogue import views as V

SMALL = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df) -> int:
    return plan(df).count("Exchange hashpartitioning")


def test_bars_are_dealt_once(spark):
    bars = V.bars(spark, SMALL)
    assert exchanges(bars) == 1
    followed = bars.withColumn("before", F.lag("close").over(Window.partitionBy("ts_code").orderBy("date")))
    assert exchanges(followed) == 1 and plan(followed).count("Sort [") == 1


def test_bars_of_hot_tickers_are_combined_first(spark, tmp_path, monkeypatch):
    from factorlake.operators import skew

    spark.read.parquet(f"{SMALL}/lineitem.parquet").where("l_suppkey <> 3 OR l_shipdate < '1998-01-01'").write.parquet(f"{tmp_path}/lineitem.parquet")
    want = {tuple(r) for r in V.bars(spark, str(tmp_path)).collect()}
    monkeypatch.setattr(skew.hot_keys, "__defaults__", (500, None))
    monkeypatch.setattr(V, "route", lambda *args: skew.route(*args, max_rows=500))
    mixed = V.bars(spark, str(tmp_path))
    assert "Union" in plan(mixed) and {tuple(r) for r in mixed.collect()} == want


def test_lines_of_a_response_are_shuffled_once(spark):
    assert exchanges(QUERIES["ingest_kline"](spark, SMALL)) == 1


def test_memberships_are_constants_between_bounds(spark):
    from factorlake.operators.splits import Fold, Folds

    day = [date(2000, 1, 1) + timedelta(days=i) for i in range(30)]
    spans = (Fold(0, day[0], day[6], day[8], day[12]), Fold(1, day[3], day[11], day[11], day[20]), Fold(2, day[0], day[20], day[22], date.max))
    df = spark.createDataFrame([(d, e) for d in [None, date.max, *day] for e in (None, d, day[10])], "date date, end date")

    def role(f, d, e, ends):
        if d and f.test_from <= d <= f.test_to:
            return "test"
        return "train" if d and f.train_from <= d < f.cutoff and (not ends or e and e < f.cutoff) else None

    for ends in (None, "end"):
        tagged = Folds(spans, "date", ends).tag(df)
        for d, e, got in tagged.collect():
            want = [(f.fold, role(f, d, e, ends)) for f in spans if role(f, d, e, ends)]
            assert [tuple(m) for m in got] == want
        assert ends or "lambda" not in plan(tagged)


def test_windows_lie_apart(spark):
    """A pass over one window's rows must not read those of the others."""
    from factorlake.operators import evaluate, skew, splits

    df = spark.createDataFrame([(date(2000, 1, 1) + timedelta(days=i // 3), float(i % 7), float(i % 5) if i % 11 else None) for i in range(180)], "date date, x double, y double")
    here = Path(skew.shared_dir(spark).removeprefix("file:"))
    before = set(here.glob("windows-*"))
    windows = splits.walk_forward_spans(df, 2)
    fitted = evaluate.fit_trees_walk_forward(windows.expand(df), ["x"], "y").orderBy("fold").collect()
    (folder,) = set(here.glob("windows-*")) - before
    for r in fitted:
        sizes = [spark.read.parquet(f"{folder}/fold={r['fold']}/role={role}").count() for role in ("train", "test")]
        assert sizes == [r["n_train"], r["n_test"]] and sizes[0] > 0


def test_quantiles_move_only_values_in_their_bracket(spark, monkeypatch):
    """Large groups, with shared values, infinities, nulls and an empty group; also where the sketch is wrong."""
    from factorlake.operators import crosssection

    moved, before = [], crosssection.counts_before

    def counted(tally, *args):
        moved.append(tally.count())
        return before(tally, *args)

    monkeypatch.setattr(crosssection, "counts_before", counted)
    x = "CASE WHEN id % 10 = 3 THEN null WHEN id % 97 = 0 THEN double('inf') WHEN id % 89 = 0 THEN 0.5 WHEN id % 83 = 0 THEN double('nan') ELSE sin(id) END"
    df = spark.range(40_000).selectExpr("nullif(id % 3, 2) AS g", f"{x} AS x", "CASE WHEN id % 3 > 0 THEN cos(id) END AS y")
    qs = {"x0": ("x", 0.01), "x1": ("x", 0.99), "x2": ("x", 0.5), "y0": ("y", 0.01), "y1": ("y", 1.0)}

    def want():
        values = {}
        for g, a, b in df.collect():
            for c, v in (("x", a), ("y", b)):
                values.setdefault((g, c), []).extend([v] if v is not None and v == v else [])
        return {(g, *[sorted(v)[int((len(v) - 1) * q + 0.5)] if (v := values[g, c]) else None for c, q in qs.values()]) for g in (0, 1, None)}

    assert {tuple(r) for r in crosssection.tallied_quantiles(df, ["g"], qs).collect()} == want()
    assert len(moved) == 1 and moved[0] < 2000
    real = F.percentile_approx
    monkeypatch.setattr(crosssection.F, "percentile_approx", lambda c, wanted, accuracy: F.when(F.max("g") == 1, F.array(*[F.lit(9.0)] * len(wanted))).otherwise(real(c, wanted, accuracy)))
    assert {tuple(r) for r in crosssection.tallied_quantiles(df, ["g"], qs).collect()} == want()
    assert len(moved) == 3


def test_market_rows_of_a_panel_stay_in_place(spark, monkeypatch):
    """Reports are brought to the market rows, whose features were computed by code; results are those of the sorted route."""
    from factorlake.plans import panel

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        market = panel.market_features(V.bars(spark, SMALL)).select("ts_code", "date", "roc_4")
        unkeyed = spark.sql("SELECT string(null) AS ts_code, DATE '1998-01-01' AS date, 1d AS roc_4")
        reports = V.statements(spark, SMALL).select("ts_code", "name", "notice_date", "net_profit")
        flow = spark.sql("SELECT DATE '1998-01-01' AS date, 2d AS z")
        stacked = panel.panel_stack(market, reports, flow)
        bare = panel.panel_stack(market, reports, flow.where("false"))
        moved = [line for line in plan(bare).splitlines() if "Exchange hashpartitioning(ts_code" in line]
        assert "Union" not in plan(bare) and len(moved) >= 2
        rows = panel.panel_stack(market.unionByName(unkeyed), reports, flow)
        sorted_route = panel.panel_stack(market.unionByName(unkeyed), reports, flow, max_rows=100)
        assert "Union" in plan(sorted_route) and rows.columns == sorted_route.columns
        assert sorted(map(str, rows.collect())) == sorted(map(str, sorted_route.collect()))
        assert stacked.count() == market.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_panel_is_not_shuffled_for_macro_features(spark):
    from factorlake.operators.joins import join_macro_left

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
    try:
        bars = V.bars(spark, SMALL).select("ts_code", "date", "close")
        macro = V.bars(spark, SMALL).where("date < '1995-03-01'").groupBy("date").agg(F.max("high").alias("top"))
        out = join_macro_left(bars, macro)
        assert "SortMergeJoin" not in plan(out)
        assert sorted(map(str, out.collect())) == sorted(map(str, bars.join(macro, "date", "left").collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
