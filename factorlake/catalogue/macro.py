"""Market-wide series."""

from __future__ import annotations

from ..operators import macro
from ..sources.ingest import index_bars, margin_merge, northbound_merge, qvix_bars, shibor_rename
from ..sources.specs import CHANNEL_FLOW, SHIBOR
from ..sources.tables import macro_read_all
from ..operators import behavioral
from . import views as V
from .registry import any_sql, clip_sql, flag_sql, lag_sql, mean_sql, nums, query, roll_sql, views


def _roll(agg, x, n, m):
    return roll_sql(agg, x, n, m, by=None)


def _lag(x, n=1):
    return lag_sql(x, n, by=None)


# ---- sources ----------------------------------------------------------------------------------


def northbound(spark, sf):
    """From landed names."""
    landed = {target: source for source, target in CHANNEL_FLOW.items()}
    return northbound_merge([V.channel(spark, sf, s).withColumnsRenamed(landed) for s in ("F", "O")], CHANNEL_FLOW)


def margin(spark, sf):
    return margin_merge([V.margin_raw(spark, sf, 0), V.margin_raw(spark, sf, 1)])


def shibor(spark, sf):
    return shibor_rename(V.shibor_raw(spark, sf))


FLOW_IN = ["net_buy", "fund_inflow", "cum_net_buy"]
MARGIN_IN = ["margin_buy_amount", "margin_balance", "short_sell_volume", "short_balance", "total_margin_balance"]

query("northbound_merge", f"{views('northbound')} SELECT date, {nums(FLOW_IN, 2)} FROM northbound", digits=2)(northbound)
query("margin_merge", f"{views('margin')} SELECT date, {nums(MARGIN_IN, 2)} FROM margin", digits=2)(margin)


def _shibor_columns() -> str:
    base = {"2W_rate": '"1W_rate" * 1.25::DOUBLE', "6M_rate": '"3M_rate" * 1.25::DOUBLE', "9M_rate": '"3M_rate" * 1.5::DOUBLE'}
    out = {}
    for c in SHIBOR.values():
        if c != "date":
            rate = c.replace("_change", "_rate")
            value = base.get(rate, f'"{rate}"')
            out[c] = f"({value}) / 8" if c.endswith("_change") else value
    return nums(out)


query("shibor_rename", f"{views('shibor')} SELECT date, {_shibor_columns()} FROM shibor")(shibor)

query(
    "index_bars",
    f"{views('index_bars')} SELECT date, {nums(['open', 'high', 'low', 'close', 'volume'])} FROM index_bars",
)(lambda spark, sf: index_bars(V.index_raw(spark, sf)))

query("qvix_bars", f"{views('qvix_bars')} SELECT date, {nums(['open', 'high', 'low', 'close'])} FROM qvix_bars")(
    lambda spark, sf: qvix_bars(V.qvix_raw(spark, sf))
)

# ---- channel flow -----------------------------------------------------------------------------

Z = ["nb_flow_z_short", "nb_flow_z", "nb_flow_z_long"]


def _z(mean, m1, std, m2):
    sd = _roll("stddev_samp", "net_buy", std, m2)
    return clip_sql(f"(net_buy - {_roll('avg', 'net_buy', mean, m1)}) / (CASE WHEN {sd} IS NOT NULL THEN greatest({sd}, 1e-8) END)", -10, 10)


FLOW_STAGES = f"""
f1 AS (SELECT *, {_z(10, 5, 30, 10)} AS nb_flow_z_short, {_z(20, 6, 60, 20)} AS nb_flow_z,
    {_z(60, 20, 120, 40)} AS nb_flow_z_long FROM northbound),
f2 AS (SELECT *, {', '.join(f'abs({z}) AS {z}_abs, {flag_sql(z + " > 0")} AS nb_flow_pos_{z}, {flag_sql(f"abs({z}) > 2")} AS nb_flow_shock_{z}' for z in Z)} FROM f1),
f3 AS (SELECT *, greatest({', '.join(f'{z}_abs' for z in Z)}) AS nb_flow_abs_max,
    greatest({', '.join(f'nb_flow_shock_{z}' for z in Z)}) AS nb_flow_shock_any,
    {mean_sql([f'{z}_abs' for z in Z])} AS nb_flow_abs_avg FROM f2)"""
FLOW_COLS = nums([*Z, *[f"{z}_abs" for z in Z], "nb_flow_abs_max", "nb_flow_abs_avg"]) + ", " + ", ".join(
    [f"nb_flow_pos_{z}" for z in Z] + [f"nb_flow_shock_{z}" for z in Z] + ["nb_flow_shock_any"]
)
PERSIST_STAGES = f"""
p1 AS (SELECT *, sign(net_buy) * {_roll('avg', 'abs(net_buy)', 20, 5)} AS nb_flow_conviction,
    {_roll('avg', 'net_buy', 60, 15)} AS nb_flow_trend, {_z(60, 20, 120, 40)} AS zl FROM %s),
p2 AS (SELECT *, {_roll('avg', 'zl', 20, 5)} AS nb_cum_z_trend FROM p1)"""
PERSIST_COLS = nums({"nb_flow_conviction": "nb_flow_conviction", "nb_flow_trend": "nb_flow_trend"}, 2) + ", " + nums(["nb_cum_z_trend"])
ACCEL_STAGES = f"""
a1 AS (SELECT *, net_buy - {_lag('net_buy')} AS nb_flow_delta FROM %s),
a2 AS (SELECT *, nb_flow_delta - {_lag('nb_flow_delta')} AS nb_flow_accel FROM a1),
a3 AS (SELECT *, {clip_sql('nb_flow_accel', -1e6, 1e6)} AS nb_flow_accel_clipped FROM a2),
a4 AS (SELECT *, list_sort(list(abs(nb_flow_accel_clipped)) FILTER (WHERE nb_flow_accel_clipped IS NOT NULL)
    OVER (ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)) AS lst FROM a3),
a5 AS (SELECT *, {flag_sql('nb_flow_accel_clipped > 0')} AS nb_flow_accel_up,
    {flag_sql('nb_flow_accel_clipped < 0')} AS nb_flow_accel_down,
    {flag_sql('abs(nb_flow_accel_clipped) > CASE WHEN len(lst) >= 20 THEN lst[1 + round((len(lst) - 1) * 0.95::DOUBLE)::INT] END')}
    AS nb_flow_shock_accel FROM a4)"""
ACCEL_COLS = nums(["nb_flow_delta", "nb_flow_accel", "nb_flow_accel_clipped"], 2) + (
    ", nb_flow_accel_up, nb_flow_accel_down, nb_flow_shock_accel"
)
NB = views("northbound")


def _money(df, names, digits=2):
    """Large sums are compared to the cent."""
    from pyspark.sql import functions as F

    return df.withColumns({c: F.round(c, digits) for c in names if c in df.columns})


NB_MONEY = ["nb_flow_conviction", "nb_flow_trend", "nb_flow_delta", "nb_flow_accel", "nb_flow_accel_clipped"]


def _nb(**kw):
    return lambda spark, sf: _money(macro.northbound(northbound(spark, sf), **kw), NB_MONEY)


query("nb_flow", f"{NB}, {FLOW_STAGES} SELECT date, {FLOW_COLS} FROM f3")(_nb(groups=["flow"], summary=False))
query("nb_persistence", f"{NB}, {PERSIST_STAGES % 'northbound'} SELECT date, {PERSIST_COLS} FROM p2")(
    _nb(groups=["persistence"], summary=False)
)
query("nb_accel", f"{NB}, {ACCEL_STAGES % 'northbound'} SELECT date, {ACCEL_COLS} FROM a5")(
    _nb(groups=["accel"], summary=False)
)

NB_STAGES = f"{FLOW_STAGES}, {PERSIST_STAGES % 'f3'}, {ACCEL_STAGES % 'p2'}"
NB_SHOCKS = [f"nb_flow_shock_{z}" for z in Z] + ["nb_flow_shock_any", "nb_flow_shock_accel"]
NB_ACCELS = ["nb_flow_accel", "nb_flow_accel_clipped", "nb_flow_accel_up", "nb_flow_accel_down"]
NB_POS = any_sql([f"nb_flow_pos_{z}" for z in Z])


def _nb_metrics(shocks):
    return (
        f"{NB}, {NB_STAGES} SELECT date, {FLOW_COLS}, {PERSIST_COLS}, {ACCEL_COLS}, "
        f"{any_sql(shocks)} AS nb_shock_any, {NB_POS} AS nb_flow_pos_any FROM a5"
    )


query("nb_metrics", _nb_metrics(NB_SHOCKS))(_nb())
query("nb_metrics_raw_any", _nb_metrics(NB_SHOCKS + NB_ACCELS))(_nb(raw_any=True))

# ---- margin and short selling -----------------------------------------------------------------

MS = views("margin")
T = "total_margin_balance"


def _dev(n):
    return clip_sql(f"{T} / (CASE WHEN margin_ma{n} IS NOT NULL THEN greatest(margin_ma{n}, 1e-6) END) - 1", -0.8, 2.0)


LEVEL_STAGES = f"""
l1 AS (SELECT *, {', '.join(f"{_roll('avg', T, n, m)} AS margin_ma{n}" for n, m in ((20, 5), (60, 15), (120, 30)))} FROM %s),
l2 AS (SELECT *, {_dev(60)} AS margin_dev60, {_dev(120)} AS margin_dev120, {_dev(120)} AS leverage_dev FROM l1)"""
LEVEL_COLS = nums([T, "margin_ma20", "margin_ma60", "margin_ma120"], 2) + ", " + nums(["margin_dev60", "margin_dev120", "leverage_dev"])
IMPULSE_STAGES = f"""
i1 AS (SELECT *, {T} - {_lag(T)} AS margin_delta, {clip_sql(f'{T} / {_lag(T)} - 1', -1, 1)} AS margin_delta_pct FROM %s),
i2 AS (SELECT *, {_roll('avg', 'margin_delta_pct', 5, 3)} AS margin_impulse5,
    {_roll('avg', 'margin_delta_pct', 20, 8)} AS margin_impulse20,
    {flag_sql('margin_delta_pct > 0')} AS margin_impulse_up FROM i1)"""
IMPULSE_COLS = nums(["margin_delta"], 2) + ", " + nums(["margin_delta_pct", "margin_impulse5", "margin_impulse20"]) + ", margin_impulse_up"
STRESS_STAGES = f"""
s1 AS (SELECT *, {clip_sql('short_sell_volume / greatest(margin_buy_amount, 1e-6)', 0, 10)} AS short_long_ratio,
    {clip_sql(f'short_balance / greatest({T}, 1e-6)', 0, 2)} AS short_leverage_ratio,
    {_roll('avg', 'short_sell_volume', 20, 5)} AS short_ma20, {_roll('avg', 'short_sell_volume', 60, 15)} AS short_ma60
    FROM %s),
s2 AS (SELECT *, {_roll('avg', 'short_leverage_ratio', 60, 15)} AS lm60 FROM s1),
s3 AS (SELECT *, {flag_sql('short_sell_volume > short_ma20 * 1.5')} AS short_pressure_20d,
    {flag_sql('short_sell_volume > short_ma60 * 1.5')} AS short_pressure_60d,
    {flag_sql('short_leverage_ratio > lm60')} AS short_stress_60d FROM s2),
s4 AS (SELECT *, {any_sql(['short_pressure_20d', 'short_pressure_60d', 'short_stress_60d'])} AS short_stress_any FROM s3)"""
STRESS_COLS = (
    nums(["margin_buy_amount", "margin_balance", "short_sell_volume", "short_balance"], 2)
    + ", "
    + nums(["short_long_ratio", "short_leverage_ratio", "short_ma20", "short_ma60"])
    + ", short_pressure_20d, short_pressure_60d, short_stress_60d, short_stress_any"
)
MS_MONEY = [T, "margin_ma20", "margin_ma60", "margin_ma120", "margin_delta", "margin_buy_amount", "margin_balance", "short_balance"]


def _ms(**kw):
    return lambda spark, sf: _money(macro.margin_short(margin(spark, sf), **kw), MS_MONEY)


query("ms_level", f"{MS}, {LEVEL_STAGES % 'margin'} SELECT date, {LEVEL_COLS} FROM l2")(_ms(groups=["level"], summary=False))
query("ms_impulse", f"{MS}, {IMPULSE_STAGES % 'margin'} SELECT date, {IMPULSE_COLS} FROM i2")(
    _ms(groups=["impulse"], summary=False)
)
query("ms_stress", f"{MS}, {STRESS_STAGES % 'margin'} SELECT date, {STRESS_COLS} FROM s4")(
    _ms(groups=["stress"], summary=False)
)

MS_STAGES = f"{LEVEL_STAGES % 'margin'}, {IMPULSE_STAGES % 'l2'}, {STRESS_STAGES % 'i2'}"
MS_LEVERAGE = any_sql(["leverage_dev > 0.5", "short_stress_60d", "short_stress_any"])


def _ms_metrics(extra):
    push = any_sql(["margin_impulse5 > 0", "margin_impulse20 > 0", *extra, "short_pressure_20d", "short_pressure_60d"])
    return (
        f"{MS}, {MS_STAGES} SELECT date, {LEVEL_COLS}, {IMPULSE_COLS}, {STRESS_COLS}, "
        f"{MS_LEVERAGE} AS overall_leverage_stress, {push} AS margin_flow_pressure FROM s4"
    )


query("ms_metrics", _ms_metrics([]))(_ms())
query("ms_metrics_raw_any", _ms_metrics(["margin_impulse_up > 0"]))(_ms(raw_any=True))

# ---- interbank rates --------------------------------------------------------------------------

SH = views("shibor")


def _sz(x, n, m):
    sd = _roll("stddev_samp", x, n, m)
    return clip_sql(f"({x} - {_roll('avg', x, n, m)}) / (CASE WHEN {sd} IS NOT NULL THEN greatest({sd}, 1e-8) END)", -10, 10)


SHOCK_STAGES = f"""
k1 AS (SELECT *, "ON_rate" - {_lag('"ON_rate"')} AS chg FROM %s),
k2 AS (SELECT *, chg - {_roll('avg', 'chg', 20, 5)} AS shibor_on_shock_short,
    chg - {_roll('avg', 'chg', 60, 15)} AS shibor_on_shock_long FROM k1),
k3 AS (SELECT *, {_sz('shibor_on_shock_short', 60, 15)} AS shibor_on_shock_z_short,
    {_sz('shibor_on_shock_long', 120, 30)} AS shibor_on_shock_z_long FROM k2),
k4 AS (SELECT *, {flag_sql('shibor_on_shock_z_short > 1.5')} AS shibor_liquidity_tighten,
    {flag_sql('shibor_on_shock_z_short > 2.0')} AS shibor_funding_stress FROM k3)"""
SHOCK_COLS = (
    nums(["shibor_on_shock_short", "shibor_on_shock_long", "shibor_on_shock_z_short", "shibor_on_shock_z_long"])
    + ", shibor_liquidity_tighten, shibor_funding_stress"
)
TENORS = ['"ON_rate"', '"1W_rate"', '"1M_rate"', '"3M_rate"', '"1Y_rate"']
_STD = f"list_aggregate(list_filter([{', '.join(TENORS)}], lambda x: x IS NOT NULL), 'stddev_samp')"
CURVE_STAGES = f"""
c1 AS (SELECT *, {clip_sql('"3M_rate" - "ON_rate"', -5, 5)} AS shibor_spread_3m_on,
    {clip_sql('"1Y_rate" - "ON_rate"', -5, 5)} AS shibor_spread_1y_on,
    {clip_sql('"1Y_rate" - "1M_rate"', -5, 5)} AS shibor_slope_long_short,
    {flag_sql('"ON_rate" > "3M_rate"')} AS shibor_inverted_short,
    "3M_rate" - "ON_rate" AS spread, {clip_sql(_STD, 0, 10)} AS shibor_curve_dispersion FROM %s),
c2 AS (SELECT *, spread - {_lag('spread')} AS dspread FROM c1),
c3 AS (SELECT *, {clip_sql(_roll('avg', 'dspread', 5, 3), -2, 2)} AS shibor_spread_3m_mom FROM c2)"""
CURVE_COLS = (
    nums(["shibor_spread_3m_on", "shibor_spread_1y_on", "shibor_slope_long_short", "shibor_spread_3m_mom", "shibor_curve_dispersion"])
    + ", shibor_inverted_short"
)
PRESSURE = ["shibor_on_shock_z_short", "shibor_on_shock_z_long", "shibor_spread_3m_on", "shibor_spread_1y_on", "shibor_spread_3m_mom"]
SHIBOR_STAGES = f"{SHOCK_STAGES % 'shibor'}, {CURVE_STAGES % 'k4'}"
SHIBOR_COLS = (
    f"{SHOCK_COLS}, {CURVE_COLS}, {any_sql(['shibor_funding_stress', 'shibor_inverted_short'])} AS shibor_stress_any, "
    + nums({"shibor_pressure": clip_sql(mean_sql(PRESSURE), -5, 5)})
)


def _sh(**kw):
    return lambda spark, sf: macro.shibor(shibor(spark, sf), **kw)


query("shibor_shock", f"{SH}, {SHOCK_STAGES % 'shibor'} SELECT date, {SHOCK_COLS} FROM k4")(_sh(groups=["shock"], summary=False))
query("shibor_curve", f"{SH}, {CURVE_STAGES % 'shibor'} SELECT date, {CURVE_COLS} FROM c3")(_sh(groups=["curve"], summary=False))
query("shibor_metrics", f"{SH}, {SHIBOR_STAGES} SELECT date, {SHIBOR_COLS} FROM c3")(_sh())

# ---- all books --------------------------------------------------------------------------------


def macro_books(spark, sf):
    return {
        "northbound": macro.northbound(northbound(spark, sf)),
        "marginshort": macro.margin_short(margin(spark, sf)),
        "shibor": macro.shibor(shibor(spark, sf)),
        "index": behavioral.features(index_bars(V.index_raw(spark, sf)), by=None),
        "qvix": behavioral.features(qvix_bars(V.qvix_raw(spark, sf)), by=None),
    }


READ_ALL = {
    "northbound_nb_flow_z": "nb_flow_z",
    "marginshort_margin_dev60": "margin_dev60",
    "shibor_shibor_pressure": "shibor_pressure",
    "index_ma12_dev": "index_dev",
    "qvix_ma12_dev": "qvix_dev",
}


@query(
    "macro_read_all",
    f"""{views('northbound', 'margin', 'shibor', 'qvix_bars')}, {FLOW_STAGES}, {LEVEL_STAGES.replace('l1', 'lv1').replace('l2', 'lv2') % 'margin'},
    {SHIBOR_STAGES}, sp AS (SELECT date, {clip_sql(mean_sql(PRESSURE), -5, 5)} AS shibor_pressure FROM c3),
    ix AS (SELECT date, {clip_sql('close / ' + _roll('avg', 'close', 12, 4) + ' - 1', -10, 10)} AS index_dev FROM index_bars),
    qx AS (SELECT date, {clip_sql('close / ' + _roll('avg', 'close', 12, 4) + ' - 1', -10, 10)} AS qvix_dev FROM qvix_bars)
    SELECT date, {nums({n: e for n, e in READ_ALL.items()})} FROM f3 JOIN lv2 USING (date) JOIN sp USING (date)
    JOIN ix USING (date) JOIN qx USING (date)""",
)
def read_all(spark, sf):
    return macro_read_all(macro_books(spark, sf)).select("date", *READ_ALL)
