"""Industry classification and normalisation within groups."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import functions as F

from ..functions.codes import normalize_ts_code
from ..operators.crosssection import (
    DEFAULT_SECTOR_FACTORS,
    cs_zscore,
    group_stats_over,
    industry_neutral,
    sector_normalize,
)
from ..operators.fundamental import factors, trailing_twelve_months
from ..operators.joins import (
    build_classification,
    classification_asof,
    hierarchy_map,
    industry_l1,
    industry_spans,
    join_industry,
)
from ..operators.skew import durable, shared_dir
from ..sources.ingest import read_industry_level, read_industry_members
from ..sources.specs import INDUSTRY_L1, INDUSTRY_L2, INDUSTRY_L3, INDUSTRY_MEMBERS
from . import views as V
from .fundamental import FACTORS, KEYS, TTM_STAGES
from .registry import nums, query, views

CL = views("classification")
CL_COLS = "ts_code, name, join_date, sw_l3_code, sw_l3_name, sw_l2_code, sw_l2_name, sw_l1_code, sw_l1_name"
AS_OF = date(1999, 6, 30)


def classification(spark, sf):
    return build_classification(
        V.industry_members(spark, sf), hierarchy_map(*V.industry_levels(spark, sf)), normalize_ts_code("ts_code_suffix")
    )


def industry(spark, sf):
    """The latest L1 industry of each code, written once."""
    return durable(industry_l1(classification(spark, sf)))


def spans(spark, sf):
    """The L1 industries with the dates between which they hold, written once."""
    return durable(industry_spans(classification(spark, sf)))


@query(
    "industry_spans",
    f"""{CL}, v AS (SELECT *, lag(sw_l1_code) OVER (PARTITION BY ts_code ORDER BY join_date) AS old FROM classification)
    SELECT ts_code, sw_l1_code, sw_l1_name, join_date AS valid_from, (SELECT min(w.join_date) FROM v w WHERE w.ts_code = v.ts_code
      AND w.join_date > v.join_date AND w.sw_l1_code <> v.sw_l1_code) AS valid_to
    FROM v WHERE old IS DISTINCT FROM sw_l1_code""",
)
def spans_with_names(spark, sf):
    return industry_spans(classification(spark, sf), include_names=True)


@query("hierarchy_map", f"{views('levels')} SELECT * FROM levels")
def levels(spark, sf):
    return hierarchy_map(*V.industry_levels(spark, sf))


query("build_classification", f"{CL} SELECT {CL_COLS} FROM classification")(classification)


@query("industry_sheets", f"{CL} SELECT {CL_COLS} FROM classification")
def sheets(spark, sf):
    """The classification from landed sheets of the three levels and their members."""
    frames = (*V.industry_levels(spark, sf), V.industry_members(spark, sf))
    folders = []
    for frame, names in zip(frames, (INDUSTRY_L1, INDUSTRY_L2, INDUSTRY_L3, INDUSTRY_MEMBERS)):
        landed = {target: source for source, target in names.items() if target in frame.columns}
        folders.append(f"{shared_dir(spark)}/sheet-{uuid.uuid4().hex}")
        frame.withColumnsRenamed(landed).write.csv(folders[-1], header=True)
    levels = [read_industry_level(spark, f, n) for f, n in zip(folders, (1, 2, 3))]
    rows = read_industry_members(spark, folders[3])
    return build_classification(rows, hierarchy_map(*levels), normalize_ts_code("ts_code_suffix"))


def _latest(where: str, cols: str) -> str:
    return f"""{CL} SELECT {cols} FROM (SELECT *, row_number() OVER (PARTITION BY ts_code ORDER BY join_date DESC) AS rn
    FROM classification {where}) WHERE rn = 1"""


@query("classification_asof", _latest("WHERE join_date <= DATE '1999-06-30'", CL_COLS))
def asof(spark, sf):
    return classification_asof(classification(spark, sf), AS_OF)


@query("industry_l1", _latest("WHERE join_date <= DATE '1999-06-30'", "ts_code, sw_l1_code, sw_l1_name"))
def l1(spark, sf):
    return industry_l1(classification(spark, sf), as_of=AS_OF, include_names=True)


@query(
    "join_industry",
    f"{views('statements', 'industry')} SELECT ts_code, notice_date, sw_l1_code, {nums(['net_profit'], 4)} "
    "FROM statements JOIN industry USING (ts_code) WHERE right(ts_code, 1) <> '7'",
    digits=4,
)
def with_industry(spark, sf):
    """Every tenth code is not classified."""
    known = industry(spark, sf).where("right(ts_code, 1) <> '7'")
    return join_industry(V.statements(spark, sf), known).select(
        "ts_code", "notice_date", "sw_l1_code", "net_profit"
    )


# ---- group statistics -------------------------------------------------------------------------


def fundamentals(spark, sf):
    """Factors of all reports, written once: normalisation reads them several times."""
    return durable(factors(V.statements(spark, sf)))


FUND = f"f AS (SELECT {KEYS}, {', '.join(f'{e} AS {n}' for n, e in FACTORS.items())} FROM statements)"


def _bare(c: str) -> str:
    return f"CASE WHEN NOT isnan({c}) THEN {c} END"


def _nearest(c: str, by: str, q: float) -> str:
    lst = f"list_sort(list({_bare(c)}) FILTER (WHERE {c} IS NOT NULL AND NOT isnan({c})) OVER (PARTITION BY {by}))"
    return f"{lst}[1 + round((len({lst}) - 1) * {q}::DOUBLE)::INT]"


def _zscore_sql(src: str, by: str, names: list[str], winsorize: bool, min_size: int = 1) -> tuple[str, str]:
    """(stages, columns) of group z-scores over the rows of ``src``."""
    stats, cols = [f"count(*) OVER (PARTITION BY {by}) AS group_n"], {}
    for c in names:
        stats += [
            f"avg({_bare(c)}) OVER (PARTITION BY {by}) AS {c}_m",
            f"stddev_samp({_bare(c)}) OVER (PARTITION BY {by}) AS {c}_s",
        ]
        x = _bare(c)
        if winsorize:
            stats += [f"{_nearest(c, by, q)} AS {c}_{i}" for i, q in enumerate((0.01, 0.99))]
            x = f"(CASE WHEN {c} IS NOT NULL AND NOT isnan({c}) THEN least(greatest({c}, {c}_0), {c}_1) END)"
            cols[f"cs_{c}_win"] = x
        cols[f"cs_{c}_z"] = f"({x} - {c}_m) / (CASE WHEN {c}_s IS NOT NULL THEN greatest({c}_s, 1e-9) END)"
    stage = f"z1 AS (SELECT *, {', '.join(stats)} FROM {src}), z2 AS (SELECT * FROM z1 WHERE group_n >= {min_size})"
    return stage, nums(cols, 4)


SOME = ["roe", "gross_margin", "current_ratio", "accrual_ratio"]


@query(
    "group_stats_over",
    f"""{views('statements')}, {FUND} SELECT ts_code, notice_date, count(*) OVER (PARTITION BY notice_date) AS group_size,
    {nums({'roe_mean': f"avg({_bare('roe')}) OVER (PARTITION BY notice_date)",
    'roe_std': f"stddev_samp({_bare('roe')}) OVER (PARTITION BY notice_date)",
    'roe_q0': _nearest('roe', 'notice_date', 0.25), 'roe_q1': _nearest('roe', 'notice_date', 0.95)}, 4)} FROM f""",
    digits=4,
)
def stats_over(spark, sf):
    out = group_stats_over(fundamentals(spark, sf), ["notice_date"], ["roe"], (0.25, 0.95))
    return out.select("ts_code", "notice_date", "group_size", "roe_mean", "roe_std", "roe_q0", "roe_q1")


_STAGE, _COLS = _zscore_sql("f", "notice_date", SOME, True)


@query("cs_zscore", f"{views('statements')}, {FUND}, {_STAGE} SELECT ts_code, notice_date, {_COLS} FROM z2", digits=4)
def zscores(spark, sf):
    out = cs_zscore(fundamentals(spark, sf), ["notice_date"], SOME)
    return out.select("ts_code", "notice_date", *[c for c in out.columns if c.startswith("cs_")])


INDUSTRY_FUND = f"{views('statements', 'industry')}, {FUND}, fi AS (SELECT f.*, sw_l1_code FROM f JOIN industry USING (ts_code))"
_SSTAGE, _SCOLS = _zscore_sql("fi", "sw_l1_code, notice_date", SOME, False, 5)


@query(
    "join_industry_in_force",
    f"""{views('statements', 'classification')} SELECT s.ts_code, s.notice_date, c.sw_l1_code, {nums({'net_profit': 's.net_profit'}, 4)}
    FROM statements s ASOF JOIN classification c ON c.ts_code = s.ts_code AND s.notice_date >= c.join_date""",
    digits=4,
)
def in_force(spark, sf):
    """Each report with the industry of its own day; reports from before the first classification drop out."""
    return join_industry(V.statements(spark, sf), spans(spark, sf)).select("ts_code", "notice_date", "sw_l1_code", "net_profit")


@query("sector_normalize", f"{INDUSTRY_FUND}, {_SSTAGE} SELECT ts_code, notice_date, sw_l1_code, {_SCOLS} FROM z2", digits=4)
def sector(spark, sf):
    df = join_industry(fundamentals(spark, sf), industry(spark, sf))
    # A factor that is not there is left out.
    out = sector_normalize(df, ["sw_l1_code", "notice_date"], [*SOME, "not_a_factor"])
    return out.select("ts_code", "notice_date", "sw_l1_code", *[c for c in out.columns if c.startswith("cs_")])


DEFAULTS = list(DEFAULT_SECTOR_FACTORS)
# The industry of a report: the last one joined on or before the day of its notice.
FUND_TTM = f"""{views('statements', 'classification')}, {FUND}, {TTM_STAGES},
    ft AS (SELECT f.*, ttm.ttm_roe, ttm.ttm_cfo_yield, sw_l1_code FROM f
      ASOF JOIN classification c ON c.ts_code = f.ts_code AND f.notice_date >= c.join_date LEFT JOIN ttm
      ON ttm.ts_code = f.ts_code AND ttm.report_date = (date_trunc('quarter', f.notice_date) - INTERVAL 9 MONTH)::DATE)"""


def fundamentals_ttm(spark, sf):
    """Factors of each report with the trailing sums of the window that ends in its quarter."""
    # Read by both sides and by their checks of group sizes: taken from the lines once.
    reports = durable(V.statements(spark, sf))
    f = factors(reports).withColumn(
        "report_date", F.add_months(F.trunc("notice_date", "quarter"), -9).cast("date")
    )
    t = trailing_twelve_months(reports.drop("report_period")).select("ts_code", "report_date", "ttm_roe", "ttm_cfo_yield")
    return durable(f.join(t, ["ts_code", "report_date"], "left").drop("report_date"))


def _neutral(name, by_sql, by):
    stage, cols = _zscore_sql("ft", by_sql, DEFAULTS, True, 5)

    @query(name, f"{FUND_TTM}, {stage} SELECT ts_code, notice_date, sw_l1_code, {cols} FROM z2", digits=4)
    def run(spark, sf):
        out = industry_neutral(fundamentals_ttm(spark, sf), spans(spark, sf), by=by)
        return out.select("ts_code", "notice_date", "sw_l1_code", *[c for c in out.columns if c.startswith("cs_")])


_neutral("industry_neutral", "sw_l1_code, notice_date", ["notice_date"])
# All dates pooled, as an option: later reports shift earlier scores.
_neutral("industry_neutral_pooled", "sw_l1_code", [])
