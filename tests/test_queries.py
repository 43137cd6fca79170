"""Every registered query against its SQL, on the smallest data set (see oracle.py for larger ones)."""

import pytest
from pyspark.sql import functions as F
from oracle import compare, connect

import __spark_entry__ as entry
from factorlake.catalogue import QUERIES, SQL

SMALL = "/root/testdata/sf0.001"
# Groups of five or more suppliers per region do not exist at the smallest size.
LARGER = "/root/testdata/sf0.01"
NEED_LARGER = {"sector_normalize", "industry_neutral"}


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", [n for n in QUERIES if n != "fit_walk_forward_trees"])
def test_query(spark, con, name):
    if name in NEED_LARGER:
        assert compare(spark, connect(LARGER), name, LARGER) is None
    else:
        assert compare(spark, con, name, SMALL) is None


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) - set(SQL) == {"fit_walk_forward_trees"}
    panel = entry.entry(spark)
    rows, roe, z, known = panel.agg(F.count("*"), F.count("roe"), F.count("cs_roe_z"), F.count("sw_l1_code")).first()
    assert rows > 0 and roe > 0 and z > 0 and known > 0


def test_model_per_window(spark):
    rows = QUERIES["fit_walk_forward_trees"](spark, SMALL).collect()
    assert [r["fold"] for r in rows] == [0, 1, 2]
    assert all(r["n_train"] > 0 and r["n_test"] > 0 and r["rmse"] >= r["mae"] >= 0 for r in rows)
