"""Run queries next to their SQL in DuckDB and compare the results.

    python tests/oracle.py [name ...]      (SF_DIR sets the data folder)
"""

from __future__ import annotations

import math
import os
import sys
import time
from datetime import date, datetime

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_DIR = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str = SF_DIR):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def session(cores: str = "8"):
    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("factorlake-check")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def _cell(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if isinstance(v, datetime) and v.time() == datetime.min.time():
        return v.date().isoformat()
    if isinstance(v, (date, datetime)):
        return v.isoformat()
    return v


def _sorted(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        ([_cell(r[i]) for i in order] for r in rows), key=lambda r: [str(type(x)) + str(x) for x in r]
    )


def compare(spark, con, name: str, sf_dir: str = SF_DIR, allow_empty: bool = False) -> str | None:
    """None if equal, otherwise what differs."""
    from factorlake.catalogue import QUERIES, SQL

    df = QUERIES[name](spark, sf_dir)
    got_cols, got = _sorted(df.columns, [tuple(r) for r in df.collect()])
    if name not in SQL:
        return None if got else "no rows"
    cur = con.execute(SQL[name])
    want_cols, want = _sorted([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns differ: only spark {set(got_cols) - set(want_cols)}, only sql {set(want_cols) - set(got_cols)}"
    if len(got) != len(want):
        return f"{len(got)} rows, sql {len(want)}"
    if not got and not allow_empty:
        return "no rows"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        g, w = bad[0]
        diff = {c: (x, y) for c, x, y in zip(got_cols, g, w) if x != y}
        return f"{len(bad)}/{len(got)} rows differ, first {dict(list(diff.items())[:4])} in {g[:3]}"
    return None


def main(names):
    from factorlake.catalogue import QUERIES, SQL

    spark, con, failed = session(), connect(), 0
    for name in names or QUERIES:
        t = time.time()
        try:
            problem = compare(spark, con, name)
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok':4} {name:30} {time.time() - t:6.1f}s {'' if name in SQL else '(no sql)'} {problem or ''}", flush=True)
    print(f"{failed} failed")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
