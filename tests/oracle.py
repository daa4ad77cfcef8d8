"""Run a query and its SQL over the same tables and compare them as the driver does."""

import glob
import math
import os

import duckdb

DATA = "/root/testdata/sf0.001"


def connect(sf_dir=DATA):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def norm(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    text = lambda x: ("nan" if math.isnan(x) else repr(x + 0.0)) if isinstance(x, float) else str(x)
    return sorted(columns), sorted(tuple(text(r[i]) for i in order) for r in rows)


def compare(spark, run, sql, sf_dir=DATA):
    df = run(spark, sf_dir)
    got = norm([tuple(r) for r in df.collect()], df.columns)
    out = connect(sf_dir).execute(sql)
    assert got == norm(out.fetchall(), [c[0] for c in out.description])
