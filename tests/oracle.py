"""Comparison of a query with its SQL, run by DuckDB on the same files."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    c.execute("set TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.execute(f"create view {t} as select * from read_parquet('{p}/*.parquet')" if os.path.isdir(p) else f"create view {t} as select * from read_parquet('{p}')")
    return c


def as_set(frame):
    cols = sorted(frame.columns)
    frame = frame[cols].astype(object).where(frame[cols].notna(), None)
    text = frame.apply(lambda c: c.map(lambda v: repr(round(v, 9)) if isinstance(v, float) else str(v)))
    return cols, sorted(map(tuple, text.values.tolist()))
