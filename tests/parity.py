"""Compares a Spark result with DuckDB's, as the driver does: names, rows, values, in no order."""

import glob
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(t)[:-8]} AS SELECT * FROM '{t + ('/*.parquet' if os.path.isdir(t) else '')}'")
    return con


def plain(v):
    if isinstance(v, float):
        return f"{v + 0.0:.9g}"
    return "NULL" if v is None else str(v)


def same(df, con, sql: str) -> None:
    got = con.execute(sql)
    names = sorted(c[0] for c in got.description)
    assert sorted(df.columns) == names
    at = {c[0]: i for i, c in enumerate(got.description)}
    theirs = sorted(tuple(plain(r[at[c]]) for c in names) for r in got.fetchall())
    ours = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    assert ours == theirs
