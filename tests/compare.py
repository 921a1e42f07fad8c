"""Rows of a Spark query against rows of SQL, order aside."""

import math

import duckdb
import numpy as np

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, bool | np.bool_):
        return str(bool(v))
    if isinstance(v, float | np.floating):
        return f"{v:.9g}"
    if isinstance(v, int | np.integer):
        return str(int(v))
    if isinstance(v, list | np.ndarray):
        return "[" + ",".join(map(plain, v)) + "]"
    return "NULL" if str(v) in ("<NA>", "NaT") else str(v)


def rows(frame):
    return sorted(tuple(plain(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


def by_sql(sql: str, sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con.execute(sql).df()
