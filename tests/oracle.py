"""Rows of a query beside those of its SQL in DuckDB."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def shown(value):
    if value is None or value is pd.NA or value != value:
        return "null"
    if isinstance(value, float):
        return repr(float(value))
    return str(int(value)) if hasattr(value, "__index__") and not isinstance(value, bool) else str(value)


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return list(frame.columns), sorted(tuple(map(shown, r)) for r in frame.itertuples(index=False))
