"""Spark results against DuckDB's, as sorted texts of rounded values."""

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def _text(v):
    if v is None or v is pd.NaT or isinstance(v, float) and v != v:
        return "-"
    if isinstance(v, float | np.floating):
        return repr(round(float(v), 9) + 0.0)
    return str(v.tolist() if isinstance(v, np.ndarray) else v)


def rows(df):
    return sorted("|".join(map(_text, r)) for r in df[sorted(df.columns)].itertuples(index=False))


def same(spark_df, con, sql):
    a, b = spark_df.toPandas(), con.sql(sql).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert rows(a) == rows(b)
