"""Holds a query against its DuckDB SQL, as the driver does."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def _plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        x = round(float(v), 5)
        return str(x + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(_plain, v)) + "]"
    return str(v)


def compare(frame, con, sql):
    """None if equal, else what differs."""
    rel = con.sql(sql)
    cols = sorted(frame.columns)
    if cols != sorted(rel.columns):
        return f"columns {cols} and {sorted(rel.columns)}"
    spark_rows = sorted(tuple(_plain(r[c]) for c in cols) for r in frame.collect())
    place = [rel.columns.index(c) for c in cols]
    duck_rows = sorted(tuple(_plain(r[i]) for i in place) for r in rel.fetchall())
    if spark_rows == duck_rows:
        return None
    only = [r for r in spark_rows if r not in set(duck_rows)][:3], [r for r in duck_rows if r not in set(spark_rows)][:3]
    return f"{len(spark_rows)} and {len(duck_rows)} rows of {cols}; only Spark {only[0]}; only SQL {only[1]}"
