"""Spark results against DuckDB's, as bags of rounded rows."""

import glob
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def bag(rows, columns) -> list:
    def plain(x):
        if x is None or x != x:
            return None
        if isinstance(x, float):
            return round(x, 9) + 0.0
        return str(x)[:10] if hasattr(x, "isoformat") else x

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differences(spark, sf_dir: str, query, sql: str) -> list:
    df = query(spark, sf_dir)
    got = bag(df.collect(), df.columns)
    con = database(sf_dir)
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    want = bag(res.fetchall(), names)
    if sorted(names) != sorted(df.columns):
        return [("columns", sorted(df.columns), sorted(names))]
    return [(len(got), len(want))] * (len(got) != len(want)) + [p for p in zip(got, want) if p[0] != p[1]][:3]
