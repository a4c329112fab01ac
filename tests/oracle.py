"""Rows of a query and of its SQL, in a form that can be compared."""

from pathlib import Path

import duckdb


def normal(value):
    if isinstance(value, float):
        return repr(round(value, 6) + 0.0)
    return str(value)


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted(tuple(normal(r[n]) for n in names) for r in df.collect())


def sql_rows(sql, sf):
    con = duckdb.connect()
    for f in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    out = con.sql(sql)
    names = sorted(out.columns)
    place = [out.columns.index(n) for n in names]
    return names, sorted(tuple(normal(r[i]) for i in place) for r in out.fetchall())
