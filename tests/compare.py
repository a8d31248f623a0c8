"""Rows of a Spark query and of its SQL in a comparable form."""

import os

import duckdb


def plain(x):
    if x is None:
        return "null"
    if hasattr(x, "asDict"):
        return plain(x.asDict())
    if isinstance(x, bool):
        return repr(x)
    if isinstance(x, float):
        return "nan" if x != x else repr(float(f"{x:.9g}"))
    if hasattr(x, "tolist"):
        return plain(x.tolist())
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(plain, x)) + "]"
    if isinstance(x, dict):
        return "{" + ",".join(f"{k}:{plain(y)}" for k, y in x.items()) + "}"
    if type(x).__name__ == "Decimal":
        return repr(int(x)) if x == int(x) else plain(float(x))
    return repr(x)


def connect(sf):
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in os.listdir(sf):
        p = f"{sf}/{t}"
        c.execute(f"create view {t.split('.')[0]} as select * from read_parquet('{p if os.path.isfile(p) else p + '/*.parquet'}')")
    return c


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())


def sql_rows(c, sql):
    cur = c.execute(sql)
    names = [x[0] for x in cur.description]
    cols = sorted(names)
    at = [names.index(k) for k in cols]
    return cols, sorted(tuple(plain(r[i]) for i in at) for r in cur.fetchall())
