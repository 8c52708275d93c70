"""Compare a query's rows with those of its SQL, whatever their order."""

import os
from decimal import Decimal

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def plain(value):
    if isinstance(value, (float, Decimal)):
        return f"{float(value):.6g}"
    if isinstance(value, (list, tuple)):
        return str([plain(x) for x in value])
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def oracle_rows(sql, folder):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{folder}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    con.execute("SET TimeZone='UTC'")
    out = con.execute(sql)
    names = [d[0] for d in out.description]
    return sorted(names), rows_of(names, out.fetchall())


def spark_rows(df):
    return sorted(df.columns), rows_of(df.columns, df.collect())
