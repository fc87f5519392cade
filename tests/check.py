"""Compare registered queries with their SQL on one folder: python -m tests.check [sf] [name ...]"""

import datetime as dt
import math
import sys
import time

import duckdb
import pandas as pd

from quaestor.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def cell(v):
    if v is None or v is pd.NaT:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.6f}") + 0.0
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, bool) or isinstance(v, int):
        return v
    return v


def rows(data, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(cell(r[i]) for i in order) for r in data]
    return sorted(out, key=lambda r: tuple((x is not None, str(type(x)), x) if x is not None else (False, "", 0) for x in r))


def compare(df, con, sql):
    got = rows([tuple(r) for r in df.collect()], df.columns)
    rel = con.sql(sql)
    want = rows(rel.fetchall(), rel.columns)
    if sorted(df.columns) != sorted(rel.columns):
        return False, f"columns {sorted(df.columns)} vs {sorted(rel.columns)}", len(got)
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE"}
    types = dict(zip(rel.columns, map(str, rel.types)))
    off = [f"{n} {t} vs {types[n]}" for n, t in df.dtypes if kinds.get(t) != types[n]]
    if off:
        return False, f"types: {off}", len(got)
    if len(got) != len(want):
        extra = set(map(str, got)) ^ set(map(str, want))
        return False, f"{len(got)} rows vs {len(want)}; e.g. {sorted(extra)[:2]}", len(got)
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return False, f"{len(bad)} of {len(got)} rows differ, e.g.\n    {str(bad[0][0])[:700]}\n    {str(bad[0][1])[:700]}", len(got)
    return True, "", len(got)


def main():
    import __spark_entry__ as entry

    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("0.") else "0.01"
    folder = f"/root/testdata/sf{sf}"
    spark = local_session(cores="8")
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, oracles = duck(folder), entry.queries(), entry.oracle_sql()
    names = args or list(queries)
    failed = 0
    for name in names:
        t0 = time.time()
        try:
            df = queries[name](spark, folder)
            if name in oracles:
                ok, why, n = compare(df, con, oracles[name])
            else:
                ok, why, n = True, "rows only", len(df.collect())
        except Exception as e:
            ok, why, n = False, f"{type(e).__name__}: {str(e)[:900]}", -1
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} rows={n} {time.time() - t0:.1f}s {why}", flush=True)
    print("failed", failed)


if __name__ == "__main__":
    main()
