"""Compare registered queries with their SQL in DuckDB: python tests/check_oracle.py [sf] [name ...]"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(root: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{root}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def key(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        return (1, "nan") if math.isnan(v) else (1, repr(v + 0.0))
    return (1, repr(v))


def frame(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(tuple(key(row[i]) for i in order) for row in rows)


def compare(spark_df, con, sql):
    a_cols, a = frame(spark_df.columns, spark_df.collect())
    cur = con.execute(sql)
    b_cols, b = frame([d[0] for d in cur.description], cur.fetchall())
    if a_cols != b_cols:
        return f"columns {a_cols} != {b_cols}", len(a)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}", len(a)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        x, y = bad[0]
        diff = {c: (p[1], q[1]) for c, p, q in zip(a_cols, x, y) if p != q}
        return f"{len(bad)} of {len(a)} rows differ, first: {[v[1] for v in x][:3]} {dict(list(diff.items())[:4])}", len(a)
    return "", len(a)


def main():
    from __spark_entry__ import oracle_sql, queries
    from crosspanel.session import local_session, release

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:]
    root = f"/root/testdata/sf{sf}"
    spark, con = local_session(8), connect(root)
    qs, sql, failed = queries(), oracle_sql(), 0
    if names and names[0].startswith("@"):
        mod = names[0][1:]
        names = [n for n, f in qs.items() if f.__module__.endswith(mod)]
    for n in names or qs:
        t = time.time()
        try:
            df = qs[n](spark, root)
            if n in sql:
                msg, rows = compare(df, con, sql[n])
            else:
                rows, msg = df.count(), ""
        except Exception as e:  # noqa: BLE001
            msg, rows = f"{type(e).__name__}: {str(e)[:600]}", -1
        release(spark)
        failed += bool(msg)
        print(f"{'FAIL' if msg else 'ok  '} {n:32s} rows={rows} {'oracle' if n in sql else 'rows-only'} {time.time() - t:5.1f}s {msg}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
