"""Compare a registered query with its SQL twin on one data folder."""

from __future__ import annotations

import math
import os
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = os.path.join(folder, f"{t}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return 0.0 if v == 0 else v
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def compare(spark, con, fn, sql: str, folder: str) -> tuple[bool, str]:
    t = time.time()
    df = fn(spark, folder)
    got = [tuple(r) for r in df.collect()]
    spent = time.time() - t
    cur = con.execute(sql)
    ocols, otypes = [d[0] for d in cur.description], [str(d[1]) for d in cur.description]
    want = cur.fetchall()
    stypes = dict(df.dtypes)
    if sorted(df.columns) != sorted(ocols):
        return False, f"columns {sorted(df.columns)} vs {sorted(ocols)}"
    names = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE"}
    bad = [(c, stypes[c], t) for c, t in zip(ocols, otypes) if names.get(stypes[c], stypes[c]) != t]
    if bad:
        return False, f"types {bad}"
    a, b = _rows(df.columns, got), _rows(ocols, want)
    if len(a) != len(b):
        return False, f"rows {len(a)} vs {len(b)}"
    diff = [(x, y) for x, y in zip(a, b) if x != y]
    if diff:
        return False, f"{len(diff)} of {len(a)} rows differ, e.g. {sorted(df.columns)} {diff[0]}"
    return True, f"{len(a)} rows, {spent:.1f}s"


def main(argv):
    """python -m tests.parity FOLDER [query ...]"""
    from __spark_entry__ import oracle_sql, queries
    from pitgauge.session import local_session

    spark, folder = local_session(), argv[0]
    con, qs, os_ = connect(folder), queries(), oracle_sql()
    failed = 0
    for name in argv[1:] or qs:
        try:
            if name in os_:
                ok, msg = compare(spark, con, qs[name], os_[name], folder)
            else:
                t = time.time()
                n = len(qs[name](spark, folder).collect())
                ok, msg = True, f"{n} rows (no SQL twin), {time.time() - t:.1f}s"
        except Exception as e:  # noqa: BLE001
            ok, msg = False, f"{type(e).__name__}: {str(e)[:600]}"
        failed += not ok
        print(("ok   " if ok else "FAIL ") + name, msg, flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    import sys

    main(sys.argv[1:])
