"""Runs a query and its SQL twin and compares names, row counts and values."""
from __future__ import annotations

import datetime
import glob
import math
import os
import sys
import time

import duckdb


def duck(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in sorted(glob.glob(f"{sf}/*.parquet")):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return f"{v + 0.0:.9g}"
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    if v is None:
        return ""
    return str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


SPARK_TO_DUCK = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN",
    "timestamp": "TIMESTAMP", "array<double>": "DOUBLE[]", "array<string>": "VARCHAR[]",
}


def compare(spark, con, sf, name, fn, sql, show=3):
    t0 = time.time()
    df = fn(spark, sf)
    got = df.collect()
    t1 = time.time()
    if sql is None:
        return True, f"{name}: rows={len(got)} (no SQL) spark={t1 - t0:.1f}s"
    rel = con.execute(sql)
    cols = [d[0] for d in rel.description]
    types = {d[0]: str(d[1]) for d in rel.description}
    want = rel.fetchall()
    t2 = time.time()
    msgs = []
    for c, t in df.dtypes:
        w = SPARK_TO_DUCK.get(t)
        if w and c in types and w != types[c] and types[c] not in ("NUMBER", "STRING", "Date", "bool", "list"):
            msgs.append(f"type {c}: spark {t} sql {types[c]}")
    gc, g = rows_of(df.columns, got)
    wc, w = rows_of(cols, want)
    if gc != wc:
        msgs.append(f"columns {gc} vs {wc}")
    elif g != w:
        a, b = set(g) - set(w), set(w) - set(g)
        msgs.append(f"rows {len(g)} vs {len(w)}; only spark {len(a)}, only sql {len(b)}")
        msgs += [f"   cols  {gc}"] + [f"   spark {x}" for x in sorted(a)[:show]] + [f"   sql   {x}" for x in sorted(b)[:show]]
    ok = not msgs
    return ok, f"{'ok  ' if ok else 'FAIL'} {name}: rows={len(g)} spark={t1 - t0:.1f}s sql={t2 - t1:.1f}s " + "\n".join(msgs)


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from spindlewatch.session import local_session

    sf = os.environ.get("SF", "/root/testdata/sf0.01")
    spark = local_session()
    con = duck(sf)
    wanted = sys.argv[1:]
    sqls = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            ok, msg = compare(spark, con, sf, name, fn, sqls.get(name))
        except Exception as e:  # report and go on
            ok, msg = False, f"ERR  {name}: {type(e).__name__} {str(e)[:1500]}"
        bad += not ok
        print(msg, flush=True)
    print("failed:", bad)
