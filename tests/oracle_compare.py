"""Spark-vs-DuckDB comparison used by the tests and by ``python -m
tests.oracle_compare`` (row count, column names, order-insensitive values)."""

from __future__ import annotations

import datetime as _dt
import decimal
import math
import sys
import time

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 9) + 0.0
    if isinstance(v, int):
        return v
    if isinstance(v, _dt.datetime):
        return v.isoformat()
    if isinstance(v, _dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    if hasattr(v, "item"):
        return _norm(v.item())
    return str(v)


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cols = [columns[i] for i in order]
    out = sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)
    return cols, out


def compare(spark, key, fn, sql, sf_dir, con=None):
    con = con or duck(sf_dir)
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    scols, s = canon(sdf.columns, srows)
    dcols, d = canon(dcols, drows)
    ok = scols == dcols and len(s) == len(d) and s == d
    detail = ""
    if not ok:
        if scols != dcols:
            detail = f"cols spark={scols} duck={dcols}"
        elif len(s) != len(d):
            detail = f"rows spark={len(s)} duck={len(d)}"
        else:
            diff = [(a, b) for a, b in zip(s, d) if a != b][:3]
            detail = f"values differ e.g. {diff}"
    return ok, detail, len(s), t1 - t0


def main(argv):
    sys.path.insert(0, ".")
    from terrascope.session import get_session
    from __spark_entry__ import oracle_sql, queries
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    only = set(argv[2:])
    spark = get_session("local[8]", 8)
    con = duck(sf_dir)
    qs, sqls = queries(), oracle_sql()
    bad = 0
    for key, fn in qs.items():
        if only and key not in only:
            continue
        if key not in sqls:
            t0 = time.time()
            try:
                n = fn(spark, sf_dir).count()
                print(f"ROWS  {key:28s} rows={n} {time.time() - t0:.1f}s", flush=True)
            except Exception as e:  # noqa: BLE001
                bad += 1
                print(f"ERROR {key:28s} {type(e).__name__}: {str(e)[:300]}", flush=True)
            continue
        try:
            ok, detail, n, secs = compare(spark, key, fn, sqls[key], sf_dir, con)
        except Exception as e:  # noqa: BLE001
            ok, detail, n, secs = False, f"{type(e).__name__}: {str(e)[:400]}", -1, 0
        bad += not ok
        print(f"{'OK  ' if ok else 'FAIL'}  {key:28s} rows={n} {secs:.1f}s {detail}", flush=True)
    print(f"failures: {bad}")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
