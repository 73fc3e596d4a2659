"""Run registered queries in Spark and their oracle SQL in DuckDB; compare like the driver.

usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "item"):
        try:
            return _norm(v.item())
        except Exception:  # noqa: BLE001
            pass
    if hasattr(v, "isoformat"):
        return str(v).replace("T", " ")
    return v


def rows_of(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in records]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def check(spark, name, q, sql, con, sf_dir, verbose=True):
    t0 = time.time()
    sdf = q(spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    scols = sdf.columns
    t1 = time.time()
    if sql is None:
        return {"name": name, "rows": len(srows), "status": "rows-only", "spark_s": round(t1 - t0, 2)}
    res = con.execute(sql)
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    status = "ok"
    detail = ""
    if sorted(scols) != sorted(ocols):
        status, detail = "schema", f"spark={sorted(scols)} oracle={sorted(ocols)}"
    elif len(srows) != len(orows):
        status, detail = "rowcount", f"spark={len(srows)} oracle={len(orows)}"
    else:
        a, b = rows_of(scols, srows), rows_of(ocols, orows)
        if a != b:
            diffs = [(x, y) for x, y in zip(a, b) if x != y]
            status, detail = "values", f"{len(diffs)} diffs, first: {diffs[:2]}"
    return {"name": name, "rows": len(srows), "status": status, "detail": detail, "spark_s": round(t1 - t0, 2)}


def main():
    from riskengine.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    import __spark_entry__ as E

    spark = local_session(8)
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for name, q in qs.items():
        if names and name not in names:
            continue
        try:
            r = check(spark, name, q, sqls.get(name), con, sf_dir)
        except Exception as e:  # noqa: BLE001
            r = {"name": name, "status": "error", "detail": repr(e)[:600]}
        if r["status"] not in ("ok", "rows-only"):
            bad += 1
        print(r, flush=True)
    print("FAILED" if bad else "ALL OK", bad)


if __name__ == "__main__":
    main()
