"""Run queries() against oracle_sql() on DuckDB and compare rows (order-insensitive)."""
from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 9))
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if v is None:
        return "None"
    if isinstance(v, bool):
        return str(v)
    return str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


_SPARK_TO_DUCK = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
                  "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP"}


def type_diffs(df, con, sql):
    """Columns whose Spark type differs from the oracle's DuckDB type."""
    d = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    out = {}
    for f in df.schema.fields:
        want = _SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString())
        if d.get(f.name) != want:
            out[f.name] = (f.dataType.simpleString(), d.get(f.name))
    return out


def compare(spark, name, fn, sql, sf_dir, con):
    t0 = time.time()
    df = fn(spark, sf_dir)
    sp_cols = df.columns
    sp_rows = [tuple(r) for r in df.collect()]
    t1 = time.time()
    if sql is None:
        return {"name": name, "rows": len(sp_rows), "oracle": None, "ok": None, "sec": t1 - t0}
    res = con.execute(sql)
    dk_cols = [d[0] for d in res.description]
    dk_rows = res.fetchall()
    ok_cols = sorted(sp_cols) == sorted(dk_cols)
    a, b = rows_of(sp_cols, sp_rows), rows_of(dk_cols, dk_rows)
    diff = None
    if a != b:
        sa, sb = set(a), set(b)
        diff = {"spark_only": sorted(sa - sb)[:3], "oracle_only": sorted(sb - sa)[:3]}
    types = type_diffs(df, con, sql)
    return {"name": name, "rows": len(sp_rows), "oracle_rows": len(dk_rows), "cols_ok": ok_cols,
            "type_diffs": types,
            "ok": ok_cols and a == b, "sec": round(t1 - t0, 2), "diff": diff,
            "cols": None if ok_cols else (sorted(sp_cols), sorted(dk_cols))}


def main():
    import __spark_entry__ as E
    from lurescope.session import get_session
    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    only = sys.argv[1:]
    spark = get_session("local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    qs, os_ = E.queries(), E.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if only and name not in only:
            continue
        try:
            r = compare(spark, name, fn, os_.get(name), sf_dir, con)
        except Exception as e:  # report and go on
            r = {"name": name, "ok": False, "error": repr(e)[:2000]}
        if r.get("ok") is False:
            bad += 1
        print(r, flush=True)
    print("FAILED", bad)


if __name__ == "__main__":
    main()
