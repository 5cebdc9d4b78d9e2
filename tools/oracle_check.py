"""Local correctness loop: run registered Spark queries and their DuckDB
oracles on the same parquet folder and compare rows, schema and values.

    python tools/oracle_check.py [--sf /root/testdata/sf0.01] [name ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from quarry.sources.tables import TABLES  # noqa: E402

SPARK_TO_DUCK = {
    "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "float": "FLOAT", "smallint": "SMALLINT", "tinyint": "TINYINT",
    "timestamp": "TIMESTAMP", "date": "DATE",
}


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 9) + 0.0  # -0.0 and 0.0 compare and sort alike
    if hasattr(v, "tolist"):
        return str(v.tolist())
    if isinstance(v, (list, tuple)):
        return str(list(v))
    return v


def rows_of(records, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in records]
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def duck_conn(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def compare(spark, con, name, fn, sql, sf, verbose=False):
    t0 = time.time()
    sdf = fn(spark, sf)
    srows = [tuple(r) for r in sdf.collect()]
    scols = sdf.columns
    stypes = {f.name: f.dataType.simpleString() for f in sdf.schema.fields}
    t1 = time.time()
    res = {"name": name, "spark_rows": len(srows), "spark_sec": round(t1 - t0, 2)}
    if sql is None:
        res["status"] = "rows-only"
        return res
    cur = con.execute(sql)
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    dtypes = {d[0]: str(d[1]) for d in cur.description}
    res["duck_rows"] = len(drows)
    res["duck_sec"] = round(time.time() - t1, 2)
    problems = []
    if sorted(scols) != sorted(dcols):
        problems.append(f"cols spark={sorted(scols)} duck={sorted(dcols)}")
    else:
        for c in scols:
            st = SPARK_TO_DUCK.get(stypes[c], stypes[c])
            if st != dtypes[c]:
                problems.append(f"type {c}: spark={stypes[c]} duck={dtypes[c]}")
    if len(srows) != len(drows):
        problems.append("row count")
    if not problems:
        a, b = rows_of(srows, scols), rows_of(drows, dcols)
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        if bad:
            problems.append(f"{len(bad)} value mismatches")
            if verbose:
                for x, y in bad[:3]:
                    print("  spark:", str(x)[:400])
                    print("  duck: ", str(y)[:400])
    res["status"] = "ok" if not problems else "FAIL: " + "; ".join(problems)
    return res


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("-v", action="store_true")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    from quarry.plans.registry import load_all
    from quarry.session import get_spark
    checks = load_all()
    spark = get_spark("local[8]", shuffle_partitions=8)
    con = duck_conn(args.sf)
    names = args.names or list(checks)
    failed = 0
    for n in names:
        c = checks[n]
        try:
            r = compare(spark, con, n, c.fn, c.sql, args.sf, args.v)
        except Exception as e:  # noqa: BLE001
            r = {"name": n, "status": f"ERROR {type(e).__name__}: {str(e)[:300]}"}
        failed += not (r["status"] in ("ok", "rows-only"))
        print(r, flush=True)
    print(f"{len(names) - failed}/{len(names)} passed")
    spark.stop()


if __name__ == "__main__":
    main()
