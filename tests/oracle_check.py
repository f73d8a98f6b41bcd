"""Local stand-in for the driver's correctness gate.

Runs each registered Spark query and its DuckDB oracle on the same parquet
tables and compares row count, column names and order-insensitive values.
Usage: python tests/oracle_check.py [sf_dir] [name ...]
Env: ORACLE_TZ=<zone> runs Spark under that session time zone;
     ORACLE_EXACT=1 compares floats exactly instead of to 6 digits.
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tests.conftest import make_spark  # noqa: E402
import __spark_entry__ as E  # noqa: E402

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


EXACT = bool(os.environ.get("ORACLE_EXACT"))


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v) if EXACT else round(v, 6)
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    return v


def canon(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 and not sys.argv[1].isidentifier() else "/root/testdata/sf0.01"
    names = [a for a in sys.argv[1:] if a.isidentifier()]
    spark = make_spark()
    if os.environ.get("ORACLE_TZ"):
        spark.conf.set("spark.sql.session.timeZone", os.environ["ORACLE_TZ"])
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if names and name not in names:
            continue
        t0 = time.time()
        try:
            sdf = fn(spark, sf_dir)
            srows = [tuple(r) for r in sdf.collect()]
            scols = sdf.columns
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        dt = time.time() - t0
        if name not in sqls:
            print(f"ROWS {name}: {len(srows)} rows ({dt:.1f}s, no oracle)")
            continue
        try:
            rel = con.sql(sqls[name])
            dcols = rel.columns
            drows = rel.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(e)[:400]}")
            bad += 1
            continue
        if sorted(scols) != sorted(dcols):
            print(f"FAIL {name}: columns {sorted(scols)} vs {sorted(dcols)}")
            bad += 1
            continue
        a, b = canon(srows, scols), canon(drows, dcols)
        if a != b:
            bad += 1
            print(f"FAIL {name}: rows {len(a)} vs {len(b)}")
            sa, sb = set(a), set(b)
            for r in list(sa - sb)[:4]:
                print("   spark only:", r)
            for r in list(sb - sa)[:4]:
                print("   duck  only:", r)
        else:
            print(f"OK   {name}: {len(a)} rows ({dt:.1f}s)")
    spark.stop()
    print("mismatches:", bad)
    sys.exit(1 if bad else 0)


if __name__ == "__main__":
    main()
