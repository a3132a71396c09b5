"""Run registered queries on Spark and their oracle SQL on DuckDB; compare.

Usage: python scripts/oracle_check.py [sf_dir] [query ...]
Compares row count, sorted column names and an order-insensitive hash of the
values (floats rendered with repr), like the driver's correctness gate.
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from quarry.plans import ORACLE_SQL, QUERIES  # noqa: E402
from quarry.session import build_session  # noqa: E402
from quarry.sources.tables import TABLES  # noqa: E402


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return repr(float(v))
    if hasattr(v, "item"):
        return norm(v.item())
    if isinstance(v, (list, tuple)):
        return repr([norm(x) for x in v])
    return repr(v)


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(str(norm(r[i])) for i in order) for r in rows)
    return hashlib.sha1("\n".join(lines).encode()).hexdigest(), lines


def main():
    args = sys.argv[1:]
    sf = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("/")] or sorted(QUERIES)
    if os.environ.get("QUARRY_PLAIN_SESSION"):
        from pyspark.sql import SparkSession

        spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
                 .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    else:
        spark = build_session()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    ok = 0
    for name in names:
        t0 = time.time()
        sdf = QUERIES[name](spark, sf)
        srows = [tuple(r) for r in sdf.collect()]
        scols = list(sdf.columns)
        ts = time.time() - t0
        sql = ORACLE_SQL.get(name)
        if sql is None:
            print(f"{name:28s} rows-only spark={len(srows)} ({ts:.1f}s)")
            continue
        res = con.execute(sql)
        ocols = [d[0] for d in res.description]
        orows = res.fetchall()
        duck_to_spark = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string",
                         "BOOLEAN": "boolean", "FLOAT": "float", "HUGEINT": "HUGEINT!", "DECIMAL": "decimal"}
        stypes = {f.name: f.dataType.simpleString() for f in sdf.schema.fields}
        otypes = {d[0]: duck_to_spark.get(str(d[1]).split("(")[0], str(d[1])) for d in res.description}
        tdiff = {c: (stypes.get(c), otypes.get(c)) for c in stypes if stypes.get(c) != otypes.get(c)}
        if tdiff:
            print(f"   type differences: {tdiff}")
        hs, ls = digest(scols, srows)
        ho, lo = digest(ocols, orows)
        same = (sorted(scols) == sorted(ocols)) and len(srows) == len(orows) and hs == ho
        ok += same
        print(f"{name:28s} {'OK ' if same else 'BAD'} spark={len(srows)} oracle={len(orows)} ({ts:.1f}s)")
        if not same:
            print("   cols", sorted(scols), sorted(ocols))
            diff_s = sorted(set(ls) - set(lo))[:5]
            diff_o = sorted(set(lo) - set(ls))[:5]
            print("   spark-only", diff_s)
            print("   oracle-only", diff_o)
    print(f"{ok}/{len([n for n in names if n in ORACLE_SQL])} oracle matches")


if __name__ == "__main__":
    main()
