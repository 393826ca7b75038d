"""Run every registered query against its DuckDB twin (like the driver's gate).

Usage: python tests/oracle_check.py [sf_dir] [name ...]
Prints one line per query: name, rows, match flags, seconds.
"""

from __future__ import annotations

import hashlib
import json
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v)
    return repr(v)


def table_hash(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def main(argv):
    sf = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    only = set(argv[2:])
    import duckdb

    import __spark_entry__ as ent
    from twinfold.session import local_session

    spark = local_session(shuffle_partitions=8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    qs, sqls = ent.queries(), ent.oracle_sql()
    report = {}
    for name, fn in qs.items():
        if only and name not in only:
            continue
        t0 = time.time()
        df = fn(spark, sf)
        rows = [tuple(r) for r in df.collect()]
        cols = df.columns
        secs = time.time() - t0
        if name not in sqls:
            report[name] = {"rows": len(rows), "oracle": None, "sec": round(secs, 2)}
            print(f"{name:28s} rows={len(rows):7d} (no oracle) {secs:.1f}s", flush=True)
            continue
        res = con.execute(sqls[name])
        ocols = [d[0] for d in res.description]
        orows = [tuple(r) for r in res.fetchall()]
        same_cols = sorted(cols) == sorted(ocols)
        same_n = len(rows) == len(orows)
        same_h = table_hash(cols, rows) == table_hash(ocols, orows)
        report[name] = {"rows": len(rows), "cols": same_cols, "count": same_n, "hash": same_h,
                        "sec": round(secs, 2)}
        flag = "OK " if (same_cols and same_n and same_h) else "BAD"
        print(f"{flag} {name:28s} rows={len(rows):7d}/{len(orows):7d} cols={same_cols} hash={same_h} {secs:.1f}s",
              flush=True)
        if not same_cols:
            print("   spark:", cols, "\n   sql:  ", ocols)
        if same_cols and not same_h:
            a = set(tuple(_norm(r[cols.index(c)]) for c in sorted(cols)) for r in rows)
            b = set(tuple(_norm(r[ocols.index(c)]) for c in sorted(cols)) for r in orows)
            print("   only spark:", list(a - b)[:3], "\n   only sql:  ", list(b - a)[:3])
    print(json.dumps(report))


if __name__ == "__main__":
    main(sys.argv)
