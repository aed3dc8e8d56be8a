"""Run registered queries and compare each with its SQL twin in DuckDB.

usage: python tools/check.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

from lexmill.plans.registry import _QUERIES, _SQL, MODULES
import importlib
from lexmill.session import get_spark

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def norm(v):
    if isinstance(v, float):
        return None if v != v else float(f"{v:.9g}")
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple(norm(r[i]) for i in order) for r in rows)


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    want = sys.argv[2:]
    mods = [w[4:] for w in want if w.startswith("mod:")]
    want = [w for w in want if not w.startswith("mod:")]
    for m in mods or MODULES:  # importing one module may pull in others
        importlib.import_module(f"lexmill.plans.{m}")
    queries, sqls = dict(_QUERIES), dict(_SQL)
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    spark = get_spark("check", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                      spark__ui__showConsoleProgress="false", spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    bad = []
    for name, fn in queries.items():
        if mods and not any(fn.__module_name__.endswith(m) for m in mods):
            continue
        if want and not any(name.startswith(w) for w in want):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf)
            got = [tuple(r) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"FAIL  {name}: spark {type(e).__name__} {str(e)[:600]}")
            bad.append(name)
            continue
        dt = time.time() - t0
        if name not in sqls:
            print(f"rows  {name:44s} {len(got):7d} {dt:6.2f}s (no SQL)")
            continue
        try:
            t1 = time.time()
            cur = con.execute(sqls[name])
            cols = [d[0] for d in cur.description]
            exp = cur.fetchall()
            d2 = time.time() - t1
        except Exception as e:  # noqa: BLE001
            print(f"FAIL  {name}: duckdb {str(e)[:600]}")
            bad.append(name)
            continue
        if sorted(df.columns) != sorted(cols):
            print(f"FAIL  {name}: columns {sorted(df.columns)} != {sorted(cols)}")
            bad.append(name)
            continue
        a, b = rows_of(df.columns, got), rows_of(cols, exp)
        if a != b:
            extra, miss = list((a - b).items())[:3], list((b - a).items())[:3]
            print(f"FAIL  {name}: {len(got)} vs {len(exp)} cols={sorted(cols)}\n   spark-only {str(extra)[:700]}\n   sql-only   {str(miss)[:700]}")
            bad.append(name)
        else:
            note = " EMPTY" if not got else ""
            print(f"ok    {name:44s} {len(got):7d} {dt:6.2f}s sql {d2:5.2f}s{note}")
    print(f"{len(bad)} bad: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
