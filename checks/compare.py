"""Run registered queries on Spark and their SQL on DuckDB and compare all values.

    python -m checks.compare [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import importlib
import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if hasattr(v, "as_integer_ratio") and not isinstance(v, int):
        return float(v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    entry = importlib.import_module("__spark_entry__")
    from netwatch.session import build_session

    spark = build_session(8, shuffle_partitions=8, **{"spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{args.sf}/{t}.parquet'")
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = []
    for name in args.names or queries:
        start = time.time()
        try:
            df = queries[name](spark, args.sf)
            got = df.collect()
        except Exception as error:  # report and go on with the next query
            print(f"ERROR {name}: {str(error)[:600]}", flush=True)
            bad.append(name)
            continue
        spent = time.time() - start
        if name not in oracle:
            print(f"rows  {name}: {len(got)} rows {spent:.1f}s (no SQL)", flush=True)
            if not got:
                bad.append(name)
            continue
        start = time.time()
        try:
            rel = con.execute(oracle[name])
            cols = [d[0] for d in rel.description]
            want = rel.fetchall()
            types = dict(zip(cols, [str(d[1]) for d in rel.description]))
        except Exception as error:
            print(f"SQL ERROR {name}: {str(error)[:600]}", flush=True)
            bad.append(name)
            continue
        duck = time.time() - start
        if sorted(cols) != sorted(df.columns):
            print(f"DIFF  {name}: columns {sorted(df.columns)} / {sorted(cols)}")
            bad.append(name)
            continue
        kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN"}
        odd = [(c, t, types[c]) for c, t in df.dtypes
               if kinds.get(t, t) != ("VARCHAR" if types[c] == "STRING" else types[c])
               and not (kinds.get(t) == "VARCHAR" and types[c] in ("VARCHAR", "STRING"))]
        a, b = rows_of(df.columns, got), rows_of(cols, want)
        same = a == b
        mark = "ok   " if same and not odd else "DIFF "
        print(f"{mark} {name}: {len(a)}/{len(b)} rows {spent:.1f}s duck {duck:.1f}s"
              + (f" types {odd}" if odd else ""), flush=True)
        if not same or odd:
            bad.append(name)
            ca = sorted(df.columns)
            sa, sb = set(map(repr, a)), set(map(repr, b))
            shown = 0
            for x, y in zip(a, b):
                if repr(x) != repr(y):
                    print("   spark", dict((c, v) for c, v, w in zip(ca, x, y) if v != w or c in ca[:0]))
                    print("   duck ", dict((c, w) for c, v, w in zip(ca, x, y) if v != w))
                    shown += 1
                    if shown == 3:
                        break
            print("   only spark", len(sa - sb), "only duck", len(sb - sa))
    print("failed:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
