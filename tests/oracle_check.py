"""Run registered queries in Spark and their SQL in DuckDB and compare the rows.

Usage: python tests/oracle_check.py [sf] [name part ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from decimal import Decimal

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def cell(v):
    if v is None:
        return "~null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6))
    if isinstance(v, int):
        return repr(round(float(v), 6))
    return str(v)


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, fn, sql, sf_dir):
    df = fn(spark, sf_dir)
    got = canon(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return got, None, ""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = canon(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return got, want, f"columns {sorted(df.columns)} != {sorted(names)}"
    if got != want:
        extra, missing = sorted(set(got) - set(want))[:2], sorted(set(want) - set(got))[:2]
        return got, want, f"rows {len(got)} vs {len(want)}; only spark {extra}; only sql {missing}"
    return got, want, ""


def main():
    from sowmill.bind import registry
    from sowmill.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    parts = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    if parts and parts[0].endswith("!"):
        registry.MODULES[:] = [parts.pop(0)[:-1]]
    registry.load()
    spark = local_session()
    con = connect(sf_dir)
    bad = 0
    for name, fn in registry.QUERIES.items():
        if parts and not any(name.startswith(p) for p in parts):
            continue
        start = time.time()
        try:
            got, want, problem = compare(spark, con, fn, registry.ORACLE.get(name), sf_dir)
            note = problem or ("rows only" if want is None else "ok")
            if not got:
                note += " EMPTY"
        except Exception as e:  # noqa: BLE001
            got, problem = [], "error"
            note = f"{type(e).__name__}: {str(e)[:1500]}"
        bad += bool(problem)
        print(f"{'FAIL' if problem else 'pass'} {name} {len(got)} rows {time.time() - start:.1f}s {note}", flush=True)
        if os.environ.get("SHOW") and got:
            for r in got[:3]:
                print("     ", r)
    print("failures:", bad)


if __name__ == "__main__":
    main()
