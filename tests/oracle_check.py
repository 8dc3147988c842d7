"""Compare registered queries with their SQL counterparts: python tests/oracle_check.py [sf] [name ...]."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import __spark_entry__ as entry  # noqa: E402
from tandemtape.session import local_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(repr(v))
    if isinstance(v, int) and not isinstance(v, bool):
        return float(v) if abs(v) < 2**53 else v
    if hasattr(v, "tolist"):
        return plain(v.tolist())
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if type(v).__name__ == "Decimal":
        return float(v)
    return v


def main(sf: str, names: list[str]) -> int:
    folder = f"/root/testdata/sf{sf}"
    spark = local_session()
    spark.sparkContext.setLogLevel("OFF")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or queries:
        start = time.time()
        try:
            df = queries[name](spark, folder)
            cols = sorted(df.columns)
            mine = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"{name:34s} SPARK ERROR {str(e)[:600]}")
            bad += 1
            continue
        took = time.time() - start
        if name not in oracles:
            print(f"{name:34s} rows {len(mine):7d}  (no SQL)  {took:5.1f}s")
            continue
        try:
            start = time.time()
            rel = con.execute(oracles[name])
            theirs_cols = [d[0] for d in rel.description]
            order = [theirs_cols.index(c) for c in cols] if sorted(theirs_cols) == cols else None
            rows = rel.fetchall()
            duck = time.time() - start
        except Exception as e:  # noqa: BLE001
            print(f"{name:34s} SQL ERROR {str(e)[:600]}")
            bad += 1
            continue
        if order is None:
            print(f"{name:34s} COLUMNS {cols} vs {sorted(theirs_cols)}")
            bad += 1
            continue
        theirs = [tuple(plain(r[i]) for i in order) for r in rows]
        a, b = sorted(mine, key=repr), sorted(theirs, key=repr)
        if a == b and a:
            print(f"{name:34s} ok  rows {len(a):7d}  spark {took:5.1f}s sql {duck:4.1f}s")
        else:
            bad += 1
            only_a, only_b = sorted(set(a) - set(b), key=repr), sorted(set(b) - set(a), key=repr)
            print(f"{name:34s} DIFF {len(a)} vs {len(b)}  {took:.1f}s\n   cols {cols}\n   spark {only_a[:2]}\n   sql   {only_b[:2]}")
    print("bad", bad)
    return bad


if __name__ == "__main__":
    args = sys.argv[1:]
    sys.exit(bool(main(args[0] if args else "0.01", args[1:])))
