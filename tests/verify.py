"""Runs queries next to their SQL: python tests/verify.py [SF_DIR] [NAME...]."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if hasattr(v, "asDict"):
        return plain(tuple(v.asDict().values()))
    if isinstance(v, dict):
        return plain(tuple(v.values()))
    return str(v) if v is not None else "<null>"


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def main(sf: str, names: list[str]) -> int:
    import duckdb

    import __spark_entry__ as E
    from siltwork.session import local_session

    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        at = f"{p}/*.parquet" if p.is_dir() else p
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{at}')")
    bad = 0
    oracle = E.oracle_sql()
    for name, f in E.queries().items():
        if names and not any(name.startswith(n) for n in names):
            continue
        began = time.time()
        try:
            df = f(spark, sf)
            got = rows_of(df.columns, [tuple(r) for r in df.collect()])
            took = time.time() - began
            if name not in oracle:
                print(f"rows {name}: {len(got)} ({took:.1f} s)", flush=True)
                continue
            cur = con.execute(oracle[name])
            cols = [c[0] for c in cur.description]
            want = rows_of(cols, cur.fetchall())
            ok = got == want and sorted(cols) == sorted(df.columns)
            print(f"{'ok  ' if ok else 'DIFF'} {name}: {len(got)} / {len(want)} ({took:.1f} s)", flush=True)
            if not ok:
                bad += 1
                print("   columns", sorted(df.columns), sorted(cols))
                print("   only here ", sorted(set(got) - set(want))[:3])
                print("   only there", sorted(set(want) - set(got))[:3])
        except Exception as e:
            bad += 1
            print(f"FAIL {name}: {str(e)[:1500]}", flush=True)
    return bad


if __name__ == "__main__":
    args = sys.argv[1:]
    sf = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    sys.exit(main(sf, args))
