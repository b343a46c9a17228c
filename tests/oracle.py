"""Compare queries with their SQL on a data directory: python tests/oracle.py DIR [NAME...]."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def rows(names: list[str], values: list[tuple]) -> list[tuple]:
    def plain(v):
        if isinstance(v, float):
            return round(v, 6)
        if isinstance(v, (list, tuple)):
            return tuple(map(plain, v))
        return v

    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


def main() -> int:
    import __spark_entry__ as e
    from inkmesh.session import get_spark

    d, only = sys.argv[1], sys.argv[2:]
    db, spark = duckdb.connect(), get_spark()
    spark.sparkContext.setLogLevel("ERROR")
    for p in Path(d).glob("*.parquet"):
        db.execute(f"create view {p.stem} as select * from '{p}'")
    bad, sql = 0, e.oracle_sql()
    for name, f in e.queries().items():
        if only and name not in only:
            continue
        t = time.time()
        df = f(spark, d)
        got = rows(df.columns, [tuple(r) for r in df.collect()])
        s = time.time() - t
        if name not in sql:
            print(f"{name}: {len(got)} rows, {s:.1f} s, no SQL", flush=True)
            continue
        r = db.sql(sql[name])
        want, cols = rows(r.columns, r.fetchall()), sorted(r.columns)
        ok = got == want and cols == sorted(df.columns)
        bad += not ok
        print(f"{name}: {len(got)} rows, {s:.1f} s, {'same' if ok else f'DIFFERS, SQL has {len(want)}'}", flush=True)
        if not ok:
            print("  columns", sorted(df.columns), cols)
            a, b = set(map(repr, got)), set(map(repr, want))
            print("  only query", sorted(a - b)[:3], "\n  only SQL", sorted(b - a)[:3])
    return bad


if __name__ == "__main__":
    sys.exit(main())
