"""Runs a query and its SQL twin over one folder of tables and compares the rows. Usage: python tests/compare.py SF_DIR [NAME...]"""

from __future__ import annotations

import math
import sys
import time
from datetime import date, datetime
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (datetime, date)):
        return v.isoformat(sep=" ") if isinstance(v, datetime) else v.isoformat()
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted(tuple(map(plain, r)) for r in df.select(*names).collect())


def duck_rows(con, sql):
    rel = con.sql(sql)
    names = rel.columns
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rel.fetchall())


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def main(argv: list[str]) -> int:
    import __spark_entry__ as e

    from rowtide.session import local_session

    spark, con = local_session(8), connect(argv[0])
    sql, bad = e.oracle_sql(), 0
    for name, f in e.queries().items():
        if argv[1:] and name not in argv[1:]:
            continue
        t = time.time()
        names, rows = spark_rows(f(spark, argv[0]))
        took = time.time() - t
        if name not in sql:
            print(f"{name}: {len(rows)} rows, {took:.1f} s, no SQL", flush=True)
            continue
        n2, r2 = duck_rows(con, sql[name])
        ok = (names, rows) == (n2, r2)
        bad += not ok
        print(f"{name}: {len(rows)} rows, {took:.1f} s, {'same' if ok else f'DIFFERENT from {len(r2)} {names} {n2}'}", flush=True)
        if not ok:
            a, b = set(rows), set(r2)
            print("  only spark", sorted(a - b)[:3], len(a - b), "\n  only sql", sorted(b - a)[:3], len(b - a), flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
