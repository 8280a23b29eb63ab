"""Runs registered queries against DuckDB over the same files: ``python tests/oracle.py [SF] [NAME...]``."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

ROOT = os.environ.get("TESTDATA", "/root/testdata")


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in sorted(os.listdir(sf_dir)):
        p = os.path.join(sf_dir, f)
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{p + '/*' if os.path.isdir(p) else p}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    return v


def rows(columns: list[str], data) -> list:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(r[i]) for i in order] for r in data), key=lambda r: [(x is None, str(x)) for x in r])


def compare(spark, con, name: str, sf_dir: str) -> tuple[str, int, float]:
    import __spark_entry__ as e

    t = time.time()
    df = e.queries()[name](spark, sf_dir)
    got = rows(df.columns, df.collect())
    took = time.time() - t
    sql = e.oracle_sql().get(name)
    if sql is None:
        return "no sql", len(got), took
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = rows(cols, cur.fetchall())
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(cols)}", len(got), took
    if got != want:
        extra = [r for r in got if r not in want][:3] if len(got) < 20000 else [(a, b) for a, b in zip(got, want) if a != b][:3]
        lack = [r for r in want if r not in got][:3] if len(got) < 20000 else []
        return f"{len(got)} rows against {len(want)}; only here {extra}; only there {lack}", len(got), took
    return "ok", len(got), took


if __name__ == "__main__":
    import __spark_entry__ as e
    from marginalia.session import local_session

    sf = f"{ROOT}/{sys.argv[1] if len(sys.argv) > 1 else 'sf0.01'}"
    spark, con = local_session(cpus=8), duck(sf)
    names = list(e.queries())
    if sys.argv[2:]:
        names = [n for n in names if any(n == a or a.endswith("*") and n.startswith(a[:-1]) for a in sys.argv[2:])]
    bad = 0
    for n in names:
        try:
            what, count, took = compare(spark, con, n, sf)
        except Exception as x:  # noqa: BLE001
            what, count, took = f"{type(x).__name__}: {str(x)[:700]}", -1, 0
        bad += what not in ("ok", "no sql")
        print(f"{n}: {what} ({count} rows, {took:.1f} s)", flush=True)
    print("bad:", bad)
