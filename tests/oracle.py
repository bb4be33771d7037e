"""Compare registered queries with their SQL twins: ``python tests/oracle.py [sf] [name prefix …]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
DATA = os.environ.get("TESTDATA", "/root/testdata")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(float(f"{v:.12g}"))
    if type(v).__name__ == "Decimal":
        return repr(float(v))
    if isinstance(v, bool) or v is None:
        return repr(v)
    if isinstance(v, int):
        return repr(v)
    return str(v)


def normal_rows(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark, con, fn, sql: str | None, sf_dir: str) -> tuple[bool, str]:
    df = fn(spark, sf_dir)
    got = normal_rows(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return True, f"{len(got)} rows (no oracle)"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = normal_rows(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}"
    if got != want:
        a, b = set(got), set(want)
        return False, f"rows {len(got)} vs {len(want)}; only spark {sorted(a - b)[:3]}; only sql {sorted(b - a)[:3]}"
    return True, f"{len(got)} rows"


def main() -> int:
    from loglake.session import build_session
    from loglake.plans import all_queries

    sf, prefixes = (sys.argv[1] if len(sys.argv) > 1 else "0.01"), tuple(sys.argv[2:])
    sf_dir = f"{DATA}/sf{sf}"
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    runs, oracles = all_queries()
    bad = 0
    for name, fn in runs.items():
        if prefixes and not name.startswith(prefixes):
            continue
        t = time.time()
        try:
            ok, note = compare(spark, con, fn, oracles.get(name), sf_dir)
        except Exception as e:
            ok, note = False, f"{type(e).__name__}: {str(e)[:600]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - t:.1f}s {note}", flush=True)
    print(f"{bad} failed")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
