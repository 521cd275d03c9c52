"""Run queries on Spark and their oracle text on DuckDB and compare all rows."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, int):
        return f"{float(value):.9g}" if abs(value) < 2**53 else str(value)
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir: str, fn, sql: str) -> tuple[bool, str]:
    t0 = time.time()
    df = fn(spark, sf_dir)
    got_names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    cur = con.execute(sql)
    want_names, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    t2 = time.time()
    times = f"spark {t1 - t0:.1f}s duckdb {t2 - t1:.1f}s rows {len(got)}"
    if got_names != want_names:
        return False, f"columns {got_names} != {want_names}"
    if got != want:
        a, b = set(got), set(want)
        return False, (f"{times} want {len(want)}; only spark {len(a - b)}: {sorted(a - b)[:1]} "
                       f"only duckdb {len(b - a)}: {sorted(b - a)[:1]}")
    return True, times


def main(argv: list[str]) -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from triagelens.plans.catalog import QUERIES
    from triagelens.session import local_session
    from verification.oracle import SQL

    sf_dir, names = argv[0], argv[1:] or list(QUERIES)
    spark, con, bad = local_session(), connect(sf_dir), 0
    for name in names:
        try:
            if name not in SQL:
                t0 = time.time()
                rows = QUERIES[name](spark, sf_dir).collect()
                print(f"rows  {name:28s} {time.time() - t0:.1f}s {len(rows)} {str(rows[:2])[:300]}", flush=True)
                continue
            ok, note = compare(spark, con, sf_dir, QUERIES[name], SQL[name])
        except Exception as e:  # report and go on
            ok, note = False, f"{type(e).__name__}: {str(e)[:700]}"
        bad += not ok
        print(f"{'ok   ' if ok else 'BAD  '} {name:28s} {note[:900]}", flush=True)
    print(f"{bad} differ")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
