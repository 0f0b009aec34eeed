"""Runs registered queries in Spark and their oracle statement in DuckDB, and compares rows.

Usage: python tests/compare.py [sf_dir] [name prefix ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return int(v) if v.is_integer() and abs(v) < 1e15 else v
    if isinstance(v, dt.datetime):
        return v.isoformat()
    if isinstance(v, dt.date):
        return dt.datetime(v.year, v.month, v.day).isoformat()
    return v


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark_df, con, sql) -> str | None:
    """None when equal, else a description of the difference."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    expected = result.fetchall()
    if sorted(names) != sorted(spark_df.columns):
        return f"columns differ: {sorted(set(names) ^ set(spark_df.columns))}"
    got = rows_of(spark_df.columns, spark_df.collect())
    want = rows_of(names, expected)
    if got == want:
        return None
    cols = sorted(names)
    extra, missing = list((got - want).elements()), list((want - got).elements())
    note = f"{sum(got.values())} vs {sum(want.values())} rows; {len(extra)} only in Spark"
    if extra and missing:
        # Pair up the rows that agree on most columns, to show which column differs.
        best = max(missing, key=lambda m: sum(a == b for a, b in zip(m, extra[0])))
        diff = [(c, a, b) for c, a, b in zip(cols, extra[0], best) if a != b]
        note += f"; first difference (column, spark, duckdb): {diff}"
    return note


def main() -> int:
    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = entry.local_session()
    con, queries, oracle = duck(sf_dir), entry.queries(), entry.oracle_sql()
    bad = 0
    for name, query in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            df = query(spark, sf_dir)
            if name in oracle:
                problem = compare(df, con, oracle[name])
            else:
                problem = None if df.collect() is not None else "no rows"
        except Exception as e:  # noqa: BLE001 - report every failure
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        bad += problem is not None
        kind = "" if name in oracle else " (rows only)"
        empty = problem is None and name in oracle and not con.execute(
            f"SELECT count(*) FROM ({oracle[name]})").fetchall()[0][0]
        kind += " (empty)" if empty else ""
        print(f"{'ok  ' if problem is None else 'BAD '} {name}{kind} {time.time() - start:.1f}s"
              + (f"\n     {problem}" if problem else ""), flush=True)
    print(f"{bad} different")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
