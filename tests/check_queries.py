"""Compare registered queries with their SQL counterparts in DuckDB.

    python tests/check_queries.py [sf_dir] [name ...]

Columns are sorted by name and rows compared as multisets.
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float) and not math.isnan(value):
        return round(value, 6)
    return value


def _multiset(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(spark_df, con, sql: str) -> str | None:
    """None if equal, else what differs."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(names)}"
    want = _multiset(names, cursor.fetchall())
    got = _multiset(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if want == got:
        return None
    return (f"rows spark={sum(got.values())} sql={sum(want.values())}; columns {sorted(names)}; "
            f"only spark {list((got - want))[:2]}; only sql {list((want - got))[:2]}")


def main(argv: list[str]) -> int:
    from siftlane.plans import ORACLES, QUERIES
    from siftlane.session import local_session

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.001"
    names = argv[2:] or list(QUERIES)
    spark, con, bad = local_session(8), connect(sf_dir), 0
    spark.sparkContext.setLogLevel("ERROR")
    for name in names:
        started = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            if ORACLES.get(name):
                problem = compare(df, con, ORACLES[name])
            else:
                problem = f"no SQL; {df.count()} rows"
        except Exception as e:  # report and go on with the other queries
            problem = f"{type(e).__name__}: {str(e)[:700]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - started:.2f}s {problem or ''}", flush=True)
    print(f"{len(names) - bad} of {len(names)} equal")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv))
