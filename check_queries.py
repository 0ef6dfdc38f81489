"""Run registered queries and compare them with DuckDB on the same tables.

    python check_queries.py [sf_dir] [name ...]
"""

import math
import sys
import time

import duckdb

from reviewmill.plans.catalog import QUERIES
from reviewmill.plans.oracle import ORACLE
from reviewmill.session import local_session

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def _same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or (math.isnan(a) and math.isnan(b))
    return type(a) is type(b) and a == b


def difference(spark, con, sf_dir: str, name: str) -> tuple[str, int]:
    """An empty text where the query agrees with its oracle, and the row count."""
    df = QUERIES[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    if name not in ORACLE:
        return ("" if got else "no rows"), len(got)
    cursor = con.execute(ORACLE[name])
    names = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {df.columns} != {names}", len(got)
    order = [df.columns.index(n) for n in names]
    got = [tuple(row[i] for i in order) for row in got]
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}", len(got)
    key = lambda row: tuple((v is None, str(v)) for v in row)
    for a, b in zip(sorted(got, key=key), sorted(want, key=key)):
        if not all(_same(x, y) for x, y in zip(a, b)):
            return f"{a} != {b}", len(got)
    return "", len(got)


if __name__ == "__main__":
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    session, db = local_session("8"), connect(folder)
    for query_name in sys.argv[2:] or QUERIES:
        start = time.time()
        try:
            problem, rows = difference(session, db, folder, query_name)
        except Exception as exc:
            problem, rows = f"{type(exc).__name__}: {str(exc)[:700]}", 0
        print(f"{'ok  ' if not problem else 'FAIL'} {query_name} rows={rows} "
              f"{time.time() - start:.1f}s {'' if query_name in ORACLE else '(rows only)'} {problem[:900]}",
              flush=True)
