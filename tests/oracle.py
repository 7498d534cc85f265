"""Runs queries against their SQL: python tests/oracle.py SF_DIR NAME..."""

from __future__ import annotations

import math
import os
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def plain(x):
    if isinstance(x, float):
        return 0.0 if x == 0 else float(f"{x:.10g}") if math.isfinite(x) else str(x)
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    return x


def compare(spark, name, query, sql, sf_dir):
    t = time.time()
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    t = time.time() - t
    if sql is None:
        return f"{name}: {len(got)} rows, no SQL, {t:.1f} s"
    con = duckdb.connect()
    for f in Path(sf_dir).iterdir():
        if f.suffix == ".parquet":
            con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}{'/*.parquet' if f.is_dir() else ''}'")
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    want = rows_of(columns, cur.fetchall())
    types = dict(zip(columns, (str(d[1]) for d in cur.description)))
    if sorted(columns) != sorted(df.columns):
        return f"{name}: MISMATCH columns {sorted(df.columns)} {sorted(columns)}"
    if got != want:
        only = [x for x in got if x not in set(want)][:3] if len(got) < 20000 else []
        other = [x for x in want if x not in set(got)][:3] if len(got) < 20000 else []
        return f"{name}: MISMATCH {len(got)} {len(want)} only Spark {only} only SQL {other} types {types} {df.dtypes}"
    return f"{name}: ok {len(got)} rows, {t:.1f} s"


if __name__ == "__main__":
    import __spark_entry__ as e
    from setweave.runtime import session

    spark = session(cpus=os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    queries, sqls = e.queries(), e.oracle_sql()
    for name in sys.argv[2:] or queries:
        try:
            print(compare(spark, name, queries[name], sqls.get(name), sys.argv[1]), flush=True)
        except Exception as x:
            print(f"{name}: ERROR {type(x).__name__} {str(x)[:600]}", flush=True)
