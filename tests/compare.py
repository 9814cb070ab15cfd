"""Run registered queries against their SQL form in DuckDB.

Usage: python tests/compare.py SF_DIR [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _key(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return repr(v)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_key(r[i]) for i in order) for r in rows)


def close(a, b):
    for x, y in zip(a, b, strict=True):
        for p, q in zip(x, y, strict=True):
            if p != q:
                try:
                    if abs(float(p) - float(q)) > 2e-6:
                        return False
                except ValueError:
                    return False
    return True


def check(spark, con, name, fn, sql, sf_dir):
    """(status, rows, seconds, detail) of one query."""
    start = time.time()
    df = fn(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if sql is None:
        return "rows", len(rows), took, ""
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    types = [str(d[1]) for d in got.description]
    want = got.fetchall()
    if sorted(names) != sorted(df.columns):
        return "COLUMNS", len(rows), took, f"{df.columns} vs {names}"
    a, b = canonical(df.columns, rows), canonical(names, want)
    detail = str(sorted(zip(names, types))) + " vs " + str(sorted((f.name, f.dataType.simpleString()) for f in df.schema))
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    mapped = sorted((f.name, kinds.get(f.dataType.simpleString(), "?")) for f in df.schema)
    tag = "" if mapped == sorted(zip(names, types)) else " TYPES " + detail
    if a == b:
        return "equal", len(rows), took, tag
    if len(a) == len(b) and close(a, b):
        return "close", len(rows), took, tag
    diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
    return "DIFF", len(rows), took, f"{len(a)} vs {len(b)} {diff}{tag}"


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries

    from biomeframe.session import build_session

    sf = sys.argv[1]
    spark = build_session(
        os.environ.get("COMPARE_MASTER", "local[8]"), **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g",
                       "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    oracle = oracle_sql()
    for name, fn in queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        try:
            status, n, took, detail = check(spark, con, name, fn, oracle.get(name), sf)
        except Exception as e:  # noqa: BLE001
            status, n, took, detail = "ERROR", -1, 0.0, f"{type(e).__name__}: {str(e)[:600]}"
        print(f"{status:8} {name:28} rows={n:<8} {took:6.2f}s {detail}", flush=True)
