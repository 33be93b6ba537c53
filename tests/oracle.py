"""Runs queries in Spark and DuckDB and compares the rows.

`python tests/oracle.py [key ...]` prints one line per query.
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as app
from folioframe import local_session
from folioframe.plans.views import TABLES

DATA = os.environ.get("SF_DIR", "/root/testdata/sf0.01")


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def normal(value):
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "NULL" if math.isnan(value) else f"{value:.6g}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(normal(v) for v in value) + "]"
    if hasattr(value, "asDict"):
        return normal(list(value))
    if isinstance(value, dict):
        return normal(list(value.values()))
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(normal(r[i]) for i in order) for r in rows)


KIND = {"tinyint": "int", "smallint": "int", "integer": "int", "int": "int", "bigint": "bigint", "hugeint": "hugeint", "varchar": "string", "float": "float"}


def compare(spark, con, key, folder=DATA):
    """None when equal, else a description of the first difference."""
    df = app.queries()[key](spark, folder)
    columns, left = rows_of(df.columns, df.collect())
    cursor = con.execute(app.oracle_sql()[key])
    names = [d[0] for d in cursor.description]
    types = {d[0]: str(d[1]).lower() for d in cursor.description}
    right_columns, right = rows_of(names, cursor.fetchall())
    if columns != right_columns:
        return f"columns {columns} / {right_columns}", len(left)
    mixed = [
        f"{f.name}:{f.dataType.simpleString()}/{types[f.name]}" for f in df.schema
        if f.dataType.simpleString() != KIND.get(types[f.name], types[f.name])
    ]
    note = f" types {mixed}" if mixed else ""
    if left == right:
        return note or None, len(left)
    only_left = [r for r in left if r not in set(right)][:2]
    only_right = [r for r in right if r not in set(left)][:2]
    return f"rows {len(left)}/{len(right)} spark-only {str(only_left)[:700]} duck-only {str(only_right)[:700]}{note}", len(left)


if __name__ == "__main__":
    session = local_session(8)
    con = connect(DATA)
    keys = sys.argv[1:] or list(app.queries())
    bad = 0
    for key in keys:
        start = time.time()
        try:
            if key in app.oracle_sql():
                difference, n = compare(session, con, key)
            else:
                rows = app.queries()[key](session, DATA).collect()
                difference, n = f" rows only, e.g. {str(rows[:1])[:200]}", len(rows)
        except Exception as error:  # report and go on with the next query
            difference, n = f"ERROR {str(error)[:900]}", -1
        bad += bool(difference) and not difference.startswith(" ")
        print(f"{'ok  ' if not difference else 'note' if difference.startswith(' ') else 'BAD '} {key:24s} {n:7d} rows {time.time() - start:5.1f}s {difference or ''}", flush=True)
    print(f"{len(keys)} queries, {bad} bad")
