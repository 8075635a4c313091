"""Compare every query with its SQL on one table folder."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return db


def cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(row[i]) for i in order) for row in rows), key=repr)


def differences(spark, db, sf: str, build, sql: str) -> str | None:
    """None where both give the same columns, types of cell and rows."""
    df = build(spark, sf)
    got = rows_of(df.columns, [tuple(row) for row in df.collect()])
    result = db.execute(sql)
    names = [column[0] for column in result.description]
    want = rows_of(names, result.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}; {got[:1]} {want[:1]}"
    for a, b in zip(got, want):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"{a!r:.700} != {b!r:.700}"
    return None


if __name__ == "__main__":
    from conftest import session

    sys.path.insert(0, ".")
    from __spark_entry__ import oracle_sql, queries

    folder, wanted = sys.argv[1], sys.argv[2:]
    spark, db = session(), connect(folder)
    for name, build in queries().items():
        if name not in oracle_sql() or wanted and name not in wanted:
            continue
        began = time.time()
        try:
            found = differences(spark, db, folder, build, oracle_sql()[name])
        except Exception as error:
            found = f"{type(error).__name__} {str(error)[:1500]}"
        print(f"{name:26} {time.time() - began:6.2f}s {'ok' if found is None else found}", flush=True)
