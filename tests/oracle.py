"""Run a query and its SQL twin on the same tables and compare the results."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        if Path(f"{folder}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def canonical(value):
    if value is None:
        return (0, "")
    if isinstance(value, bool):
        return (1, str(value))
    if isinstance(value, float):
        return (2, "nan" if math.isnan(value) else repr(value + 0.0))
    return (2, repr(float(value))) if isinstance(value, int) else (3, str(value))


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(canonical(r[i]) for i in order) for r in rows)


def compare(spark, con, folder: str, run, sql: str) -> str | None:
    """None when equal, else what differs."""
    df = run(spark, folder)
    spark_rows = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    duck_rows = rows_of(names, cursor.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    if len(spark_rows) != len(duck_rows):
        extra = sorted(set(spark_rows) - set(duck_rows))[:2], sorted(set(duck_rows) - set(spark_rows))[:2]
        return f"{len(spark_rows)} rows against {len(duck_rows)}: {str(extra)[:700]}"
    for a, b in zip(spark_rows, duck_rows):
        if a != b:
            x = next(i for i in range(len(a)) if a[i] != b[i])
            return f"{sorted(names)[x]}: {str(a)[:500]} against {str(b)[:500]}"
    return None if spark_rows else "no rows on either side"
