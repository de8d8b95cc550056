"""Run registered queries on Spark and on DuckDB and compare the rows."""

from __future__ import annotations

import math
from pathlib import Path


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for f in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def rows_of(records, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_plain(r[i]) for i in order) for r in records)


def _plain(value):
    """Comparable and sortable: nulls first, floats to 9 significant digits."""
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return (0, "")
    if isinstance(value, bool):
        return (1, str(value))
    if isinstance(value, float):
        return (2, f"{value:.9g}")
    if isinstance(value, int):
        return (3, value)
    return (4, str(value))


def differences(con, spark, query, sql, sf_dir):
    """None when both sides agree, otherwise a short description."""
    df = query(spark, sf_dir)
    left_columns, left = rows_of([tuple(r) for r in df.collect()], df.columns)
    cursor = con.execute(sql)
    right_columns, right = rows_of(cursor.fetchall(), [d[0] for d in cursor.description])
    if left_columns != right_columns:
        return f"columns {left_columns} != {right_columns}"
    if len(left) != len(right):
        return f"{len(left)} rows != {len(right)} rows"
    for a, b in zip(left, right):
        if a != b:
            return f"first difference: {a} != {b}"
    return None
