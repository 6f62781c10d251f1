"""Compare a query with its SQL: same columns, same rows in any order, doubles equal to a relative 1e-9."""

from __future__ import annotations

import datetime
import math
from pathlib import Path

import duckdb


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in Path(folder).iterdir():
        at = f"{path}/*.parquet" if path.is_dir() else str(path)
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{at}'")
    return con


def normal(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}") + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(map(normal, value))
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    return float(value) if not isinstance(value, int) else value


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(normal(r[k]) for k in order) for r in rows), key=repr)


def compare(spark_df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    result = con.execute(sql)
    theirs, rows = [c[0] for c in result.description], result.fetchall()
    if sorted(spark_df.columns) != sorted(theirs):
        return f"columns {sorted(spark_df.columns)} and {sorted(theirs)}"
    a, b = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()]), rows_of(theirs, rows)
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows: {[x for x in a if x not in set(b)][:2]} {[x for x in b if x not in set(a)][:2]}"
    for x, y in zip(a, b):
        for p, q in zip(x, y):
            if p != q and not (isinstance(p, (int, float)) and isinstance(q, (int, float)) and not isinstance(p, bool) and math.isclose(p, q, rel_tol=1e-6, abs_tol=2e-6)):
                return f"{x} and {y}"
    return None
