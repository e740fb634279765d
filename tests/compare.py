"""Results of a query beside those of its SQL in DuckDB."""

from __future__ import annotations

import datetime
import math
from collections import Counter
from pathlib import Path

import duckdb


def plain(value):
    """A value that compares: floats rounded, containers as tuples, zone-less times."""
    if value is None or isinstance(value, (bool, int, str, bytes)):
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in sorted(value.items()))
    if hasattr(value, "asDict"):
        return plain(value.asDict())
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return str(value)


def counted(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def spark_rows(df) -> tuple[list[str], Counter]:
    return sorted(df.columns), counted(df.columns, df.collect())


def duckdb_rows(sql: str, sf_dir: str) -> tuple[list[str], Counter]:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    got = con.execute(sql)
    columns = [d[0] for d in got.description]
    return sorted(columns), counted(columns, got.fetchall())


def assert_same(df, sql: str, sf_dir: str) -> None:
    columns, rows = spark_rows(df)
    other_columns, other_rows = duckdb_rows(sql, sf_dir)
    assert columns == other_columns
    assert rows == other_rows, (list((rows - other_rows).items())[:3], list((other_rows - rows).items())[:3], sum(rows.values()), sum(other_rows.values()))
