"""Holds a Spark result against what DuckDB makes of a query's SQL on the same tables."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    if isinstance(v, list | tuple):
        return tuple(map(_plain, v))
    return v.isoformat() if hasattr(v, "isoformat") else v


def rows_of(table) -> Counter:
    """The rows of an Arrow table, columns by name, as a multiset."""
    names = sorted(table.column_names)
    return Counter(tuple(map(_plain, r)) for r in zip(*(table.column(c).to_pylist() for c in names), strict=True))


def kinds_of(table) -> dict[str, str]:
    """Column types up to what engines name differently."""
    out = {}
    for f in table.schema:
        kind = str(f.type).replace("large_", "")
        out[f.name] = "timestamp" if kind.startswith("timestamp") else kind
    return out


def differences(spark_table, duck_table) -> list[str]:
    """What tells the tables apart, in words; nothing where they are the same."""
    out = []
    if (a := kinds_of(spark_table)) != (b := kinds_of(duck_table)):
        out.append(f"types {({k: (a.get(k), b.get(k)) for k in a.keys() | b.keys() if a.get(k) != b.get(k)})}")
    if spark_table.num_rows != duck_table.num_rows:
        out.append(f"{spark_table.num_rows} rows, {duck_table.num_rows} expected")
    if a.keys() == b.keys() and (x := rows_of(spark_table)) != (y := rows_of(duck_table)):
        out.append(f"{sum((x - y).values())} rows differ: {sorted(map(str, (x - y)))[:3]} for {sorted(map(str, (y - x)))[:3]}")
    return out


def compare(spark, query, sql: str, sf_dir: str) -> list[str]:
    with duck(sf_dir) as con:
        return differences(query(spark, sf_dir).toArrow(), con.execute(sql).to_arrow_table())
