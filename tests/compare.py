"""A query's rows against those of its SQL in DuckDB: columns sorted by name, rows as a multiset, doubles to nine digits."""

from __future__ import annotations

import decimal
import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    db.execute("SET TimeZone='UTC'")
    for name in TABLES:
        if Path(sf_dir, f"{name}.parquet").exists():
            db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return db


def plain(value: object) -> object:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, decimal.Decimal):
        return float(f"{float(value):.9g}")
    if isinstance(value, list | tuple):
        return tuple(map(plain, value))
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return value


def counted(table) -> tuple[list[str], Counter]:
    """(sorted column names, rows with their counts) of an Arrow table."""
    names = sorted(table.column_names)
    columns = [[plain(v) for v in table.column(n).to_pylist()] for n in names]
    return names, Counter(zip(*columns, strict=True))


def difference(spark_df, db: duckdb.DuckDBPyConnection, sql: str) -> str:
    """What differs, in words; empty where nothing does."""
    got_names, got = counted(spark_df.toArrow())
    want_names, want = counted(db.sql(sql).to_arrow_table())
    if got_names != want_names:
        return f"columns {got_names} against {want_names}"
    more, less = got - want, want - got
    if not more and not less:
        return ""
    return f"{sum(got.values())} rows against {sum(want.values())}; only here {list(more.items())[:3]}; only there {list(less.items())[:3]}"
