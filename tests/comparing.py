"""Compare a query's rows with those of its SQL counterpart in DuckDB."""

import math
from pathlib import Path

import duckdb


def plain(value):
    """A value that compares alike from both engines: floats rounded, no decimals or tuples."""
    if isinstance(value, float) or type(value).__name__ == "Decimal":
        value = float(value)
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return [plain(x) for x in value]
    if isinstance(value, dict):
        return {k: plain(x) for k, x in value.items()}
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(([plain(row[i]) for i in order] for row in rows), key=repr)


def by_duckdb(sql, folder):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    got = con.execute(sql)
    return rows_of([c[0] for c in got.description], got.fetchall())


def by_spark(frame):
    return rows_of(frame.columns, [tuple(r) for r in frame.collect()])
