"""Compares a query with its SQL on DuckDB over the same tables."""

import math
from pathlib import Path

import duckdb

#: The smallest tables.
TABLES = Path("/root/testdata/sf0.001")


def plain(value) -> str:
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    if isinstance(value, float):
        return f"{value:.9g}"
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return "{" + ",".join(f"{k}:{plain(v)}" for k, v in sorted(value.items())) + "}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(plain, value)) + "]"
    return str(value)


def disagreement(spark, query, sql: str) -> str | None:
    """What differs, or ``None``."""
    found = query(spark, str(TABLES))
    names = sorted(found.columns)
    got = sorted(tuple(plain(r[n]) for n in names) for r in found.collect())
    with duckdb.connect() as engine:
        for table in TABLES.glob("*.parquet"):
            engine.execute(f"CREATE VIEW {table.stem} AS FROM '{table}'")
        rows = engine.execute(sql)
        own = [d[0] for d in rows.description]
        if sorted(own) != names:
            return f"columns {names} and {sorted(own)}"
        want = sorted(tuple(plain(r[own.index(n)]) for n in names) for r in rows.fetchall())
    if got == want:
        return None
    return f"{len(got)} and {len(want)} rows; {sorted(set(got) - set(want))[:2]} and {sorted(set(want) - set(got))[:2]}"
