"""Order-insensitive comparison of a Spark result with its DuckDB oracle
(row count, column names, value hash with floats rounded to 6 decimals)."""

from __future__ import annotations

import hashlib
import math

from codeloom.sources.tables import BASE_TABLES


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(repr(tuple(norm(r[i]) for i in order)) for r in rows)


def digest(cols, rows) -> str:
    return hashlib.md5("\n".join(_rows(cols, rows)).encode()).hexdigest()


def compare(df, sql: str, con) -> tuple[bool, str]:
    """``(equal, message)`` for a Spark DataFrame against DuckDB ``sql``."""
    cols, rows = df.columns, [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    ocols, orows = [d[0] for d in cur.description], cur.fetchall()
    if sorted(cols) != sorted(ocols):
        return False, f"columns {cols} vs {ocols}"
    if len(rows) != len(orows):
        return False, f"rows {len(rows)} vs {len(orows)}"
    a, b = _rows(cols, rows), _rows(ocols, orows)
    if a != b:
        first = next((x, y) for x, y in zip(a, b) if x != y)
        return False, f"values differ, e.g. {first[0][:200]} vs {first[1][:200]}"
    return True, f"{len(rows)} rows"
