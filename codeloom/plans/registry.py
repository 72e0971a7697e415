"""Registry of named queries: a Spark plan plus its DuckDB oracle text.

Every query reads the given tables (or views Spark derives from them) through
:class:`codeloom.sources.tables.Tables`.  ``sql`` is the equivalent DuckDB
query over the same tables (the fixture views are prepended as a ``WITH``
list); ``None`` marks operators that SQL cannot express (parsers, model
functions), which are checked against brute force in ``tests/`` instead.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from codeloom.sources.tables import Tables, oracle_with


@dataclass
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    views: list[str] = field(default_factory=list)
    body: str | None = None
    doc: str = ""

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(Tables(spark, sf_dir))

    @property
    def sql(self) -> str | None:
        if self.body is None:
            return None
        return oracle_with(self.views, self.body)


REGISTRY: dict[str, Query] = {}


def query(name: str, views: list[str] | None = None, sql: str | None = None, doc: str = ""):
    """Decorator: register ``fn(tables) -> DataFrame`` under ``name``."""

    def wrap(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, list(views or []), sql, doc or (fn.__doc__ or "").strip())
        return fn

    return wrap


def sql_text(s: str) -> str:
    """A Python string as a SQL expression valid in Spark and DuckDB."""
    pieces = s.split("\n")
    quoted = ["'" + p.replace("'", "''") + "'" for p in pieces]
    out: list[str] = []
    for i, q in enumerate(quoted):
        if i:
            out.append("chr(10)")
        if q != "''":
            out.append(q)
    if not out:
        return "''"
    return "(" + " || ".join(out) + ")"


def load_all() -> dict[str, Query]:
    """Import every query module (they register on import)."""
    from codeloom.plans import catalog  # noqa: F401

    return REGISTRY
