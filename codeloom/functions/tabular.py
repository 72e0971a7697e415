"""Table functions for SQL users: the functions and calls of a file's text.

    register_table_functions(spark)
    select s.path, f.qualname from src s, lateral extract_functions(s.content) f
    select s.path, c.* from src s, lateral find_calls(s.content, true) c

A row is a function (or call) as in :mod:`codeloom.operators.extract`; a text
that does not parse gives one row with ``error`` alone, a null or empty one none.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from codeloom.operators.extract import Parser, calls_of, functions_of

FUNCTION_ROW = "qualname string, source_code string, description string, signature string, lineno int, error string"
CALL_ROW = "caller string, callee_text string, call_index int, error string"


def _names(columns: str) -> list[str]:
    return [c.split()[0] for c in columns.split(", ")]


def _rows(parser: Parser, fn, names: list[str], content: str | None, include_async: bool | None):
    _, values = parser.columns(fn, [content], bool(include_async), names)
    return zip(*values)


@udtf(returnType=FUNCTION_ROW)
class ExtractFunctions:
    def __init__(self):
        self.parser, self.names = Parser(), _names(FUNCTION_ROW)

    def eval(self, content: str, include_async: bool = False):
        return _rows(self.parser, functions_of, self.names, content, include_async)

    def terminate(self):
        self.parser.close()


@udtf(returnType=CALL_ROW)
class FindCalls:
    def __init__(self):
        self.parser, self.names = Parser(), _names(CALL_ROW)

    def eval(self, content: str, include_async: bool = False):
        return _rows(self.parser, calls_of, self.names, content, include_async)

    def terminate(self):
        self.parser.close()


TABLE_FUNCTIONS = {"extract_functions": ExtractFunctions, "find_calls": FindCalls}


def register_table_functions(spark: SparkSession) -> None:
    """Make the table functions known to the session's SQL."""
    for name, fn in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, fn)
