"""Small column helpers shared by the function modules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hash_int(*parts, digits: int = 15) -> Column:
    """Deterministic integer from ``md5(p1:p2:...)`` (first ``digits`` hex digits).

    Chosen over ``xxhash64``/``hash`` because other engines can repeat it:
    DuckDB computes the same value with ``('0x' || substr(md5(..), 1, 15))::bigint``.
    15 digits (60 bits) are far more than any group has rows, so that a draw by
    remainder is even.
    """
    text = F.concat_ws(":", *[col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("bigint")


def round6(c) -> Column:
    return F.round(col(c), 6)
