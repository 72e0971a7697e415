"""Symbol and log-line column functions for call-graph cleaning.

Every function mirrors one string rule of the original pipeline exactly,
including its edge cases (``find`` returning -1, slices past the end), using
only built-in expressions so the work stays in generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeloom.functions.text import strip_ws
from codeloom.functions.util import col

# Fixed values
MODULE_TOKEN = "<module>"
FROM_TOKEN = "(from "
ANSI_PREFIX_LEN = 4  # an ESC[0m colour reset precedes every logged name
PHASE_MARKER = "Main interprocedural analysis phase..."
HEADER_SUFFIX = "functions will be analyzed."


def strip_overload_suffix(c) -> Column:
    """Drop a trailing ``::d`` (one digit only)."""
    return F.regexp_replace(col(c), r"::[0-9]$", "")


def bare_name(c) -> Column:
    """Text after the last ``:`` (whole text if none)."""
    return F.substring_index(col(c), ":", -1)


def readable_name(c) -> Column:
    """Text after the first ``.``; the whole text if there is none."""
    return F.regexp_replace(col(c), r"^[^.]*\.", "")


def dotted_name(c) -> Column:
    """Text after ``<module>:`` with ``:`` turned into ``.``.

    Without ``<module>`` the original rule yields the symbol's last character;
    that case is reproduced here and callers treat it as unresolvable.
    """
    c = col(c)
    at = F.instr(c, MODULE_TOKEN)
    tail = F.when(at > 0, F.substr(c, at)).otherwise(F.substr(c, F.lit(-1)))
    rest = F.substr(tail, F.instr(tail, ":") + 1)
    return F.replace(rest, F.lit(":"), F.lit("."))


def qualified_node(path, symbol) -> Column:
    """``path`` without its last two characters (``py``) + dotted name."""
    p = col(path)
    return F.concat(F.substr(p, F.lit(1), F.length(p) - 2), dotted_name(symbol))


def local_module(path, root) -> Column:
    """Path relative to the package root, without ``.py``."""
    p = col(path)
    r = col(root) if not isinstance(root, str) else F.lit(root)
    start = F.length(r) + 2
    return F.substr(p, start, F.length(p) - start + 1 - 3)


def is_number(c) -> Column:
    return col(c).rlike(r"^-?[0-9]+(\.[0-9]+)?$")


# A counter is two whole numbers inside the first parentheses.  Python's rule
# takes the text after the first "(" (all of it when there is none) up to the
# first ")" (or drops the last character when there is none); one regular
# expression encodes both fallbacks so the column stays a single compact
# expression instead of nested substring trees.
_PROGRESS = r"^(?:[^(]*\(|(?=[^(]*$))(-?[0-9]+)/(-?[0-9]+)(?:\)|[^)]$)"


def parse_progress(c) -> Column:
    """``(i/n)`` counter of a log line as ``struct<i bigint, n bigint>``, else null.

    Only the first parentheses count and both parts must be whole numbers.
    """
    c = col(c)
    i = F.regexp_extract(c, _PROGRESS, 1).try_cast("bigint")
    n = F.regexp_extract(c, _PROGRESS, 2).try_cast("bigint")
    return F.when(c.rlike(_PROGRESS), F.struct(i.alias("i"), n.alias("n")))


def parse_log_entry(line, root) -> Column:
    """``struct<name, rel_path>`` of an analyzer counter line, null if malformed.

    The name follows the first ``)`` and a space, stops at ``(from `` and loses
    its 4-character colour prefix; the path runs to the next ``)`` (or drops
    its last character when there is none) and is made relative to ``root``.
    """
    line = col(line)
    r = col(root) if not isinstance(root, str) else F.lit(root)
    rest = F.substr(line, F.instr(line, ")") + 2)
    name = F.substr(strip_ws(F.substring_index(rest, FROM_TOKEN, 1)), F.lit(ANSI_PREFIX_LEN + 1))
    full = F.regexp_extract(rest, r"(?s)\(from ([^)]*)(?:\)|.$)", 1)
    rel = F.substr(full, F.instr(full, r) + F.length(r) + 1)
    # a line with the token has a name: stated, for a check that it is not null would strip it once more
    return F.when(rest.contains(FROM_TOKEN), F.struct(F.coalesce(name, F.lit("")).alias("name"), rel.alias("rel_path")))
