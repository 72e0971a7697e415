"""Boolean column functions (symbol filters and small row predicates)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeloom.functions.names import bare_name
from codeloom.functions.util import col

# Symbols that are never user functions
GENERATED_NAMES = ("<lambda>", "<module>")
BUILTIN_FILE = "builtin.py"
INIT_MARK = "$$"


# One regular expression for the whole rule (a compact expression even when the
# argument is itself an expression): the symbol does not start with
# ``builtin.py``; the bare name (after the last ``:``) is non-empty, does not
# start with ``$$`` or a digit, is not exactly ``<lambda>`` / ``<module>`` and
# does not end with ``$$``.
_USER_FUNCTION = r"^(?!builtin\.py)(?:.*:)?(?!\$\$|<lambda>$|<module>$|[0-9])[^:]+(?<!\$\$)$"


def is_user_function(c) -> Column:
    """Current filter: the bare name (after the last ``:``) does not start or
    end with ``$$``, is not ``<lambda>``/``<module>``, is not empty and does not
    start with a digit; the symbol does not start with ``builtin.py``."""
    return F.coalesce(col(c).rlike(_USER_FUNCTION), F.lit(False))


def is_user_function_v1(c) -> Column:
    """Older list filter: ``$$`` tested on the whole symbol; the last segment
    is not ``<lambda>``, ``<module>`` or exactly ``2``."""
    c = col(c)
    b = bare_name(c)
    return (
        ~c.startswith(INIT_MARK) & ~c.endswith(INIT_MARK)
        & ~b.isin(*GENERATED_NAMES) & (b != F.lit("2"))
    )


def not_builtin(c) -> Column:
    """``builtin.py`` does not occur before the first ``:``.

    Without a ``:`` the original slice drops the last character instead.
    """
    c = col(c)
    head = F.when(F.instr(c, ":") > 0, F.substring_index(c, ":", 1)) \
        .otherwise(F.substr(c, F.lit(1), F.length(c) - 1))
    return ~head.contains(BUILTIN_FILE)


def scored_pair(a, b) -> Column:
    """A metric is computed only when both sides are present."""
    return col(a).isNotNull() & col(b).isNotNull()


def every_nth_step(step, n: int = 50) -> Column:
    return (col(step) % F.lit(n)) == 0
