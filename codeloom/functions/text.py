"""Text column functions: prompts, fenced-code extraction, missing sources,
report formatting.  All are built-in Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeloom.functions.util import col

# ---------------------------------------------------------------------------
# Fixed values (must equal the original pipeline's text for identical prompts
# and parsing).
PROMPT_HEAD = (
    "\n"
    "You are an expert Python programming language developer;\n"
    "You generate a new function in the .py file in the code repository;\n"
    "You are given a function signature and a description, and you should generate the "
    "implementation of the function, reusing the code from the code repository whenever possible.\n"
    "When using some other function, you must write import statement for that function.\n"
    "Write only the implementation of the function, no other text.\n"
)
PROMPT_SIGNATURE_HEADING = "\nFunction signature:\n"
PROMPT_TAIL = "\n"
CONTEXT_HEADING = "Relevant code from the code repository:\n"
CONTEXT_SEPARATOR = "\n\n"
PYTHON_FENCE = "```python"
FENCE = "```"
MISSING_SOURCE = "nothing"
# pandas reads these cell texts as missing values
NA_WORDS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
            "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
START_MARKER = "#to_be_implemented"
END_MARKER = "#end_of_example"
# ---------------------------------------------------------------------------


def context_block(sources) -> Column:
    """Heading plus ``source + blank line`` per neighbour.

    ``sources`` is an ``array<string>`` already in rank order (see
    :func:`ordered_sources`).
    """
    body = F.array_join(F.transform(col(sources), lambda s: F.concat(s, F.lit(CONTEXT_SEPARATOR))), "")
    return F.concat(F.lit(CONTEXT_HEADING), F.coalesce(body, F.lit("")))


def ordered_sources(rank, source) -> Column:
    """Aggregate: ``array<string>`` of ``source`` sorted by ``rank``."""
    pairs = F.array_sort(F.collect_list(F.struct(col(rank).alias("r"), col(source).alias("s"))))
    return F.transform(pairs, lambda p: p["s"])


def build_prompt(signature, context) -> Column:
    """Prompt with a context block.  The description is not part of it."""
    return F.concat(
        F.lit(PROMPT_HEAD), F.coalesce(col(context), F.lit("")), F.lit(PROMPT_SIGNATURE_HEADING),
        col(signature), F.lit(PROMPT_TAIL),
    )


def build_prompt_no_context(signature) -> Column:
    return build_prompt(signature, F.lit(""))


def extract_fenced_code(c) -> Column:
    """Text after the first ```` ```python ```` up to the next fence; else unchanged."""
    c = col(c)
    inner = F.split_part(F.split_part(c, F.lit(PYTHON_FENCE), F.lit(2)), F.lit(FENCE), F.lit(1))
    return F.when(c.contains(PYTHON_FENCE), inner).otherwise(c)


def extract_marked(c, start: str = START_MARKER, end: str = END_MARKER) -> Column:
    """Text between the last ``start`` and the last ``end`` marker, trimmed,
    when both occur in that order; else the whole text."""
    c = col(c)
    ls, le = F.lit(start), F.lit(end)
    # 1-based position of the last occurrence: length(c) - length(after last) - length(marker) + 1
    pos_s = F.when(F.instr(c, start) > 0,
                   F.length(c) - F.length(F.substring_index(c, start, -1)) - F.length(ls) + 1)
    pos_e = F.when(F.instr(c, end) > 0,
                   F.length(c) - F.length(F.substring_index(c, end, -1)) - F.length(le) + 1)
    begin = pos_s + F.length(ls)
    inner = strip_ws(F.substr(c, begin, pos_e - begin))
    ok = pos_s.isNotNull() & pos_e.isNotNull() & (pos_s < pos_e)
    return F.when(ok, inner).otherwise(c)


def strip_ws(c) -> Column:
    """Python ``str.strip()``: drop leading/trailing whitespace of any kind."""
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def fill_missing_source(c, na_words: tuple[str, ...] = ()) -> Column:
    """Missing, empty (or, with ``na_words``, a pandas NA word) → ``"nothing"``."""
    c = col(c)
    missing = c.isNull() | (c == F.lit(""))
    if na_words:
        missing = missing | c.isin(list(na_words))
    return F.when(missing, F.lit(MISSING_SOURCE)).otherwise(c)


def format_fixed(c, digits: int = 1) -> Column:
    """Python's ``f"{x:.{digits}f}"``: the exact binary value rounded half-even.

    ``format_string('%.1f')`` rounds decimal ties up (``0.25`` → ``0.3``) where
    Python gives ``0.2``; ``format_number`` rounds like Python, and its
    grouping commas are removed.
    """
    return F.regexp_replace(F.format_number(col(c), digits), ",", "")


def percent(c, digits: int = 1) -> Column:
    """``x * 100`` to ``digits`` decimals followed by ``%``."""
    return F.concat(format_fixed(col(c) * F.lit(100.0), digits), F.lit("%"))


def metric_title(c) -> Column:
    """``ngram_match_score`` → ``Ngram Match Score``."""
    return F.initcap(F.regexp_replace(col(c), "_", " "))
