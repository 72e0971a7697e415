"""License scans: Aho-Corasick over notice phrases and identifier tags, a shunting-yard parser for expressions.

One automaton runs over a text's words for the notice phrases, another over the
lower-cased text itself for the tags that announce a licence expression.  What
stands behind a tag is read by a shunting-yard parser with the operators
``with`` (binds tightest), ``and``, ``or`` and parentheses, and evaluated to
labels and a strictness: of ``or`` the reader may take the laxer side, under
``and`` the stricter one counts, an exception behind ``with`` loosens a licence
by half.  Every row is judged by itself, in Arrow batches and without a shuffle.
"""

from __future__ import annotations

import functools
import re
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

#: Notice phrases (words after lower-casing) that the base counts, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Further notice phrases, and their labels.
NOTICES = {
    "mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "apache license": "apache",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "isc license": "isc",
    "boost software license": "bsl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "creative commons attribution": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by nc": "cc-by-nc",
    "cc0": "cc0",
    "dedicated to the public domain": "public-domain",
    "this is free and unencumbered software released into the public domain": "unlicense",
}

#: How much a label asks of whoever uses the text: 0 nothing, 1 no use at all.
STRICT = {
    "public-domain": 0.0, "cc0": 0.0, "unlicense": 0.0, "mit": 0.2, "isc": 0.2, "bsd": 0.2, "bsl": 0.2, "zlib": 0.2,
    "apache": 0.25, "cc-by": 0.25, "mpl": 0.5, "epl": 0.5, "lgpl": 0.5, "cc-by-sa": 0.6, "gpl": 0.7, "agpl": 0.8,
    "cc-by-nd": 0.8, "cc-by-nc": 0.9, "unknown": 0.95, "reserved": 1.0,
}

#: Tags in front of a licence expression; behind the last one unknown names are mere prose.
TAGS = ("spdx-license-identifier:", "license-expression:", "license:")

#: Families of licence identifiers, tried in this order on the identifier without its version.
FAMILIES = (
    "cc-by-nc", "cc-by-nd", "cc-by-sa", "cc-by", "cc0", "agpl", "lgpl", "gpl", "apache", "mit", "bsd", "isc", "bsl", "mpl", "epl",
    "zlib", "unlicense",
)

#: Bytes of words: ASCII digits and letters (A-Z in lower case) and everything beyond ASCII; the others part them.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

_TOKEN = re.compile(r"[ \t]*([()]|[a-z0-9][a-z0-9.+-]*)")
_BINDS = {"or": 1, "and": 2, "with": 3}


class Finding(NamedTuple):
    labels: frozenset
    strict: float


def label_of(identifier: str) -> str:
    """Family of a licence identifier, ``unknown`` if none fits."""
    for family in FAMILIES:
        if identifier == family or identifier.startswith((family + "-", family + "+")):
            return family
    return "unknown"


def postfix(tokens: list[str]) -> list[str]:
    """Shunting-yard: the longest well-formed expression at the front, in postfix order; empty if there is none."""
    out: list[str] = []
    waiting: list[str] = []
    whole: list[str] = []  # the expression up to the last place where one could end
    operand = True  # whether an operand is due
    for token in tokens:
        if operand != (token == "(" or token not in _BINDS and token != ")"):
            break
        if token == "(":
            waiting.append(token)
        elif token == ")":
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if not waiting:
                break
            waiting.pop()
        elif token in _BINDS:
            while waiting and waiting[-1] != "(" and _BINDS[waiting[-1]] >= _BINDS[token]:
                out.append(waiting.pop())
            waiting.append(token)
            operand = True
        else:
            out.append(token)
            operand = False
        if not operand and "(" not in waiting:
            whole = [*out, *reversed(waiting)]
    return whole


def evaluate(expression: list[str]) -> Finding | None:
    """Labels and strictness of a postfix expression (None if it is empty)."""
    stack: list = []
    for token in expression:
        if token not in _BINDS:
            stack.append(token)
            continue
        right, left = stack.pop(), stack.pop()
        if token == "with":  # its right side names an exception, not a licence
            left = _found(left)
            stack.append(Finding(left.labels, left.strict / 2))
            continue
        left, right = _found(left), _found(right)
        pick = min if token == "or" else max
        stack.append(Finding(left.labels | right.labels, pick(left.strict, right.strict)))
    return _found(stack.pop()) if stack else None


def _found(x) -> Finding:
    if isinstance(x, Finding):
        return x
    label = label_of(x)
    return Finding(frozenset([label]), STRICT[label])


def read_expression(text: str, start: int = 0) -> Finding | None:
    """The licence expression that begins at ``start`` of a lower-cased text and ends with its line at the latest."""
    tokens, at = [], start
    while found := _TOKEN.match(text, at):
        tokens.append(found[1] if found[1] in "()" else found[1].rstrip(".-"))
        at = found.end()
    return evaluate(postfix(tokens))


@functools.cache
def _automata() -> tuple[ahocorasick.Automaton, ahocorasick.Automaton]:
    phrases, tags = ahocorasick.Automaton(), ahocorasick.Automaton()
    for base, table in ((True, BASE), (False, NOTICES)):
        for phrase, label in table.items():
            phrases.add_word(f" {phrase} ", (base, label, len(phrase.split())))
    for tag in TAGS:
        tags.add_word(tag, tag)
    phrases.make_automaton()
    tags.make_automaton()
    return phrases, tags


def scan(text: bytes) -> tuple[int, int, int | None, int | None, str, str, float]:
    """n_words, n_base, first_word, last_word, base_labels, labels, score of one text in UTF-8."""
    phrases, tags = _automata()
    words = text.translate(_FOLD).split()
    joined = " " + b" ".join(words).decode("latin-1") + " "
    starts, base, labels, strict = [], set(), set(), 0.0
    at = before = 0  # spaces up to ``at``
    for end, (counts, label, n) in phrases.iter(joined):
        before += joined.count(" ", at, end)
        at = end
        if counts:
            starts.append(before - n)
            base.add(label)
        labels.add(label)
        strict = max(strict, STRICT[label])
    lower = text.translate(_LOWER).decode("latin-1")
    for end, tag in tags.iter(lower):
        found = read_expression(lower, end + 1)
        if found is None or tag == TAGS[-1] and "unknown" in found.labels:
            continue
        labels |= found.labels
        strict = max(strict, found.strict)
    first, last = (min(starts), max(starts)) if starts else (None, None)
    return len(words), len(starts), first, last, ",".join(sorted(base)), ",".join(sorted(base | labels)), strict


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``n_base`` counts every place where the words of a ``BASE`` phrase stand one
    after the other, ``first_word`` and ``last_word`` are its smallest and
    largest start.  ``labels`` are those of all phrases and of the expressions
    behind tags; ``unknown`` stands for an identifier of no family.  ``score`` is
    the strictness of the strictest finding, 0 where there is none.

    * Null or empty text: no words, no labels (empty strings), null places.
    * Repeated rows, and rows with a null id, are judged one by one.  Other
      columns are not looked at.  Empty table: empty result.
    """
    schema = StructType(
        [
            StructField("_id", docs.schema[id_col].dataType),
            *(StructField(c, LongType()) for c in ("n_words", "n_base", "first_word", "last_word")),
            StructField("base_labels", StringType()),
            StructField("labels", StringType()),
            StructField("score", DoubleType()),
        ]
    )
    kinds = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64()]
    names = schema.fieldNames()

    def run(batches):
        for batch in batches:
            rows = [scan(t.as_py() or b"") for t in batch.column(1)]
            cols = zip(*rows) if rows else [[]] * len(kinds)
            found = [pa.array(list(c), kind) for c, kind in zip(cols, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *found], names=names)

    source = docs.select(docs[id_col].alias("_id"), docs[text_col].cast("binary").alias("_text"))
    return source.mapInArrow(run, schema).withColumnRenamed("_id", id_col)
