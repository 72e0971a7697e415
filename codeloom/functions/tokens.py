"""Whitespace tokenisation, truncation and token ids as column expressions.

Subword vocabularies are not built here; ids are a stable hash of the token
(reproducible in other engines), or come from a vocabulary table joined on the
token when one is given.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeloom.functions.util import col

# Fixed values
MAX_TRAIN_TOKENS = 256
MAX_PROMPT_TOKENS = 4096
DEFAULT_VOCAB = 1 << 20
PAD_ID = 0


def tokens(c) -> Column:
    """Tab/newline/CR become spaces, the text is trimmed and split on runs of
    spaces; an empty or missing text gives an empty list."""
    t = F.trim(F.regexp_replace(col(c), "[\t\n\r]", " "))
    return F.when(t.isNull() | (t == ""), F.array().cast("array<string>")).otherwise(F.split(t, " +"))


def truncate(toks, max_len: int = MAX_TRAIN_TOKENS) -> Column:
    toks = col(toks)
    return F.when(F.size(toks) > max_len, F.slice(toks, 1, max_len)).otherwise(toks)


def token_id(tok, vocab: int = DEFAULT_VOCAB) -> Column:
    """Stable id in ``[1, vocab)`` (0 is padding): md5-based, engine-independent."""
    h = F.conv(F.substring(F.md5(tok), 1, 8), 16, 10).cast("bigint")
    return F.pmod(h, F.lit(vocab - 1)) + 1


def token_ids(toks, vocab: int = DEFAULT_VOCAB) -> Column:
    return F.transform(col(toks), lambda t: token_id(t, vocab))


def token_count(c) -> Column:
    return F.size(tokens(c))


def was_truncated(c, max_len: int = MAX_TRAIN_TOKENS) -> Column:
    return token_count(c) > max_len


def pad(ids, length) -> Column:
    """``ids`` right-padded with 0 to ``length``."""
    ids = col(ids)
    n = F.greatest(col(length) - F.size(ids), F.lit(0))
    return F.concat(ids, F.array_repeat(F.lit(PAD_ID), n.cast("int")))


def attention_mask(ids, length) -> Column:
    ids = col(ids)
    n = F.greatest(col(length) - F.size(ids), F.lit(0))
    return F.concat(F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), n.cast("int")))
