"""Generated-code metrics: edit distance, n-gram / weighted n-gram match,
syntax match, data-flow match and their CodeBLEU combination.

Definitions follow the published CodeBLEU paper (n-gram parts from BLEU with
Chen & Cherry smoothing method 1).  Both texts of a pair are in one row, so
n-grams, subtrees and data-flow edges are counted and clipped there, in Arrow
batches and without a shuffle; edit distance and the combination of the counts
to scores are built-in expressions.
"""

from __future__ import annotations

import ast
import functools
import hashlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import format_fixed
from codeloom.operators.dataflow import dataflow_edges

# ---------------------------------------------------------------------------
# Fixed values
PYTHON_KEYWORDS = (
    "False", "None", "True", "and", "as", "assert", "async", "await", "break", "class", "continue",
    "def", "del", "elif", "else", "except", "finally", "for", "from", "global", "if", "import", "in",
    "is", "lambda", "nonlocal", "not", "or", "pass", "raise", "return", "try", "while", "with", "yield",
)
KEYWORD_WEIGHT = 1.0
OTHER_WEIGHT = 0.2
SMOOTH_EPS = 0.1
MAX_N = 4
ROWS_AT_ONCE = 500
CODEBLEU_WEIGHTS = (0.25, 0.25, 0.25, 0.25)
METRIC_ORDER = ("levenshtein_distance", "codebleu", "ngram_match_score", "weighted_ngram_match_score",
                "syntax_match_score", "dataflow_match_score")
# ---------------------------------------------------------------------------


def edit_distance(a, b) -> Column:
    """Levenshtein distance over code points (JVM built-in)."""
    return F.levenshtein(a, b)


def _bleu(prefix: str) -> Column:
    logp = []
    for k in range(1, MAX_N + 1):
        hit = F.coalesce(F.col(f"{prefix}hit{k}"), F.lit(0.0))
        tot = F.coalesce(F.col(f"{prefix}tot{k}"), F.lit(0.0))
        tot = F.when(tot == 0, F.lit(1.0)).otherwise(tot)
        p = F.when(hit == 0, F.lit(SMOOTH_EPS) / tot).otherwise(hit / tot)
        logp.append(F.log(p))
    bp = F.when(F.col("len_c") > F.col("len_r"), F.lit(1.0)) \
        .otherwise(F.exp(F.lit(1.0) - F.col("len_r") / F.greatest(F.col("len_c"), F.lit(1))))
    geo = F.exp(sum(logp[1:], logp[0]) / F.lit(float(MAX_N)))
    return F.when(F.coalesce(F.col(f"{prefix}hit1"), F.lit(0.0)) == 0, F.lit(0.0)).otherwise(geo * bp)


def _clipped(cand: Counter, ref: Counter, weight=None) -> tuple[float, float]:
    """Σ weight·min(count in candidate, count in reference) and Σ weight·count in candidate."""
    w = weight or (lambda item: 1.0)
    return sum(w(g) * min(n, ref[g]) for g, n in cand.items()), sum(w(g) * n for g, n in cand.items())


_TO_BLANK = str.maketrans("\t\n\r", "   ")


def _split(text: str) -> list[str]:
    """The tokens of :func:`codeloom.functions.tokens.tokens`."""
    return [x for x in text.translate(_TO_BLANK).split(" ") if x]


def _keyword_weight(gram: tuple[str, ...]) -> float:
    return KEYWORD_WEIGHT if gram[0] in PYTHON_KEYWORDS else OTHER_WEIGHT


def _ngram_row(ref: str, cand: str) -> dict[str, float]:
    r, c = _split(ref), _split(cand)
    row = {"len_r": len(r), "len_c": len(c)}
    for n in range(1, MAX_N + 1):
        cg, rg = (Counter(zip(*(t[k:] for k in range(n)))) for t in (c, r))
        row[f"hit{n}"], row[f"tot{n}"] = _clipped(cg, rg)
        row[f"w_hit{n}"], row[f"w_tot{n}"] = _clipped(cg, rg, _keyword_weight) if n == 1 else (row[f"hit{n}"], row[f"tot{n}"])
    return row


_NGRAM_SCHEMA = ", ".join(f"{p}{k}{n} double" for n in range(1, MAX_N + 1) for p in ("", "w_") for k in ("hit", "tot"))
_NGRAM_SCHEMA = "len_r double, len_c double, " + _NGRAM_SCHEMA
_AST_SCHEMA = "syntax double, dataflow double, parsed boolean"


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def _by_row(df: DataFrame, keep: list[str], ref: str, cand: str, parts: list[tuple[str, Callable]],
            partitions: int | None) -> DataFrame:
    """Pairs with both texts: ``keep`` and the columns that each (schema, fn) of
    ``parts`` computes from the two texts of a row.  Nothing is shuffled, unless
    the caller asks for ``partitions``: then the candidates of a reference come
    one after the other (see :func:`by_reference`), and it is parsed once."""
    pairs = df.filter(F.col(ref).isNotNull() & F.col(cand).isNotNull())
    pairs = by_reference(pairs, ref, cand, partitions) if partitions else pairs
    pairs = pairs.select(*keep, F.col(ref).alias("_ref"), F.col(cand).alias("_cand"))
    kinds = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in keep)
    names = [n for schema, _ in parts for n in _names(schema)]

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for at in range(0, b.num_rows, ROWS_AT_ONCE):
                part = b.slice(at, ROWS_AT_ONCE)
                rows = []
                for r, c in zip(part.column(len(keep)).to_pylist(), part.column(len(keep) + 1).to_pylist()):
                    row: dict = {}
                    for _, fn in parts:
                        row |= fn(r, c)
                    rows.append(row)
                made = [pa.array([row[n] for row in rows], pa.bool_() if n == "parsed" else pa.float64()) for n in names]
                yield pa.RecordBatch.from_arrays([*part.columns[:len(keep)], *made], names=[*keep, *names])

    return pairs.mapInArrow(run, ", ".join([kinds, *(schema for schema, _ in parts)]))


def by_reference(pairs: DataFrame, ref: str, cand: str, partitions: int, salt: int = 1) -> DataFrame:
    """Pairs dealt over ``partitions`` by their reference, and in its order there.
    A reference with very many candidates can be dealt over ``salt`` of them."""
    place = F.xxhash64(ref)
    part = F.pmod(F.xxhash64(cand), F.lit(salt))
    return pairs.withColumn("_of", place).repartition(partitions, "_of", part).sortWithinPartitions("_of").drop("_of")


def ngram_scores(df: DataFrame, ids: list[str], ref: str = "reference", cand: str = "candidate",
                 partitions: int | None = None) -> DataFrame:
    """``ids, ngram_match_score, weighted_ngram_match_score`` for each pair with
    both texts present; n-grams are counted and clipped inside the row.

    Weighted: unigram counts weigh 1 for Python keywords and 0.2 otherwise
    (numerator and denominator); longer n-grams are unweighted.
    """
    out = _by_row(df, ids, ref, cand, [(_NGRAM_SCHEMA, _ngram_row)], partitions)
    return out.select(*ids, _bleu("").alias("ngram_match_score"), _bleu("w_").alias("weighted_ngram_match_score"))


def ngram_match(df: DataFrame, ids: list[str], ref: str = "reference", cand: str = "candidate",
                weighted: bool = False, partitions: int | None = None) -> DataFrame:
    """``ids + score``: plain or keyword-weighted n-gram match (see :func:`ngram_scores`)."""
    col = "weighted_ngram_match_score" if weighted else "ngram_match_score"
    return ngram_scores(df, ids, ref, cand, partitions).select(*ids, F.col(col).alias("score"))


# ---------------------------------------------------------------------------
# AST parts (per-row Python helper)
def _subtree_hashes(tree: ast.AST) -> list[str]:
    """Structural hash of every non-leaf node (node types only, no names).

    Nodes are listed parents first and hashed backwards, so that any depth will do.
    """
    order, work = [], [tree]
    while work:
        node = work.pop()
        kids = list(ast.iter_child_nodes(node))
        order.append((node, kids))
        work.extend(kids)
    known: dict[int, str] = {}
    out: list[str] = []
    for node, kids in reversed(order):
        sig = type(node).__name__ + "(" + ",".join(known[id(k)] for k in kids) + ")"
        known[id(node)] = hashlib.md5(sig.encode()).hexdigest()[:16]
        if kids:
            out.append(known[id(node)])
    return out


@functools.lru_cache(maxsize=64)
def _items(text: str) -> tuple[Counter, Counter] | None:
    """Subtrees and data-flow edges of a text with their counts; None if something goes wrong
    with it (syntax, depth, memory).  Remembered for the other candidates of a reference."""
    try:
        tree = ast.parse(text)
        return Counter(_subtree_hashes(tree)), Counter(dataflow_edges(tree))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def _ast_row(ref: str, cand: str) -> dict:
    """Share of the reference's subtrees and data-flow edges that the candidate
    has; the job goes on past a pair of which one text does not parse."""
    r, c = _items(ref), _items(cand)
    if r is None or c is None:
        return {"syntax": None, "dataflow": None, "parsed": False}
    shares = []
    for own, other in zip(r, c):
        hit, total = _clipped(own, other)
        shares.append(hit / total if total else None)
    return {"syntax": shares[0], "dataflow": shares[1], "parsed": True}


def _syntax() -> Column:
    return F.coalesce("syntax", F.lit(0.0))


def ast_match(df: DataFrame, ids: list[str], ref: str = "reference", cand: str = "candidate",
              partitions: int | None = None) -> DataFrame:
    """``ids, syntax_match_score, dataflow_match_score, parsed``.

    Score = Σ min(count_c, count_r) / Σ count_r over reference items.  Syntax:
    0 when either side does not parse.  Data flow: null when the reference has
    no edge (or a side does not parse).
    """
    out = _by_row(df, ids, ref, cand, [(_AST_SCHEMA, _ast_row)], partitions)
    return out.select(*ids, _syntax().alias("syntax_match_score"), F.col("dataflow").alias("dataflow_match_score"), "parsed")


def codebleu(parts: list) -> tuple[Column, Column]:
    """Weighted mean of the four parts; a null part is left out and the
    remaining weights are rescaled.  Returns ``(score, n_parts)``."""
    num = sum((F.coalesce(p, F.lit(0.0)) * F.lit(w) for p, w in zip(parts, CODEBLEU_WEIGHTS)), F.lit(0.0))
    den = sum((F.when(p.isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for p, w in zip(parts, CODEBLEU_WEIGHTS)),
              F.lit(0.0))
    n = sum((F.when(p.isNotNull(), F.lit(1)).otherwise(F.lit(0)) for p in parts), F.lit(0))
    return F.when(den > 0, num / den), n


def score_pairs(df: DataFrame, ids: list[str], ref: str = "reference", cand: str = "candidate",
                with_ast: bool = True, partitions: int | None = None) -> DataFrame:
    """Every metric per pair with both texts present (the others are skipped)."""
    df = df.filter(F.col(ref).isNotNull() & F.col(cand).isNotNull())
    df = by_reference(df, ref, cand, partitions) if partitions else df  # the distances, too, are the dealt tasks' work
    df = df.withColumn("_lev", edit_distance(ref, cand).cast("double"))
    parts = [(_NGRAM_SCHEMA, _ngram_row)] + ([(_AST_SCHEMA, _ast_row)] if with_ast else [])
    out = _by_row(df, [*ids, "_lev"], ref, cand, parts, None)
    scores = [F.col("_lev").alias("levenshtein_distance"), _bleu("").alias("ngram_match_score"),
              _bleu("w_").alias("weighted_ngram_match_score")]
    if not with_ast:
        return out.select(*ids, *scores)
    out = out.select(*ids, *scores, _syntax().alias("syntax_match_score"), F.col("dataflow").alias("dataflow_match_score"))
    score, n = codebleu([F.col(c) for c in ("ngram_match_score", "weighted_ngram_match_score",
                                            "syntax_match_score", "dataflow_match_score")])
    return out.withColumn("codebleu", score).withColumn("n_parts", n)


def generation_metrics(scores: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """Long form ``by, metric, mean, std`` (population std, nulls skipped)."""
    stacked = scores.select(*by, F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics
    ])).alias("_m")).select(*by, "_m.metric", "_m.v")
    return stacked.groupBy(*by, "metric").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))


def macro_average(metrics: DataFrame, by: list[str]) -> DataFrame:
    """Unweighted mean over datasets of the per-dataset means."""
    return metrics.groupBy(*by, "metric").agg(F.avg("mean").alias("mean"))


def compare_variants(avg: DataFrame, a: str = "trained", b: str = "not_trained") -> DataFrame:
    """``metric, trained, not_trained`` (pivot on the two known variants)."""
    return avg.groupBy("metric").pivot("variant", [a, b]).agg(F.first("mean"))


def metric_delta(cmp: DataFrame, a: str = "trained", b: str = "not_trained") -> DataFrame:
    d = F.col(a) - F.col(b)
    return cmp.withColumn("delta", d).withColumn("improved", d >= 0)


# ---------------------------------------------------------------------------
# Display names of the report table, in report order
DISPLAY_NAMES = (
    ("codebleu", "CodeBLEU"),
    ("ngram_match_score", "N-gram Match"),
    ("weighted_ngram_match_score", "Weighted N-gram"),
    ("syntax_match_score", "Syntax Match"),
    ("dataflow_match_score", "Dataflow Match"),
)


def report_rows(cmp: DataFrame, a: str = "trained", b: str = "not_trained") -> DataFrame:
    """``position, metric, line``: ``Name & a% & b% \\\\`` per reported metric
    (one decimal), for the body of a LaTeX table."""
    names = F.create_map(*[x for k, v in DISPLAY_NAMES for x in (F.lit(k), F.lit(v))])
    pos = F.create_map(*[x for i, (k, _) in enumerate(DISPLAY_NAMES) for x in (F.lit(k), F.lit(i + 1))])
    pct = lambda c: format_fixed(F.col(c) * F.lit(100.0), 1)
    line = F.concat(names[F.col("metric")], F.lit(" & "), pct(a), F.lit("\\% & "), pct(b), F.lit("\\% \\\\"))
    return cmp.filter(F.col("metric").isin([k for k, _ in DISPLAY_NAMES])) \
        .select(pos[F.col("metric")].alias("position"), "metric", line.alias("line"))
