"""Exact ordered positions without funnelling a group through one task.

``row_number() over (partition by g order by x)`` puts every row of ``g`` in one
task, and an un-partitioned window puts the whole table in one.  Here rows are
cut into order-preserving buckets of ``x``; a row_number inside ``(g, bucket)``
plus the bucket's offset (a running sum over the small per-bucket count table)
gives the same position.  A hot group is then ranked by many tasks; only the
count table is windowed per group.

The buckets' bounds are quantiles of ``x``, taken by one sketch aggregate, so
that they hold about as many rows each however ``x`` is spread.  The sketch is a
scalar subquery of the plan: it is evaluated with it, and planning runs nothing.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


ROWS_PER_BUCKET = 1 << 16
#: Bounds are looked up in two steps of this many.
_STEP = 32
#: Most buckets: larger tables have larger ones.
QUANTILES = _STEP * _STEP
_SHARES = ", ".join(f"{k / QUANTILES}D" for k in range(1, QUANTILES))
#: Rank error of the sketch: a tenth of a bucket.
ACCURACY = 10 * QUANTILES


def _wanted(n: Column) -> Column:
    return F.greatest(F.least(F.ceil(n / F.lit(ROWS_PER_BUCKET)), F.lit(QUANTILES)), F.lit(1))


def quantile_bucket(df: DataFrame, order: str) -> DataFrame:
    """``df`` with ``_bucket`` of ``order``: 0 .. at most ``QUANTILES - 1``, never falling as ``order`` rises.

    Buckets hold about ``ROWS_PER_BUCKET`` rows (rows of one value stay together).
    """
    name = "`" + order.replace("`", "``") + "`"
    sketch = df.agg(F.expr(f"percentile_approx({name}, array({_SHARES}), {ACCURACY})").alias("b"), F.count(F.lit(1)).alias("n"))
    coarse = F.filter(F.col("b"), lambda x, i: (i + 1) % _STEP == 0)
    sketch = sketch.select(F.struct(F.col("b"), coarse.alias("c"), _wanted(F.col("n")).alias("w")).alias("s")).scalar()
    # the bounds not above the value: first among every 32nd, then among the 31 that follow the last such one
    least = lambda bounds: F.size(F.filter(bounds, lambda x: x <= F.col(order)))
    first = least(F.col("_sketch.c"))
    below = first * _STEP + least(F.slice(F.col("_sketch.b"), first * _STEP + 1, F.lit(_STEP - 1)))
    known = df.withColumn("_sketch", sketch)
    return known.withColumn("_bucket", F.floor(below * F.col("_sketch.w") / F.lit(QUANTILES)).cast("long")).drop("_sketch")


def even_bucket(df: DataFrame, order: str, span: int) -> DataFrame:
    """``df`` with ``_bucket`` of an ``order`` known to lie evenly in 0 .. ``span`` (a hash); only the rows are counted."""
    n = df.agg(_wanted(F.count(F.lit(1))).alias("w")).scalar()
    return df.withColumn("_bucket", F.floor(F.col(order) / (F.lit(float(span)) / n)).cast("long"))


def running_rank(df: DataFrame, part: list[str], order: str, width: int | None = None,
                 tiebreak: list[str] | None = None, out: str = "_rank", span: int | None = None) -> DataFrame:
    """Add ``out``: 1-based position by (``order``, ``tiebreak``) within ``part``.

    ``order`` must be numeric.  Buckets are those of :func:`quantile_bucket`; a
    caller who knows that the order lies evenly gives its ``span``, or the
    ``width`` of a bucket (``floor(order / width)``).  Null keys are a part of
    their own, and null orders come first.
    """
    tiebreak = list(tiebreak or [])
    if width:
        b = df.withColumn("_bucket", F.floor(F.col(order) / F.lit(width)))
    else:
        b = even_bucket(df, order, span) if span else quantile_bucket(df, order)
    b = b.withColumn("_bucket", F.when(F.col(order).isNull(), F.lit(-(1 << 62))).otherwise(F.col("_bucket")))
    counts = b.groupBy(*part, "_bucket").agg(F.count(F.lit(1)).alias("_cnt"))
    w_off = (Window.partitionBy(*part) if part else Window).orderBy("_bucket") \
        .rowsBetween(Window.unboundedPreceding, -1)
    keys = [*part, "_bucket"]
    offsets = counts.select(*[F.col(c).alias(f"_at_{c}") for c in keys], F.coalesce(F.sum("_cnt").over(w_off), F.lit(0)).alias("_off"))
    w = Window.partitionBy(*keys).orderBy(order, *tiebreak)
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_at_{c}")) for c in keys])
    ranked = b.withColumn("_rn", F.row_number().over(w)).join(offsets, same)
    return ranked.withColumn(out, F.col("_rn") + F.col("_off")).drop("_rn", "_off", "_bucket", *[f"_at_{c}" for c in keys])
