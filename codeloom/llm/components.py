"""Connected components of a link table by alternating star contraction.

Links never leave the executors: each round is two grouped minima joined back
to the links, and the rewritten links are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.staging import stage


def _large(e: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest one around it."""
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(e: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v: long), root the smallest node reachable.

    Nulls and self links are ignored; nodes without links are not returned.
    The work ends when a round changes nothing.
    """
    e = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = stage(e, "links")
    seen = None
    for _ in range(rounds):
        row = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(row) == seen or not row[0]:
            break
        seen = tuple(row)
        e = stage(_small(_large(e)), "links")
    else:
        raise RuntimeError("the components did not settle")
    roots = e.select("v").distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select("v", "v"))
