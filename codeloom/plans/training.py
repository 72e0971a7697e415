"""Training-set job: split → triplets → tokens → batches (padded per batch)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import tokens as TK
from codeloom.functions.text import MISSING_SOURCE
from codeloom.operators import sampling as S
from codeloom.plans.graph_build import at_once
from codeloom.session import cut_lineage


def build_training_set(
    edges: DataFrame,
    nodes: DataFrame,
    id_col: str = "edge_id",
    order: str = "doc_id",
    seed: int = 42,
    epoch: int = 0,
    batch_size: int = 16,
    val: float = 0.2,
    max_len: int = TK.MAX_TRAIN_TOKENS,
    pad: bool = False,
) -> DataFrame:
    """Triplet rows (``package, <id>, node1..3``) with ``split, batch_id, pos``
    and token ids ``ids1..3`` per side.

    ``edges``: ``package, <id_col>, node1, node2``; ``nodes``: ``package, node,
    source_code, <order>``.  Train rows are shuffled by ``md5(seed:epoch:id)``;
    validation rows keep package order.  With ``pad`` every side is padded to
    its batch's longest sequence and gets an attention mask.  A split with an
    empty side raises.
    """
    # the light tables that every step reads are written once, side by side
    edges, names = at_once(
        edges.sparkSession,
        lambda: cut_lineage(edges.select("package", id_col, "node1", "node2")),
        lambda: cut_lineage(nodes.select("package", "node", order)))
    # one row per package: checked, and read by all that follows
    split = cut_lineage(S.group_split(S.package_sizes(names, edges), val=val, seed=seed))
    S.check_split(split)
    # batch positions are planned on the light (package, id) columns, so the
    # heavy triplet + token rows are built once and joined on a unique key
    light = edges.select("package", id_col).join(split.select("package", "split"), "package")
    train = S.assign_batches(light.filter(F.col("split") == "train"), batch_size, True, id_col, seed, epoch)
    val_rows = S.merged_index(light.filter(F.col("split") == "validation"),
                              split.filter(F.col("split") == "validation"), id_col)
    valid = S.assign_batches(val_rows, batch_size, False, id_col, index_col="global_idx").drop("global_idx")
    batches = cut_lineage(train.unionByName(valid))
    # each node's code is tokenised once (not once per edge that names it, nor for
    # each of the three lookups, whose own exchange Spark leaves out as the sources
    # lie by node already) and only the bounded id lists travel through the triplet joins
    trip = S.triplets(edges, names, id_col, order, seed, epoch, sources=False)
    ids = lambda c: TK.token_ids(TK.truncate(TK.tokens(c), max_len))
    node_ids = cut_lineage(S.node_sources(nodes, order).select("package", "node", ids("source").alias("value")))
    trip = S.attach_node_values(trip, node_ids, {"node1": "ids1", "node2": "ids2", "node3": "ids3"},
                                ids(F.lit(MISSING_SOURCE)))
    out = trip.join(batches, ["package", id_col])
    if pad:
        w = Window.partitionBy("split", "batch_id")
        for i in (1, 2, 3):
            out = out.withColumn(f"_len{i}", F.max(F.size(f"ids{i}")).over(w))
            out = out.withColumn(f"mask{i}", TK.attention_mask(f"ids{i}", f"_len{i}")) \
                .withColumn(f"ids{i}", TK.pad(f"ids{i}", f"_len{i}")).drop(f"_len{i}")
    return out
