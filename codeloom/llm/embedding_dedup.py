"""Embedding near-duplicates by NN-descent.

Vectors of one label that are equal become one node.  A first graph comes from
random projections: the nodes are sorted along each and compared within short
runs.  Each round then joins neighbours of neighbours: around every node its
neighbours, in both directions, are compared with each other, and each node
keeps its ``k`` best.  A node whose whole list lies above the threshold is
saturated: its list is enlarged to all links it has, by comparing the saturated
nodes of a label with each other in blocks, which count links and keep a
spanning forest of them; links to other nodes are in those nodes' lists.  The
links of a sample of nodes are counted exactly, a larger one where links are rare,
and rounds go on until the audited recall reaches its target.  Where it has not
after the most rounds, all nodes of a label are compared with each other in blocks.
"""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.components import components
from codeloom.llm.simhash import forest
from codeloom.llm.staging import stage

RUN = 48
#: Nodes that one pass of the audit compares with all.
MOST_ASKED = 2048
EDGE = "u long, v long, sim double, fresh int"


def _matrix(column) -> np.ndarray:
    """Unit rows in double precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _runs(batches, by: int):
    """Batches of whole or RUN-sized runs of rows equal in the first ``by`` columns: tables with their cuts."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        cuts = _cuts(t, by)
        keep = cuts[-2]
        if keep:
            yield t.slice(0, keep), cuts[:-1]
        held = t.slice(keep)
    if held is not None and held.num_rows:
        yield held, _cuts(held, by)


def _cuts(t: pa.Table, by: int) -> list[int]:
    new = np.zeros(t.num_rows, bool)
    new[0] = True
    for c in range(by):
        x = t.column(c).combine_chunks().dictionary_encode().indices.to_numpy()
        new[1:] |= x[1:] != x[:-1]
    out = []
    first = [*np.flatnonzero(new).tolist(), t.num_rows]
    for a, b in zip(first, first[1:]):
        out += range(a, b, RUN)
    return [*out, t.num_rows]


def _best(sim: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``k`` largest entries of each row above -inf."""
    k = min(k, sim.shape[1])
    col = np.argpartition(-sim, k - 1, axis=1)[:, :k]
    row = np.repeat(np.arange(len(sim)), k)
    col = col.ravel()
    ok = sim[row, col] > -np.inf
    return row[ok], col[ok]


def _edges(u, v, sim) -> pa.RecordBatch:
    u, v, sim = (np.concatenate(x) if x else np.empty(0) for x in (u, v, sim))
    return pa.RecordBatch.from_arrays(
        [pa.array(u.astype(np.int64)), pa.array(v.astype(np.int64)), pa.array(sim.astype(np.float64)), pa.array(np.ones(len(u), np.int32))],
        names=["u", "v", "sim", "fresh"],
    )


def _first_graph(nodes: DataFrame, k: int, projections: int, seed: int) -> DataFrame:
    def project(batches):
        for b in batches:
            for _, node, g, vec in _by_group(pc.list_value_length(b.column(2)), *b.columns):
                x = _matrix(vec)
                for p in range(projections):
                    plane = np.random.default_rng((seed, p)).standard_normal((x.shape[1], 25))
                    y = x @ plane
                    code = (y[:, :24] > 0) @ (1 << np.arange(23, -1, -1))
                    place = [pa.array(np.full(len(x), p, np.int32)), g, pa.array(code.astype(np.int64)), pa.array(y[:, 24])]
                    yield pa.RecordBatch.from_arrays([*place, node, vec], names=["p", "g", "code", "y", "node", "vec"])

    kind = nodes.schema["vec"].dataType.simpleString()
    placed = nodes.select("node", "g", "vec").mapInArrow(project, f"p int, g string, code long, y double, node long, vec {kind}")
    placed = placed.repartitionByRange("p", "g", "code", "y").sortWithinPartitions("p", "g", "code", "y", "node")

    def compare(batches):
        for t, cuts in _runs(batches, 2):
            u, v, sims = [], [], []
            ids = t.column("node").to_numpy()
            for a, b in zip(cuts, cuts[1:]):
                x = _matrix(t.column("vec").slice(a, b - a))
                sim = x @ x.T
                np.fill_diagonal(sim, -np.inf)
                r, c = _best(sim, k)
                u.append(ids[a + r])
                v.append(ids[a + c])
                sims.append(sim[r, c])
            yield _edges(u, v, sims)

    return placed.mapInArrow(compare, EDGE)


def _keep_best(edges: DataFrame, k: int) -> DataFrame:
    once = edges.groupBy("u", "v").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "v"))
    return once.withColumn("r", rank).where(F.col("r") <= k).drop("r")


def _descend(edges: DataFrame, nodes: DataFrame, k: int, turn: int) -> DataFrame:
    """One round: compare the neighbours of every node with each other."""
    both = edges.select(F.col("u").alias("center"), F.col("v").alias("node"), "fresh").union(edges.select("v", "u", "fresh"))
    both = both.groupBy("center", "node").agg(F.max("fresh").alias("fresh"))
    worst = edges.groupBy("u").agg(F.when(F.count("*") >= k, F.min("sim")).otherwise(F.lit(-2.0)).alias("worst"))
    members = both.join(nodes.select("node", "vec"), "node").join(worst.withColumnRenamed("u", "node"), "node", "left")
    members = members.select("center", F.xxhash64("node", F.lit(turn)).alias("h"), "node", "fresh", F.coalesce("worst", F.lit(-2.0)).alias("worst"), "vec")
    members = members.repartitionByRange("center", "h").sortWithinPartitions("center", "h")

    def compare(batches):
        for t, cuts in _runs(batches, 1):
            ids, fresh, least = (t.column(c).to_numpy() for c in ("node", "fresh", "worst"))
            u, v, sims = [], [], []
            for a, b in zip(cuts, cuts[1:]):
                new = fresh[a:b] > 0
                if b - a < 2 or not new.any():
                    continue
                x = _matrix(t.column("vec").slice(a, b - a))
                sim = x @ x.T
                np.fill_diagonal(sim, -np.inf)
                sim[~(new[:, None] | new[None, :]) | (sim <= least[a:b, None])] = -np.inf
                r, c = _best(sim, k)
                u.append(ids[a + r])
                v.append(ids[a + c])
                sims.append(sim[r, c])
            yield _edges(u, v, sims)

    found = members.mapInArrow(compare, EDGE)
    return _keep_best(edges.withColumn("fresh", F.lit(0)).union(found), k)


def _dense(nodes: DataFrame, saturated: DataFrame, threshold: float, block: int) -> DataFrame:
    """Links among saturated nodes: (node, links, root), compared exactly in pairs of blocks."""
    dense = nodes.join(saturated, "node", "left_semi")
    size = dense.groupBy("g").agg(F.ceil(F.count("*") / block).alias("s"))
    parts = (
        dense.join(size, "g")
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("s")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("s") - 1)))
        .select("g", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node", "m", "vec")
    )

    def count(key, t):
        x, own, m = _matrix(t.column("vec")), t.column("own").to_numpy(), t.column("m").to_numpy()
        near = x @ x.T >= threshold
        np.fill_diagonal(near, False)
        if key[1].as_py() != key[2].as_py():
            near &= own[:, None] != own[None, :]
        r, c = np.nonzero(np.triu(near))
        ids = t.column("node").to_numpy()
        return pa.table({"node": pa.array(ids), "links": pa.array((near @ m).astype(np.int64)), "root": pa.array(ids[forest(len(x), r, c)])})

    return parts.groupBy("g", "lo", "hi").applyInArrow(count, "node long, links long, root long")


def _harvest(edges, nodes, k, threshold, block):
    """Per node the number of linked vectors in other nodes, and links that connect what is linked."""
    state = edges.groupBy("u").agg(F.count("*").alias("n"), F.min("sim").alias("least"))
    saturated = state.where((F.col("n") >= k) & (F.col("least") >= threshold)).select(F.col("u").alias("node"))
    saturated = stage(saturated, "saturated")
    near = edges.where(F.col("sim") >= threshold).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    mark = saturated.withColumn("full", F.lit(1))
    near = near.join(mark.withColumnRenamed("node", "u").withColumnRenamed("full", "a"), "u", "left")
    near = near.join(mark.withColumnRenamed("node", "v").withColumnRenamed("full", "b"), "v", "left").where("a is null or b is null")
    near = stage(near.select("u", "v"), "near")
    dense = stage(_dense(nodes, saturated, threshold, block), "dense")
    weight = nodes.select(F.col("node").alias("v"), "m")
    one_way = near.union(near.select(F.col("v").alias("u"), F.col("u").alias("v"))).join(weight, "v").select(F.col("u").alias("node"), F.col("m").alias("links"))
    links = one_way.union(dense.select("node", "links")).groupBy("node").agg(F.sum("links").alias("links"))
    return stage(links, "counts"), near.union(dense.where("node <> root").select("node", "root"))


def _every_link(nodes, threshold, block):
    """As _harvest, from all nodes of a label compared with each other in pairs of blocks."""
    dense = stage(_dense(nodes, nodes.select("node"), threshold, block), "dense")
    links = stage(dense.groupBy("node").agg(F.sum("links").alias("links")), "counts")
    return links, dense.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v"))


def _counted(nodes, threshold, queries, least):
    """Exact links (node, links) of nodes taken by hash: about ``queries`` of them, then more, until
    ``least`` links are counted or every node is.  Each pass compares at most MOST_ASKED or ``queries`` with all nodes."""
    parts = max(1, -(-nodes.count() // queries))
    part = F.pmod(F.xxhash64("node"), F.lit(parts))
    most = max(1, MOST_ASKED // queries)
    out, done, total = None, 0, 0
    while done < parts and total < least:
        step = min(max(done, 1), most)
        exact = _exact(nodes, nodes.where((part >= done) & (part < done + step)), threshold)
        total += exact.agg(F.sum("links")).first()[0] or 0
        out = exact if out is None else out.union(exact)
        done += step
    return out


def _exact(nodes, chosen, threshold):
    """Number of linked vectors in other nodes and copies of the node, for few chosen nodes against all."""
    asked = chosen.select("node", "g", "vec").toArrow()
    sent = nodes.sparkSession.sparkContext.broadcast(
        [(g, ids.to_numpy(), _matrix(vec)) for g, ids, vec in _by_group(asked.column("g"), asked.column("node"), asked.column("vec"))]
    )

    def run(batches):
        groups = {g: (ids, x) for g, ids, x in sent.value}
        for b in batches:
            for start in range(0, b.num_rows, 1024):
                for g, m, vec in _by_group(*b.slice(start, 1024).columns):
                    if g in groups:
                        ids, x = groups[g]
                        near = ((x @ _matrix(vec).T >= threshold) @ m.to_numpy()).astype(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(near)], names=["node", "near"])

    near = nodes.select("g", "m", "vec").mapInArrow(run, "node long, near long").groupBy("node").agg(F.sum("near").alias("near"))
    return stage(near.join(nodes.select("node", "m"), "node").select("node", (F.col("near") - F.col("m")).alias("links")), "audit")


def _audit(counted, links):
    """Share of the exactly counted links that were found; 1 only if every node was counted and none has a link."""
    row = counted.withColumnRenamed("links", "exact").join(links, "node", "left")
    total, found = row.agg(F.sum("exact"), F.sum(F.least("exact", F.coalesce("links", F.lit(0))))).first()
    return found / total if total else 1.0


def _by_group(g, *columns):
    g = g.combine_chunks() if isinstance(g, pa.ChunkedArray) else g
    coded = g.dictionary_encode()
    for k, name in enumerate(coded.dictionary.to_pylist()):
        at = pa.array(np.flatnonzero(coded.indices.to_numpy() == k))
        yield (name, *(c.take(at) for c in columns))


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = 0.93,
    k: int = 12,
    projections: int = 8,
    rounds: int = 3,
    most_rounds: int = 12,
    recall: float = 0.97,
    queries: int = 200,
    block: int = 1024,
    audited: int = 1000,
) -> DataFrame:
    """One row per input row: ``id_col``, n_links, component_id, kept.

    Two vectors are linked if their labels are equal and not null and their
    cosine in double precision is at least ``threshold``.  Recall is audited on
    ``queries`` nodes or as many more as have ``audited`` links together.

    * A vector that is null, empty, zero, or has null or non-finite components
      links with nothing; vectors of different lengths do not either.
    * Null ids: the row is returned; component_id is the smallest id that is not
      null in its component, else null.  Equal vectors, also of repeated rows,
      are links.  Empty table: empty result.
    """
    x = F.col(vector_col)
    finite = ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    valid = F.col(label_col).isNotNull() & x.isNotNull() & finite & F.exists(x, lambda e: e != 0)
    group = F.when(valid, F.concat_ws(":", F.col(label_col).cast("string"), F.size(x)))
    rows = vectors.select(F.col(id_col).alias("id"), group.alias("g"), F.when(valid, x).alias("vec"))
    nodes = rows.where("g is not null").groupBy("g", "vec").agg(F.min("id").alias("rep"), F.count("*").alias("m"))
    nodes = stage(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    edges = stage(_keep_best(_first_graph(nodes, k, projections, 1), k), "graph")
    counted = _counted(nodes, threshold, queries, audited)
    turn = 0
    while True:
        for _ in range(rounds if not turn else 2):
            turn += 1
            edges = stage(_descend(edges, nodes, k, turn), "graph")
        links, near = _harvest(edges, nodes, k, threshold, block)
        share = _audit(counted, links)
        if share >= recall or turn >= most_rounds:
            break
    if share < recall:
        logging.getLogger(__name__).warning("audited recall %.3f after %d rounds, comparing all nodes", share, turn)
        links, near = _every_link(nodes, threshold, block)
    roots = stage(components(near), "roots")
    full = nodes.join(links, "node", "left").join(roots, "node", "left")
    full = full.select("g", "vec", "rep", F.coalesce("root", "node").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"))
    least = full.groupBy("root").agg(F.min("rep").alias("component_id"))
    by_vector = full.join(least, "root").select("g", "vec", "n_links", "component_id")
    linked = rows.where("g is not null").join(by_vector, ["g", "vec"]).select("id", "n_links", "component_id")
    alone = rows.where("g is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.union(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
