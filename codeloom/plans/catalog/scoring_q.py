"""Queries: vector similarity, triplet metrics and training-log aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import vectors as V
from codeloom.functions.predicates import every_nth_step
from codeloom.functions.util import round6
from codeloom.operators import scoring as SC
from codeloom.plans.registry import query

_D = "cast({} as double[])"


def _cos(a: str, b: str) -> str:
    return f"list_cosine_similarity({_D.format(a)}, {_D.format(b)})"


def _delta_sql() -> str:
    return f"greatest({_cos('e1', 'e3')} - {_cos('e1', 'e2')} + 0.2, 0.0)"


@query("M1_cosine", ["triplet_vectors"],
       f"select anchor, round({_cos('e1', 'e2')}, 6) as pos_sim, round({_cos('e1', 'e3')}, 6) as neg_sim "
       "from triplet_vectors")
def m1(t):
    tv = t["triplet_vectors"]
    return tv.select("anchor", round6(V.cosine("e1", "e2")).alias("pos_sim"),
                     round6(V.cosine("e1", "e3")).alias("neg_sim"))


@query("M2_l2", ["triplet_vectors"],
       f"select anchor, round(list_distance({_D.format('e1')}, {_D.format('e2')}), 6) as pos_dist, "
       f"round(list_distance({_D.format('e1')}, {_D.format('e3')}), 6) as neg_dist from triplet_vectors")
def m2(t):
    tv = t["triplet_vectors"]
    return tv.select("anchor", round6(V.l2("e1", "e2")).alias("pos_dist"), round6(V.l2("e1", "e3")).alias("neg_dist"))


@query("M3_mean_pool", ["triplet_vectors"],
       f"""select anchor,
  round((list_sum({_D.format('e1')}) + list_sum({_D.format('e2')}) + list_sum({_D.format('e3')})) / 3, 6) as pooled_sum,
  round((cast(e1[1] as double) + cast(e2[1] as double) + cast(e3[1] as double)) / 3, 6) as pooled_first,
  round((list_sum({_D.format('e1')}) + list_sum({_D.format('e2')})) / 2, 6) as masked_sum
from triplet_vectors""")
def m3(t):
    """Mean over a 3-token sequence (anchor, positive, negative vectors), with
    padding counted, and with the last position masked out."""
    tv = t["triplet_vectors"].select("anchor", F.array("e1", "e2", "e3").alias("seq"))
    pooled = V.mean_pool("seq")
    masked = V.mean_pool("seq", F.array(F.lit(1), F.lit(1), F.lit(0)))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    return tv.select("anchor", round6(total(pooled)).alias("pooled_sum"),
                     round6(F.element_at(pooled, 1)).alias("pooled_first"),
                     round6(total(masked)).alias("masked_sum"))


@query("A7_triplet_loss", ["triplet_vectors"],
       f"select package, round(avg({_delta_sql()}), 6) as loss from triplet_vectors group by package")
def a7(t):
    r = SC.triplet_loss(t["triplet_vectors"], ["package"])
    return r.select("package", round6("loss").alias("loss"))


_A8 = f"""select package, count(*) as triplets, round(avg(d), 6) as val_loss,
  round(avg(case when d = 0 then 1.0 else 0.0 end), 6) as easy_triplets,
  round(avg(case when d > 0 then 1.0 else 0.0 end), 6) as medium_triplets,
  round(avg(case when d > 0.2 then 1.0 else 0.0 end), 6) as hard_triplets
from (select package, {_delta_sql()} as d from triplet_vectors) t group by package"""


def _metrics_cols(df, keys):
    return df.select(*keys, "triplets", *[round6(c).alias(c) for c in
                                          ("val_loss", "easy_triplets", "medium_triplets", "hard_triplets")])


@query("A8_triplet_metrics", ["triplet_vectors"], _A8)
def a8(t):
    """Loss and easy / medium / hard shares per group (hard ⊂ medium)."""
    return _metrics_cols(SC.triplet_metrics(t["triplet_vectors"], ["package"]), ["package"])


@query("L3_evaluate_embedder", ["triplet_vectors"],
       _A8.replace("select package, count(*)", "select count(*)").replace(" group by package", "")
       .replace("from (select package, ", "from (select "))
def l3(t):
    """Validation metrics of an embedder (here: a table of vectors) over all triplets."""
    from codeloom.plans.evaluation import evaluate_embedder

    ids = t["triplet_vectors"].select("anchor", "positive", "negative")
    look_up = lambda df, column, out: df.join(
        t["embeddings"].select(F.col("vec_id").alias(column), F.col("embedding").cast("array<double>").alias(out)), column)
    return _metrics_cols(evaluate_embedder(ids, look_up, ("anchor", "positive", "negative")), [])


@query("A9_epoch_loss", ["metric_log"],
       """select run, epoch, round(avg(b), 6) as epoch_loss, count(*) as batches
from (select run, epoch, step, avg(value) as b from metric_log group by run, epoch, step) t group by run, epoch""")
def a9(t):
    r = SC.epoch_loss(t["metric_log"])
    return r.select("run", "epoch", round6("epoch_loss").alias("epoch_loss"), "batches")


@query("A9_batch_loss", ["metric_log"],
       """select run, cast(floor((step - 1) / 16) as bigint) as batch_id, round(avg(value), 6) as batch_loss
from metric_log group by run, floor((step - 1) / 16)""")
def a9b(t):
    """Mean loss of every batch of 16 rows of a run."""
    rows = t["metric_log"].withColumn("batch_id", F.floor((F.col("step") - 1) / F.lit(16)).cast("bigint"))
    r = SC.batch_loss(rows, ["run", "batch_id"])
    return r.select("run", "batch_id", round6("batch_loss").alias("batch_loss"))


@query("F10_every_nth_step", ["metric_log"], "select run, step, value from metric_log where step % 50 = 0")
def f10(t):
    return t["metric_log"].filter(every_nth_step("step", 50)).select("run", "step", "value")
