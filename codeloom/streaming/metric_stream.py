"""Live training-metric log as a Structured Streaming job.

A training loop drops JSON records ``{run, step, metric, value}`` into a
folder; this stream appends them to the metric-log table (partitioned by run,
epoch and batch) and keeps the per-epoch loss table current: a micro-batch
reads and rewrites the epochs it adds to, and no others.  The
stream's own checkpoint makes it restartable after a failure (exactly-once
into the parquet sink through ``foreachBatch`` + batch ids written once).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators.scoring import epoch_loss

RECORD_SCHEMA = "run string, step long, metric string, value double"


def metric_stream(spark: SparkSession, in_dir: str, table: str, epoch_table: str, checkpoint: str,
                  steps_per_epoch: int = 100, metric: str = "train_loss"):
    """Start the stream; returns the ``StreamingQuery``."""
    records = spark.readStream.schema(RECORD_SCHEMA).json(in_dir)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        epoch = F.floor((F.col("step") - 1) / F.lit(steps_per_epoch)).cast("bigint")
        rows = batch.select("*", epoch.alias("epoch"), F.lit(batch_id).alias("batch_id"))
        # idempotent per batch id: a replayed batch overwrites its own partitions
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
            .partitionBy("run", "epoch", "batch_id").parquet(table)
        # only the epochs that this batch adds to are read again and rewritten
        touched = rows.select("run", "epoch").distinct()
        log = batch.sparkSession.read.schema(rows.schema).parquet(table)
        epoch_loss(log.join(touched, ["run", "epoch"]).filter(F.col("metric") == metric)).write.mode("overwrite") \
            .option("partitionOverwriteMode", "dynamic").partitionBy("run", "epoch").parquet(epoch_table)

    return records.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint).start()
