"""Structured Streaming ingestion of live metric records."""

import json
import os

from codeloom.streaming.metric_stream import metric_stream


def test_metric_stream_appends_and_updates_epochs(spark, tmp_dir):
    src = f"{tmp_dir}/in"
    os.makedirs(src)
    for part, steps in enumerate([range(1, 151), range(151, 251)]):
        with open(f"{src}/batch{part}.json", "w") as fh:
            for s in steps:
                fh.write(json.dumps({"run": "r1", "step": s, "metric": "train_loss", "value": float(s % 7)}) + "\n")
        q = metric_stream(spark, src, f"{tmp_dir}/log", f"{tmp_dir}/epochs", f"{tmp_dir}/ckpt")
        q.processAllAvailable()
        q.stop()
    log = spark.read.parquet(f"{tmp_dir}/log")
    assert log.count() == 250
    epochs = {r["epoch"]: (r["batches"], r["epoch_loss"]) for r in spark.read.parquet(f"{tmp_dir}/epochs").collect()}
    assert epochs[0][0] == 100 and epochs[1][0] == 100 and epochs[2][0] == 50
    assert abs(epochs[2][1] - sum(s % 7 for s in range(201, 251)) / 50) < 1e-9
