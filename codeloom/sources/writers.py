"""Sinks: graph tables, results, metrics, comparison, metric log, models.

All writers are partitioned by the corpus key (``package`` / ``dataset_name``),
so each package's output is its own folder and later reads prune partitions.
Graphs are parquet by default; multi-line CSV, which cannot be split when read,
is an option.  CSV output doubles quotes inside cells (``escape='"'``) so
multi-line source code survives a round trip.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.session import cut_lineage
from codeloom.sources.headed import _opened


def spread_by_key(df: DataFrame, key: str, files_per_key: int | None) -> DataFrame:
    """Cluster rows by ``key`` before a partitioned write, split into
    ``files_per_key`` salted slices so a hot key is written by several tasks
    and a task writes few folders.  ``None`` leaves the layout as it is."""
    if not files_per_key:
        return df
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(files_per_key))
    # an explicit partition count: AQE must not merge the salted slices back
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, key, salt)


def _filed(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base, _ = _opened(root)
        known, files = set(), 0
        rows = (row for b in batches for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        for path, same in groupby(rows, key=lambda row: row[0]):
            path = posixpath.join(base, path)
            folder = posixpath.dirname(path)
            if folder not in known:
                system.create_dir(folder, recursive=True)
                known.add(folder)
            with system.open_output_stream(path) as out:
                for _, content in same:
                    out.write((content or "").encode())
            files += 1
        yield pa.RecordBatch.from_pydict({"files": pa.array([files], pa.int64())})

    return run


def write_files(df: DataFrame, root: str) -> int:
    """One file below ``root`` per ``path`` with its ``content`` (rows of one path follow each other); the number of files.

    The tasks write the files themselves, each folder's side by side: a
    partitioned write would make a folder for each and rename them one by one
    on the driver.  A task run twice writes the same files again.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.select("path", "content").repartition(parts, "path").sortWithinPartitions("path")
    return dealt.mapInArrow(_filed(root), "files long").agg(F.sum("files")).first()[0] or 0


def _csv_writer(df: DataFrame, mode: str):
    # keep leading / trailing whitespace: it is part of the code
    return (df.write.mode(mode).option("header", True).option("escape", '"')
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))


def write_edges(edges: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                files_per_package: int | None = None) -> None:
    """``package, node1, node2, type`` partitioned by package (``type`` 0 when absent)."""
    out = edges if "type" in edges.columns else edges.withColumn("type", F.lit(0))
    out = out.select("node1", "node2", F.col("type").cast("int").alias("type"), "package")
    out = spread_by_key(out, "package", files_per_package)
    w = _csv_writer(out, mode) if fmt == "csv" else out.write.mode(mode)
    w.partitionBy("package").format(fmt).save(path)


def write_nodes(nodes: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                files_per_package: int | None = None) -> None:
    out = nodes.select("node", "source_code", "description", "signature", "package")
    out = spread_by_key(out, "package", files_per_package)
    w = _csv_writer(out, mode) if fmt == "csv" else out.write.mode(mode)
    w.partitionBy("package").format(fmt).save(path)


def write_graph(nodes: DataFrame, edges: DataFrame, root: str, fmt: str = "parquet",
                files_per_package: int | None = None) -> None:
    """``root/nodes/package=…`` and ``root/edges/package=…``."""
    write_nodes(nodes, f"{root.rstrip('/')}/nodes", fmt, files_per_package=files_per_package)
    write_edges(edges, f"{root.rstrip('/')}/edges", fmt, files_per_package=files_per_package)


def write_results(results: DataFrame, path: str, mode: str = "overwrite", files_per_dataset: int | None = None) -> None:
    """Long results (``dataset_name, signature, reference, variant, candidate``) as
    CSV files of ``function signature, source code, <variant>``, in a folder for
    each variant and dataset; ``read_results(path, "*/*/*.csv")`` reads them back.

    The variants' names (a handful) are listed first: they become column names.
    """
    for row in results.select("variant").distinct().collect():
        own = results.filter(F.col("variant") == row["variant"]).select(
            "dataset_name", F.col("signature").alias("function signature"), F.col("reference").alias("source code"),
            F.col("candidate").alias(row["variant"]))
        own = spread_by_key(own, "dataset_name", files_per_dataset)
        _csv_writer(own, mode).partitionBy("dataset_name").csv(f"{path.rstrip('/')}/{row['variant']}")


def write_metrics(metrics: DataFrame, path: str, mode: str = "overwrite") -> None:
    """``dataset_name, file, metric, mean, std`` rows as one JSON object for each
    dataset and file, ``{"<metric>": mean, "<metric>_std": std, ...}``, in
    ``path/dataset_name=.../file=.../``; ``read_metrics(path, layout="partitioned")`` reads them back."""
    pairs = F.array(F.struct(F.col("metric").alias("k"), F.col("mean").alias("v")),
                    F.struct(F.concat("metric", F.lit("_std")).alias("k"), F.col("std").alias("v")))
    whole = metrics.groupBy("dataset_name", "file").agg(F.map_from_entries(F.flatten(F.collect_list(pairs))).alias("m"))
    text = whole.select("dataset_name", "file", F.to_json("m").alias("value"))
    text = text.repartition("dataset_name", "file")  # each object is a file of its own
    text.write.mode(mode).partitionBy("dataset_name", "file").option("compression", "none").format("text").save(path)


def write_comparison(cmp: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The comparison table as one CSV (a handful of rows: one per metric)."""
    _csv_writer(cmp.coalesce(1), mode).csv(path)


METRIC_LOG_BACKENDS = ("none", "print", "table")


def append_metric_log(log: DataFrame, path: str | None = None, backend: str | None = "table") -> None:
    """Record ``run, step, metric, value`` rows.

    ``table`` adds them to a parquet table partitioned by append and run, steps
    that it has already of a run and metric excepted, so that a repeated call adds
    nothing; an index of each append's steps tells which parts to compare with.
    The index is written first, so an append that dies leaves an entry without rows;
    ``print`` prints every row in order, a partition at a time; ``none`` (or
    None) does nothing; any other name is an error.
    """
    backend = "none" if backend is None else backend
    if backend not in METRIC_LOG_BACKENDS:
        raise ValueError(f"logger {backend} not found")
    if backend == "none":
        return
    rows = log.select("run", F.col("step").cast("bigint"), "metric", F.col("value").cast("double"))
    if backend == "print":
        for r in rows.orderBy("run", "step", "metric").toLocalIterator():
            print(f"{r['run']} step {r['step']}: {r['metric']} = {r['value']}")
        return
    if path is None:
        raise ValueError("table backend needs a path")
    path, spark = path.rstrip("/"), log.sparkSession
    rows = cut_lineage(rows)
    known = recorded_steps(spark, path, rows)
    new = rows if known is None else cut_lineage(rows.join(known, ["run", "step", "metric"], "left_anti"))
    batch = uuid.uuid4().hex
    spans = new.groupBy("run").agg(F.min("step").alias("low"), F.max("step").alias("high"))
    spans.select("run", F.lit(batch).alias("batch"), "low", "high").write.mode("append").parquet(f"{path}-steps")
    new.withColumn("batch", F.lit(batch)).write.mode("append").partitionBy("batch", "run").parquet(path)


_LOG_SCHEMA = "run string, step bigint, metric string, value double, batch string"


def recorded_steps(spark, path: str, rows: DataFrame) -> DataFrame | None:
    """``run, step, metric`` that the log at ``path`` has for the runs and steps of ``rows``; None if it has none.

    The index beside the log (``<path>-steps``) has the first and last step of
    each run in each append.  Only the folders of appends and runs that overlap
    with those of ``rows`` are read; their names alone pass through the driver.
    """
    try:
        index = spark.read.schema("run string, batch string, low bigint, high bigint").parquet(f"{path}-steps")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    spans = rows.groupBy("run").agg(F.min("step").alias("_low"), F.max("step").alias("_high"))
    met = index.join(spans, "run").where((F.col("low") <= F.col("_high")) & (F.col("high") >= F.col("_low")))
    met = met.groupBy("batch").agg(F.collect_set("run").alias("runs"), F.min("low").alias("low")).collect()
    if not met:
        return None
    first, last = rows.agg(F.min("step"), F.max("step")).first()
    known = spark.read.schema(_LOG_SCHEMA).parquet(path)
    known = known.where(F.col("batch").isin([m["batch"] for m in met]) & F.col("run").isin(sorted({r for m in met for r in m["runs"]})))
    return known.where(F.col("step").between(first, last)).select("run", "step", "metric")


def save_embedder(model, path: str) -> None:
    """Persist a fitted ``PipelineModel`` (overwrites)."""
    model.write().overwrite().save(path)


def load_embedder(path: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)
