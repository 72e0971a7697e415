"""The graph job in steps: only packages that are not in the manifest, or changed since, are read and rewritten.

The output is parquet partitioned by package (``nodes``, ``edges``, ``errors``,
``unmatched``, ``completeness``, ``status``) and a ``manifest`` of one row per
package: its version, its status and the run that wrote it.  Outputs are written
with dynamic partition overwrite, so a run touches the folders of its own
packages alone; a package without a row in some output gets an empty one there,
so that nothing of an earlier version stays.  The manifest's partitions are
written last: a run that dies before leaves its packages pending.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.plans.graph_build import build_graph
from codeloom.session import cut_lineage
from codeloom.sources.readers import pending_packages

PKG = "package"
#: A column of each output that is null in the row that stands for "nothing".
OUTPUTS = {"nodes": "node", "edges": "node1", "errors": "path", "unmatched": "function", "completeness": "edges", "status": "status"}
INPUTS = ("src", "entries", "calls", "log", "roots")


def read_manifest(spark: SparkSession, root: str, package_type: str = "string") -> DataFrame:
    """``package, version, status, run`` of every package written below ``root``; empty before the first run."""
    schema = f"version string, status string, run long, {PKG} {package_type}"
    try:
        return spark.read.schema(schema).parquet(f"{root.rstrip('/')}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def pending(versions: DataFrame, manifest: DataFrame) -> DataFrame:
    """Packages of ``versions`` (package, version) that the manifest lacks or has in another version."""
    current = manifest.join(versions.select(PKG, F.col("version").alias("_v")), PKG) \
        .where(F.col("version").eqNullSafe(F.col("_v")))
    return pending_packages(versions, current, PKG)


def _replace(df: DataFrame, packages: DataFrame, path: str, key: str | None) -> None:
    """Overwrite the partitions of ``packages``, also those that ``df`` has nothing for.

    A package without rows gets one of nulls.  The packages of a run, which are few,
    are sent to ``df``, which is not dealt by package to be joined.  It is rebalanced
    instead: small packages are a file each, a large one is many tasks'.
    """
    if key:
        missing = packages.join(df.select(PKG).distinct(), PKG, "left_anti")
        df = df.join(F.broadcast(packages), PKG).select(*df.columns).unionByName(missing, allowMissingColumns=True)
    df = df.hint("rebalance", PKG)
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PKG).parquet(path)


def read_output(spark: SparkSession, root: str, name: str, package_type: str = "string") -> DataFrame:
    """One output of all packages, without the rows that stand for nothing."""
    path = f"{root.rstrip('/')}/{name}"
    df = spark.read.parquet(path)
    return df.where(F.col(OUTPUTS[name]).isNotNull()).withColumn(PKG, F.col(PKG).cast(package_type))


def update_graph(
    spark: SparkSession,
    root: str,
    versions: DataFrame,
    inputs: dict[str, DataFrame] | Callable[[list], dict[str, DataFrame]],
    at_once: int = 1000,
    **options,
) -> list:
    """Build the packages of ``versions`` (package, version) that are pending below ``root``, and return them.

    ``inputs`` holds the tables of :func:`codeloom.plans.graph_build.build_graph`
    by name, or makes them for a list of packages: then only their folders need
    to be read.  Given tables are cut to the pending packages by a semi join,
    which prunes partitions where they are partitioned by package.  Packages go
    in runs of at most ``at_once``; only their names reach the driver.
    ``options`` go to ``build_graph``.
    """
    package_type = versions.schema[PKG].dataType.simpleString()
    manifest = read_manifest(spark, root, package_type)
    todo = cut_lineage(pending(versions.select(PKG, F.col("version").cast("string").alias("version")), manifest))
    last = manifest.agg(F.max("run")).first()[0] or 0
    names = [r[PKG] for r in todo.select(PKG).orderBy(PKG).toLocalIterator()]
    for k in range(0, len(names), at_once):
        some = names[k:k + at_once]
        _run(spark, root.rstrip("/"), todo.where(F.col(PKG).isin(some)), some, inputs, last + 1 + k // at_once, options)
    return names


def _run(spark: SparkSession, root: str, packages: DataFrame, names: list, inputs, run: int, options: dict) -> None:
    tables = inputs(names) if callable(inputs) else inputs
    own = packages.select(PKG)
    tables = {k: df.join(F.broadcast(own), PKG, "left_semi") for k, df in tables.items()}
    out = build_graph(*(tables[k] for k in INPUTS), **options)
    for name, key in OUTPUTS.items():
        _replace(out[name], own, f"{root}/{name}", key)
    status = read_output(spark, root, "status", packages.schema[PKG].dataType.simpleString()).join(own, PKG, "left_semi")
    entry = packages.join(status.select(PKG, "status"), PKG, "left")
    _replace(entry.select("version", "status", F.lit(run).cast("long").alias("run"), PKG), own, f"{root}/manifest", None)
