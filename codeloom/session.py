"""Session helpers.

The library never builds its own cluster configuration: jobs run in whatever
session the caller hands in.  ``local_session`` is only for tests, benches and
the command line, and sets defaults only where the session leaves them unset.
"""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DEFAULTS = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "16g",
}


def local_session(cores: int | str = "*", app: str = "codeloom") -> SparkSession:
    """A local session for tests and benches (never used on a cluster)."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in _LOCAL_DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting names a shared folder and is used as is.  Only a
    session whose master is ``local`` may leave it unset: then a fresh folder
    of this machine is chosen, which such a session's tasks all see.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - a remote (Connect) session has no context
        if not configured:
            raise RuntimeError("spark.checkpoint.dir is not set") from None
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    if not configured:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="codeloom-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder.

    Survives executor loss (unlike a local checkpoint): the data is written to
    the folder named by ``spark.checkpoint.dir``.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def env_cores(default: str = "8") -> str:
    return os.environ.get("BENCH_CPUS", default)


def dealt(df: DataFrame, partitions: int | None) -> DataFrame:
    """Deal rows evenly over ``partitions`` tasks, if the caller names a number.

    For Python steps right after a file scan that arrives in few splits; the
    number is the caller's choice, nothing is looked at or run to find it.
    """
    return df.repartition(partitions) if partitions else df


def ship_package(spark: SparkSession) -> str:
    """Zip this package and add it to every executor's Python path.

    Needed where executors have no installed copy; Python steps are pickled by
    module name.  Returns the path of the zip on the driver.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="codeloom-"), "codeloom"), "zip", root, "codeloom")
    spark.sparkContext.addPyFile(path)
    return path
