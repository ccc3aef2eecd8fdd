"""Session helpers: table loading, the shared folder, lineage cuts and input spreading."""

from __future__ import annotations

import atexit
import os
import sys
import tempfile
import types
import uuid

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The Parquet table ``name`` under ``root``."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session without the setting and without a checkpoint folder gets a temporary one; on a
    cluster a machine's own folder would lose rows, so there it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    own = spark.sparkContext.getCheckpointDir()
    if own is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("a cluster needs spark.checkpoint.dir, a folder that all executors share")
        own = os.path.join(tempfile.gettempdir(), f"corvane-{os.getuid()}")
        spark.sparkContext.setCheckpointDir(own)
        own = spark.sparkContext.getCheckpointDir()
    return own


def stage(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage is cut, a lost executor costs nothing.

    A written table keeps the column layout, so later reads prune columns; its row counts are
    known to the planner, which a checkpointed plan's are not.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/corvane-{spark.sparkContext.applicationId}"
    if folder not in _folders:
        _folders.add(folder)
        atexit.register(_remove, spark, folder)
    path = f"{folder}/{label}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


_folders: set[str] = set()


def unstage(*staged: DataFrame) -> None:
    """Removes tables of ``stage`` that nothing reads any more, before the program ends."""
    for df in staged:
        _remove(df.sparkSession, df._staged_at)


def clear(spark: SparkSession) -> None:
    """Removes all tables this application staged: for a long application, between queries whose results are written."""
    _remove(spark, f"{shared_dir(spark).rstrip('/')}/corvane-{spark.sparkContext.applicationId}")


def _remove(spark: SparkSession, folder: str) -> None:
    """Staged tables go with the program that wrote them; a folder left behind does no harm."""
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:
        pass


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` over the cluster's cores where its scan would leave most of them idle.

    A scan of a large table has enough splits and passes unchanged; only an input of fewer splits
    than half the cores is shuffled before a Python stage. A plan with a shuffle of its own is left to
    adaptive execution: to count its partitions would run it.
    """
    if "AdaptiveSparkPlan" in df._jdf.queryExecution().executedPlan().getClass().getSimpleName():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() * 2 > cores:
        return df
    return df.repartition(cores * 2, *keys) if keys else df.repartition(cores * 2)


def process_cache() -> dict:
    """A dictionary that lives as long as the Python process, for what tasks of one worker share."""
    name = "_corvane_process_cache"
    if name not in sys.modules:
        sys.modules[name] = types.ModuleType(name)
        sys.modules[name].kept = {}
    return sys.modules[name].kept
