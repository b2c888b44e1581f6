"""Session helpers: a local builder for tests, lineage cutting, scratch folders."""

from __future__ import annotations

import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Paths given out and not yet removed.
_made: list[str] = []


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "12g") -> SparkSession:
    """Single-machine session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("pairwise")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a local-mode session without a configured folder gets one made for it.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for intermediate data; ``clear_scratch`` removes what was made since the last call."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def remove_path(spark: SparkSession, name: str) -> None:
    """Deletes one intermediate table that is read no more."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    if name in _made:
        _made.remove(name)


def clear_scratch(spark: SparkSession) -> int:
    """Deletes the intermediate tables of this driver. Call it once results have been read: a
    result is lazy and reads them when it is computed."""
    names = list(_made)
    for name in names:
        remove_path(spark, name)
    return len(names)


#: Makes Spark remove the shuffle files of an execution when it ends, not when the driver's garbage is collected.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_freeing: dict = {}
_lock = threading.Lock()


@contextmanager
def freeing_shuffles(spark: SparkSession):
    """For executions whose result is stored: nothing reads their shuffle files afterwards. The session gets
    its own setting back when the last of those that run side by side ends."""
    with _lock:
        held = _freeing.setdefault(spark, [0, spark.conf.get(FREED, None)])
        held[0] += 1
        spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        with _lock:
            held[0] -= 1
            if held[0] == 0:
                del _freeing[spark]
                spark.conf.unset(FREED) if held[1] is None else spark.conf.set(FREED, held[1])


def settle(df: DataFrame) -> DataFrame:
    """Compute once and cut lineage, so that loops and reuse do not recompute."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def via_table(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """As ``settle`` but columnar, so later reads prune columns and partitions."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with freeing_shuffles(spark):
        writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
