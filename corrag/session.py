"""Session defaults, staging tables that cut lineage, and partition-width helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_CONF = "spark.checkpoint.dir"
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
_CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_WRITERS_CONF = "spark.sql.maxConcurrentOutputFileWriters"
#: Bytes of an Arrow batch of whole texts; the JVM and the Python worker hold one each for every task.
TEXT_BATCH = 1 << 22


def build_session(app_name: str = "corrag", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on. Cluster sizing stays with spark-submit."""
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder of this machine; on a cluster the
    setting must name storage that every executor reaches.
    """
    folder = spark.conf.get(_CHECKPOINT_CONF, None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {_CHECKPOINT_CONF} to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="corrag-")
    spark.conf.set(_CHECKPOINT_CONF, folder)
    return folder


def new_shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/corrag/{name}-{uuid.uuid4().hex}"


@contextmanager
def _set(spark: SparkSession, key: str, value: str | int) -> Iterator[None]:
    own = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, own)


def arrow_batches(spark: SparkSession, most: int) -> AbstractContextManager[None]:
    """Arrow batches of jobs that run inside hold about ``most`` bytes, or the session's own limit if that is lower."""
    own = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH_CONF))
    return _set(spark, _BATCH_CONF, min(most, own))


def shuffles_dropped(spark: SparkSession) -> AbstractContextManager[None]:
    """The shuffle files of a job that runs inside go as it ends, not when the driver happens to collect its garbage."""
    return _set(spark, _CLEANUP_CONF, "true")


def open_files(spark: SparkSession, most: int) -> AbstractContextManager[None]:
    """Tasks of jobs that run inside write to so many partitions of a table at once, and sort only rows of further ones."""
    return _set(spark, _WRITERS_CONF, most)


def staged(df: DataFrame, name: str, batch_bytes: int | None = None) -> DataFrame:
    """Write ``df`` once to shared storage and read it back.

    Later branches read the files instead of recomputing, lost executors cost nothing but a
    re-read, and the planner sees real file sizes, so it broadcasts the table only when it
    is under ``spark.sql.autoBroadcastJoinThreshold``. ``batch_bytes`` bounds the Arrow batches
    that go to Python meanwhile.
    """
    spark = df.sparkSession
    path = new_shared_path(spark, name)
    with arrow_batches(spark, batch_bytes) if batch_bytes else nullcontext():
        df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def widened(df: DataFrame, *keys: str) -> DataFrame:
    """Spread a table that was read in fewer slices than there are cores.

    A table of many files or row groups already fills the cluster and is returned unchanged,
    so large inputs pay no shuffle here. ``keys`` makes the spread deterministic on retry.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)
