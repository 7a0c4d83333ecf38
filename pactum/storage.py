"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: Rows that go to Python at a time while a table is stored.
BATCH_ROWS = 2_000


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the session names in ``spark.checkpoint.dir``. Where it names
    none, a session on one machine gets a folder of its own; on a cluster it is an error,
    because executors would write to their own disks."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-pactum-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def set_conf(spark: SparkSession, key: str, value) -> Iterator[None]:
    """A session setting for what runs inside; then as it was."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(value))
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


@contextmanager
def measured_broadcasts(spark: SparkSession) -> Iterator[None]:
    """Joins planned inside broadcast a side for its size as a finished shuffle shows it, or for a hint, but not
    for the size of its files: columns that repeat shrink to almost nothing there, and the driver holds every row."""
    static, shown = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    with set_conf(spark, shown, spark.conf.get(shown, None) or spark.conf.get(static)), set_conf(spark, static, -1):
        yield


def stored(df: DataFrame, name: str, path: str | None = None, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends there, so a lost
    executor costs a read, not a recomputation, and the shuffles behind it are freed once
    it stands. The files are the job's: who sets the folder clears it, as with Spark's own
    checkpoints; a caller that gives ``path`` may ``remove`` it sooner. ``batch_rows`` go to
    Python at a time."""
    spark = df.sparkSession
    path = path or shared_path(spark, name)
    # Small batches: rows here hold whole texts, and each task has some batches in memory.
    with set_conf(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"), set_conf(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", batch_rows):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(path: str) -> None:
    """Deletes what ``stored`` wrote to ``path``, once nothing reads it any more."""
    from pyarrow import fs

    files, place = fs.FileSystem.from_uri(path)
    files.delete_dir(place)


def dealt(df: DataFrame) -> DataFrame:
    """A table of fewer files than the session has cores, dealt out to all of them: a small file is
    one task however many cores wait. Tables of many files stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df
