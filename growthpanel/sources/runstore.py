"""Tables that the steps of one run share, written by name and released together."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession

#: rows of a partition of ``packed`` tables: the least that is worth a task of its own, and the most
LEAST_ROWS, MOST_ROWS = 5_000, 1_000_000


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; one is made only for a session of one process that names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="growthpanel-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as it knows it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system that Spark can reach; none is no error."""
    system, place = file_system(spark, path)
    system.delete(place, True)


class RunStore:
    """Parquet tables below ``spark.checkpoint.dir``: lineage ends there, and ``close`` leaves nothing behind.

    A table of this store can be read until ``close``; threads may share a store.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = folder or f"{ensure_checkpoint_dir(spark).rstrip('/')}/growthpanel-runs/{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write a table, and give what was written."""
        path = f"{self.folder}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    @contextmanager
    def scratch(self, name: str) -> Iterator[RunStore]:
        """A store inside this one, closed with the block: for tables that only lead to a kept one."""
        inner = RunStore(self.spark, f"{self.folder}/{name}-{uuid.uuid4().hex[:8]}")
        try:
            yield inner
        finally:
            inner.close()

    def close(self) -> None:
        delete_path(self.spark, self.folder)


def held(df: DataFrame, store: RunStore | None, name: str) -> DataFrame:
    """The table written to the store; without one it is checkpointed, and its files live as long as Spark lets them."""
    return df.checkpoint() if store is None else store.keep(df, name)


def scratch_of(store: RunStore | None, name: str):
    """``store.scratch`` as a context; no store gives none."""
    return nullcontext() if store is None else store.scratch(name)


def packed(df: DataFrame, store: RunStore | None, name: str) -> DataFrame:
    """A held table in as many partitions as its rows ask for, not as the session's shuffles have.

    For tables that hundreds of jobs read, as training does: each job has a task per partition, and each task reports to
    the driver.
    """
    kept = held(df, store, name)
    rows, cores = kept.count(), df.sparkSession.sparkContext.defaultParallelism
    return kept.coalesce(max(1, -(-rows // MOST_ROWS), min(cores, -(-rows // LEAST_ROWS))))
