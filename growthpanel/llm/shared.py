"""Tables that several jobs of one operator read, kept where every executor can reach them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: a word: a run of anything but the six ASCII white-space characters
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a folder of our own only where that is unset (tests on one machine)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="growthpanel-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return f"{folder.rstrip('/')}/growthpanel-{spark.sparkContext.applicationId}"


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system that Spark can reach; none is no error."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


#: shelves made inside ``shelves_cleared``, the innermost one last
_made: list[list[Shelf]] = []


@contextmanager
def shelves_cleared() -> Iterator[None]:
    """Delete, at the end of the block, the tables of all shelves made in it; its results must be written by then."""
    _made.append([])
    try:
        yield
    finally:
        for shelf in _made.pop():
            shelf.clear()


class Shelf:
    """Tables written to the shared folder: lineage ends there, so a lost executor costs one read, not the job before.

    Tables that a later one replaces go at once (``forget``); ``clear`` takes the rest when the results are written,
    and ``shelves_cleared`` does so for all that was made in a block.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{shared_folder(spark)}/{uuid.uuid4().hex}"
        if _made:
            _made[-1].append(self)

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}-{uuid.uuid4().hex[:8]}"

    def keep(self, df: DataFrame, name: str = "table") -> DataFrame:
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._shelf_path = path
        return kept

    def forget(self, df: DataFrame) -> None:
        delete_path(self.spark, df._shelf_path)

    def clear(self) -> None:
        delete_path(self.spark, self.folder)


def in_slices(column: pa.Array, rows: int = 32) -> Iterator:
    """The values of an Arrow column as Python objects, a few rows at a time: a batch is never held twice."""
    for i in range(0, len(column), rows):
        yield from column.slice(i, rows).to_pylist()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def running_offsets(sums: DataFrame, keys: Sequence[str], order: str, value: str, name: str) -> DataFrame:
    """``sums`` with the sum of ``value`` over all rows of the same keys before this one: one row per input part."""
    from pyspark.sql import Window

    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return sums.withColumn(name, F.coalesce(F.sum(value).over(before), F.lit(0)))


def hex64(value: Column) -> Column:
    """A long as 16 lower-case hex digits, read as unsigned."""
    return F.lower(F.lpad(F.hex(value), 16, "0"))
