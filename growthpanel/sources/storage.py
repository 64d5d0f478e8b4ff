"""Writing report tables and saving what prediction needs later."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from growthpanel.operators.trees import BOOSTING, FOREST, TreeEnsemble
from growthpanel.sources.runstore import delete_path, file_system

MANIFESTS = "manifests"


def write_table(
    df: DataFrame, path: str, format: str = "csv", partition_by: Sequence[str] = (), cluster_by: Sequence[str] = ()
) -> None:
    """Write a table, replacing what is there; CSV gets a header.

    With ``cluster_by``, files hold ranges of these columns that do not overlap, sorted, so a reader of one key opens one
    file, and parquet's statistics say which. A key's rows are one task's: cluster by keys whose groups are bounded, as
    a series is by its weeks and models.
    """
    if cluster_by:
        df = df.repartitionByRange(*cluster_by).sortWithinPartitions(*cluster_by)
    writer = df.write.mode("overwrite").format(format)
    if format == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def slug(name: str) -> str:
    """A name as part of a path: lower-case words with hyphens."""
    return "-".join(re.findall("[a-z0-9]+", name.lower()))


def write_reports(tables: dict[str, DataFrame], folder: str, format: str = "csv", keys: Sequence[str] = ()) -> list[str]:
    """One folder per table, clustered by those of ``keys`` that the table has."""
    paths = []
    for name, table in tables.items():
        path = f"{folder}/{slug(name)}"
        write_table(table, path, format, cluster_by=[k for k in keys if k in table.columns])
        paths.append(path)
    return paths


@contextmanager
def publishing(spark: SparkSession, folder: str) -> Iterator[str]:
    """A new version's folder to write in. It becomes the current version when the block ends without an error.

    The manifest is one small file, written last and never over another: a run that breaks off leaves the version before
    it in force, and of two runs that end together the later one takes the next number.
    """
    version = f"versions/{uuid.uuid4().hex}"
    yield f"{folder}/{version}"
    line = json.dumps({"version": version}).encode()
    while True:
        system, place = file_system(spark, f"{folder}/{MANIFESTS}/{max(_manifests(spark, folder), default=0) + 1:08d}.json")
        try:
            out = system.create(place, False)
        except Py4JJavaError:
            if system.exists(place):
                continue
            raise
        out.write(bytearray(line))
        out.close()
        return


def _manifests(spark: SparkSession, folder: str) -> dict[int, str]:
    """Paths of the manifests by number."""
    system, place = file_system(spark, f"{folder}/{MANIFESTS}")
    if not system.exists(place):
        return {}
    paths = [(found.getPath().getName(), found.getPath().toString()) for found in system.listStatus(place)]
    return {int(name[:-5]): path for name, path in paths if re.fullmatch(r"[0-9]+\.json", name)}


def current_version(spark: SparkSession, folder: str) -> str:
    """The folder of the last version that was written whole."""
    for _, path in sorted(_manifests(spark, folder).items(), reverse=True):
        lines = spark.read.text(path).head(1)
        try:
            return f"{folder}/{json.loads(lines[0][0])['version']}"
        except (IndexError, ValueError, KeyError):
            continue  # a manifest that was not written to its end
    raise FileNotFoundError(f"no saved tree model in {folder}: it has no whole version")


def drop_old_versions(spark: SparkSession, folder: str, keep: int = 1) -> int:
    """Delete all published versions but the last ``keep``, at least one; how many went. Runs under way are left alone."""
    old = sorted(_manifests(spark, folder).items(), reverse=True)[max(1, keep) :]
    for _, path in old:
        lines = spark.read.text(path).head(1)
        delete_path(spark, path)  # first the manifest: no reader may find a version that is half gone
        try:
            delete_path(spark, f"{folder}/{json.loads(lines[0][0])['version']}")
        except (IndexError, ValueError, KeyError):
            continue
    return len(old)


def save_models(ensembles: Iterable[TreeEnsemble], params: DataFrame, best: DataFrame, folder: str) -> None:
    """A new version of all that prediction needs: every fitted curve, the best one per series, the tree pipelines."""
    with publishing(params.sparkSession, folder) as version:
        write_table(params, f"{version}/curves", "parquet")
        write_table(best, f"{version}/best_curve", "parquet")
        for ensemble in ensembles:
            ensemble.pipeline.write().overwrite().save(f"{version}/{slug(ensemble.name)}")


def load_curves(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The fitted curves, and which one is best per series."""
    version = current_version(spark, folder)
    return spark.read.parquet(f"{version}/curves"), spark.read.parquet(f"{version}/best_curve")


def load_ensemble(spark: SparkSession, folder: str) -> TreeEnsemble:
    """The saved random forest, else the saved boosting model, of the current version."""
    version = current_version(spark, folder)
    for name in (FOREST, BOOSTING):
        path = f"{version}/{slug(name)}"
        system, place = file_system(spark, path)
        if system.exists(place):
            pipeline = PipelineModel.load(path)
            return TreeEnsemble(name, pipeline, pipeline.stages[0].getKeys())
    raise FileNotFoundError(f"no saved tree model in {folder}")
