"""The steps around a tree model as MLlib stages that save the tables they need, so a saved pipeline predicts alone."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from growthpanel.functions.columns import SINGLE_KEY, with_keys
from growthpanel.operators.features import feature_names, make_features, scale

PREDICTED = "predicted_cumulative"


class _Writer(MLWriter):
    def __init__(self, stage: SeriesStage):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        for name, table in self.stage.tables.items():
            table.write.parquet(f"{path}/tables/{name}")
        DefaultParamsWriter.saveMetadata(self.stage, path, self.sparkSession)


class _Reader(MLReader):
    def __init__(self, kind: type[SeriesStage]):
        super().__init__()
        self.kind = kind

    def load(self, path: str) -> SeriesStage:
        saved = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        stage = self.kind(**{name: self.sparkSession.read.parquet(f"{path}/tables/{name}") for name in self.kind.names})
        stage._resetUid(saved["uid"])
        DefaultParamsReader.getAndSetParams(stage, saved)
        return stage


class SeriesStage(Transformer, MLWritable, MLReadable):
    """A stage with tables of a few rows per series, which are joined by the keys and saved beside its parameters."""

    names: tuple[str, ...] = ()
    keys = Param(Params._dummy(), "keys", "columns that name a series", TypeConverters.toListString)

    def __init__(self, keys: Sequence[str] = (), **tables: DataFrame):
        super().__init__()
        if set(tables) != set(self.names):
            raise ValueError(f"{type(self).__name__} needs the tables {self.names}, not {tuple(tables)}")
        self._set(keys=list(keys))
        self.tables = tables

    def getKeys(self) -> list[str]:
        return self.getOrDefault(self.keys)

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class CurveFeatures(SeriesStage):
    """Curve and time features at the time ``x`` of a row, or ``time_idx`` in a weekly table that has no ``x``."""

    names = ("params", "context")

    def _transform(self, rows: DataFrame) -> DataFrame:
        if self.getKeys() == [SINGLE_KEY]:
            rows, _ = with_keys(rows, ())
        timed = rows if "x" in rows.columns else rows.withColumn("x", F.col("time_idx"))
        return make_features(timed, self.tables["params"], self.tables["context"], self.getKeys())


class SeriesScaling(SeriesStage):
    """Features standardised per series, the target's scale, and ``tree_status``: ``missing_curve`` where one is missing.

    Missing features become 0, as the model takes no NULL; the status keeps such rows without a prediction.
    """

    names = ("scaler", "target_scale")

    def _transform(self, rows: DataFrame) -> DataFrame:
        scaled = scale(rows, self.tables["scaler"], self.getKeys()).join(self.tables["target_scale"], self.getKeys(), "left")
        complete = reduce(and_, (F.col(f"`{c}`").isNotNull() for c in [*feature_names(), "target_scale"]))
        status = F.when(complete, F.lit("ok")).otherwise(F.lit("missing_curve"))
        return scaled.withColumn("tree_status", status).na.fill(0.0, subset=feature_names())


class SeriesTarget(SeriesStage):
    """The prediction on the scale of its series as ``predicted_cumulative``; the columns of the stages before go."""

    def _transform(self, rows: DataFrame) -> DataFrame:
        value = F.when(F.col("tree_status") == "ok", F.col("prediction") * F.col("target_scale"))
        return rows.withColumn(PREDICTED, value).drop(*feature_names(), "features", "prediction", "target_scale")
