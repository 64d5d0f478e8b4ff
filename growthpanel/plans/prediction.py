"""Predicting with a saved tree model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from growthpanel.functions.columns import require, with_keys
from growthpanel.operators.stages import PREDICTED
from growthpanel.operators.trees import TreeEnsemble
from growthpanel.operators.weekly import weekly_panel
from growthpanel.sources.storage import load_ensemble, write_table


def predict_weekly(weekly: DataFrame, ensemble: TreeEnsemble) -> DataFrame:
    """The weekly table with ``predicted_cumulative``; weeks of unknown series have none."""
    require(weekly, ["time_idx"], "the weekly table")
    weekly, _ = with_keys(weekly, ensemble.keys)
    return ensemble.pipeline.transform(weekly).select(*weekly.columns, PREDICTED)


def predict(records: DataFrame, folder: str, keys: Sequence[str] = (), scale: int | None = None, output: str | None = None) -> DataFrame:
    """Records to weekly predictions by the model saved in ``folder``/models; written to ``output`` if given."""
    records, keys = with_keys(records, keys)
    ensemble = load_ensemble(records.sparkSession, f"{folder}/models")
    predicted = predict_weekly(weekly_panel(records, keys, scale), ensemble)
    if output is not None:
        write_table(predicted, output, "parquet" if output.endswith(".parquet") else "csv")
    return predicted
