"""Curve predictions on weekly rows, and the error measures of each curve."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from growthpanel.functions import curves as C
from growthpanel.functions.columns import with_keys
from growthpanel.operators.folds import FULL, fold_rows
from growthpanel.operators.metrics import MEASURES, fold_summary, score

USABLE = "params IS NOT NULL"


def curve_predictions(rows: DataFrame, params: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Each row once per curve of its series, with ``pred``. ``params`` has keys, model, params."""
    rows, keys = with_keys(rows, keys)
    joined = rows.join(params.where(USABLE).select(*keys, "model", "params"), keys)
    pred = C.evaluate_by_name(F.col("model"), F.col("x"), F.col("params"))
    return joined.withColumn("pred", pred).drop("params")


def full_fit(params: DataFrame) -> DataFrame:
    return params.where(F.col("fold") == FULL)


def fold_predictions(target: DataFrame, folds: DataFrame, params: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Train and test rows of each fold with the prediction of that fold's curves."""
    target, keys = with_keys(target, keys)
    rows = fold_rows(target, folds, keys).select(*keys, "fold", "role", "pos", "x", "y")
    joined = rows.join(params.where(USABLE).select(*keys, "fold", "model", "params"), [*keys, "fold"])
    pred = C.evaluate_by_name(F.col("model"), F.col("x"), F.col("params"))
    return joined.withColumn("pred", pred).drop("params")


def fold_metrics(target: DataFrame, folds: DataFrame, params: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """rmse, r2, mae per series, curve, fold and role (train, test)."""
    target, keys = with_keys(target, keys)
    return score(fold_predictions(target, folds, params, keys), [*keys, "model", "fold", "role"])


def curve_metrics(target: DataFrame, folds: DataFrame, params: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row per series and curve: test and train measures over folds, with their spread.

    A series without folds has train measures of the full fit and no test measures.
    """
    target, keys = with_keys(target, keys)
    by = [*keys, "model"]
    summary = fold_summary(fold_metrics(target, folds, params, keys), [*by, "role"])
    in_role = {role: F.col("role") == role for role in ("test", "train")}
    wide = summary.groupBy(*by).agg(
        *[
            F.max(F.when(is_role, F.col(f"{m}{suffix}"))).alias(f"{role}_{m}{suffix}")
            for role, is_role in in_role.items()
            for m in MEASURES
            for suffix in ("", "_std")
        ],
        F.max(F.when(in_role["test"], F.col("folds"))).alias("folds"),
    )
    whole = score(curve_predictions(target, full_fit(params), keys), by)
    joined = whole.select(*by, *[F.col(m).alias(f"full_{m}") for m in MEASURES]).join(wide, by, "left")
    no_folds = F.col("folds").isNull()
    return joined.withColumns(
        {
            "train_rmse": F.when(no_folds, F.col("full_rmse")).otherwise(F.col("train_rmse")),
            "train_r2": F.when(no_folds, F.col("full_r2")).otherwise(F.col("train_r2")),
            "folds": F.coalesce("folds", F.lit(0)),
        }
    )
