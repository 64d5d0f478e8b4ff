"""Error measures as plain aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from growthpanel.functions.columns import nan_to_null

MEASURES = ("rmse", "r2", "mae")


def rmse(y: Column, pred: Column) -> Column:
    return F.sqrt(F.avg(F.pow(y - pred, F.lit(2.0))))


def mae(y: Column, pred: Column) -> Column:
    return F.avg(F.abs(y - pred))


def r_squared(y: Column, pred: Column) -> Column:
    """1 - SSE/SST; a constant target scores 1 when met exactly, else 0; fewer than two rows score NULL."""
    errors = F.sum(F.pow(y - pred, F.lit(2.0)))
    constant = F.min(y) == F.max(y)
    return (
        F.when(F.count(pred) < 2, F.lit(None).cast("double"))
        .when(constant & (errors == 0), F.lit(1.0))
        .when(constant, F.lit(0.0))
        .otherwise(F.lit(1.0) - errors / F.nullif(F.regr_syy(y, y), F.lit(0.0)))
    )


def score(df: DataFrame, by: Sequence[str], y: str = "y", pred: str = "pred") -> DataFrame:
    """rmse, r2, mae and row count per group."""
    actual, fitted = F.col(y), F.col(pred)
    scored = df.groupBy(*by).agg(
        rmse(actual, fitted).alias("rmse"),
        r_squared(actual, fitted).alias("r2"),
        mae(actual, fitted).alias("mae"),
        F.count(fitted).alias("n"),
    )
    return scored.withColumns({m: nan_to_null(F.col(m)) for m in MEASURES})


def fold_summary(fold_metrics: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean and population standard deviation of each measure over folds; NULL without folds."""
    return fold_metrics.groupBy(*by).agg(
        *[F.avg(m).alias(m) for m in MEASURES],
        *[F.stddev_pop(m).alias(f"{m}_std") for m in MEASURES],
        F.count("rmse").cast("int").alias("folds"),
    )


def prediction_summary(predictions: DataFrame, by: Sequence[str], pred: str = "pred") -> DataFrame:
    """Mean, sample standard deviation, least and greatest prediction per group, missing predictions left out."""
    return predictions.groupBy(*by).agg(
        F.avg(pred).alias("mean_predicted"),
        F.stddev_samp(pred).alias("std_dev_predicted"),
        F.min(pred).alias("min_predicted"),
        F.max(pred).alias("max_predicted"),
    )
