"""Combining, ranking and choosing models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from growthpanel.functions.columns import with_keys
from growthpanel.functions.curves import CURVE_NAMES
from growthpanel.operators.averaging import AVERAGES
from growthpanel.operators.metrics import MEASURES

TREES = ["Random Forest", "Gradient Boosting"]
ENSEMBLES = [*TREES, *AVERAGES]


def model_order(model: Column) -> Column:
    """Place of a model in the order models are built, which decides ties; unknown names come last."""
    names = F.array(*[F.lit(n) for n in (*CURVE_NAMES, *ENSEMBLES)])
    position = F.array_position(names, model)
    return F.when(position > 0, position).otherwise(F.lit(len(CURVE_NAMES) + len(ENSEMBLES) + 1)).cast("int")


def combined_metrics(individual: DataFrame, ensemble: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Test measures of all models with their type. A name in both tables counts as individual."""
    individual, keys = with_keys(individual, keys)
    curves = individual.select(
        *keys,
        "model",
        F.lit("Individual").alias("type"),
        F.lit("test_folds").alias("scope"),
        *[F.col(f"test_{m}").alias(m) for m in MEASURES],
    )
    scope = F.col("scope") if "scope" in ensemble.columns else F.lit("test_folds")
    others = ensemble.select(*keys, "model", F.lit("Ensemble").alias("type"), scope.alias("scope"), *MEASURES)
    known = curves.select(*keys, "model")
    return curves.unionByName(others.join(known, [*keys, "model"], "left_anti"))


def _candidate(measure: str) -> Column:
    """Orders models by a score, earlier models first on ties; models without a score do not compete."""
    value = F.col(measure)
    return F.when(value > F.lit(float("-inf")), F.struct(value, -model_order(F.col("model"))))


def best_model(
    metrics: DataFrame, keys: Sequence[str] = (), primary: str = "r2", secondary: str | None = None
) -> DataFrame:
    """Model with the greatest primary measure per series; the secondary one decides if no model has the first."""
    metrics, keys = with_keys(metrics, keys)
    choice = F.max_by("model", _candidate(primary))
    score = F.max(F.when(F.col(primary) > F.lit(float("-inf")), F.col(primary)))
    if secondary is None:
        return metrics.groupBy(*keys).agg(choice.alias("best_model"), score.alias("best_score"))
    fallback = F.max_by("model", _candidate(secondary))
    fallback_score = F.max(F.when(F.col(secondary) > F.lit(float("-inf")), F.col(secondary)))
    return metrics.groupBy(*keys).agg(
        F.coalesce(choice, fallback).alias("best_model"),
        F.coalesce(score, fallback_score).alias("best_score"),
    )


def overall_score(metrics: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean of (1 - rmse), r2 and (1 - mae), each min-max scaled among the complete models of a series."""
    metrics, keys = with_keys(metrics, keys)
    complete = metrics.dropna(subset=list(MEASURES))
    series = Window.partitionBy(*keys)

    def scaled(name: str) -> Column:
        low, high = F.min(name).over(series), F.max(name).over(series)
        return (F.col(name) - low) / (high - low + F.lit(1e-10))

    score = (F.lit(1.0) - scaled("rmse") + scaled("r2") + F.lit(1.0) - scaled("mae")) / F.lit(3.0)
    return complete.withColumn("overall_score", score)


def top_per_group(df: DataFrame, by: Sequence[str], value: str, n: int, tie: Sequence[str] = ()) -> DataFrame:
    """The ``n`` rows with the greatest value of each group, with their rank."""
    order = [F.desc(value), *[F.asc(t) for t in tie]]
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.where(F.col("rank") <= n)


def melt_metrics(metrics: DataFrame, ids: Sequence[str], measures: Sequence[str] = MEASURES) -> DataFrame:
    """Wide measures to long form: metric, score."""
    return metrics.select(*ids, *measures).unpivot(list(ids), list(measures), "metric", "score")
