"""Report tables, with the column names users of the reports know."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from growthpanel.functions import curves as C
from growthpanel.functions.columns import nan_to_null, with_keys
from growthpanel.operators.averaging import BY_MSE, BY_R2
from growthpanel.operators.folds import FULL
from growthpanel.operators.metrics import prediction_summary
from growthpanel.operators.selection import ENSEMBLES

REPORT_NAMES = {"model": "Model", "type": "Type", "rmse": "RMSE", "r2": "R²", "mae": "MAE"}


def coefficient_table(params: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Model, Parameter, Value of the full fits; one "Fit Failed" row for a curve without parameters."""
    params, keys = with_keys(params, keys)
    names = C.by_curve(F.col("model"), lambda c: "|".join(c.parameters))
    labels = F.when(F.col("params").isNull(), F.array(F.lit("Fit Failed"))).otherwise(F.split(names, r"\|"))
    values = F.coalesce("params", F.array(F.lit(None).cast("double")))
    full = params.where(F.col("fold") == FULL)
    pairs = full.select(*keys, "model", F.explode(F.arrays_zip(labels.alias("name"), values.alias("value"))).alias("p"))
    return pairs.select(
        *keys, F.col("model").alias("Model"), F.col("p.name").alias("Parameter"), F.col("p.value").alias("Value")
    )


def standalone_metrics(curve_metrics: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Test measures per curve; without them RMSE and R² of training, but no MAE."""
    curve_metrics, keys = with_keys(curve_metrics, keys)
    return curve_metrics.select(
        *keys,
        F.col("model").alias("Model"),
        F.coalesce("test_rmse", "train_rmse").alias("RMSE"),
        F.coalesce("test_r2", "train_r2").alias("R²"),
        F.col("test_mae").alias("MAE"),
    )


def _predictions_wide(predictions: DataFrame, by: list[str], models: Sequence[str]) -> DataFrame:
    """One ``<model>_Pred`` column per model. A fixed list: no extra job, and an absent model is a NULL column."""
    return predictions.groupBy(*by).agg(
        *[F.max(F.when(F.col("model") == m, F.col("pred"))).alias(f"{m}_Pred") for m in models]
    )


def ensemble_input_table(curve_preds: DataFrame, ensemble_preds: DataFrame, ensemble: str, keys: Sequence[str] = ()) -> DataFrame:
    """Day, the curves' predictions and those of one ensemble."""
    curve_preds, keys = with_keys(curve_preds, keys)
    columns = [*keys, "x", "model", "pred"]
    both = curve_preds.select(*columns).unionByName(ensemble_preds.where(F.col("model") == ensemble).select(*columns))
    wide = _predictions_wide(both, [*keys, "x"], [*C.CURVE_NAMES, ensemble])
    return wide.withColumnRenamed("x", "Day")


def full_predictions(
    curve_preds: DataFrame, ensemble_preds: DataFrame, keys: Sequence[str] = (), ensembles: Sequence[str] = ENSEMBLES
) -> DataFrame:
    """Day, Actual and a column per model."""
    curve_preds, keys = with_keys(curve_preds, keys)
    columns = [*keys, "x", "y", "model", "pred"]
    both = curve_preds.select(*columns).unionByName(ensemble_preds.select(*columns))
    wide = _predictions_wide(both, [*keys, "x", "y"], [*C.CURVE_NAMES, *ensembles])
    return wide.withColumnsRenamed({"x": "Day", "y": "Actual"})


def predictions_summary(full: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean, standard deviation, least and greatest value of every prediction column; a column without values stays."""
    full, keys = with_keys(full, keys)
    names = [c for c in full.columns if c not in (*keys, "Day", "Actual")]
    long = full.select(*keys, *[nan_to_null(F.col(f"`{n}`")).alias(n) for n in names])
    long = long.unpivot(keys, [F.col(f"`{n}`") for n in names], "Model", "pred")
    return prediction_summary(long, [*keys, "Model"]).withColumnsRenamed(
        {
            "mean_predicted": "Mean_Predicted",
            "std_dev_predicted": "Std_Dev_Predicted",
            "min_predicted": "Min_Predicted",
            "max_predicted": "Max_Predicted",
        }
    )


def weighted_comparison(ensemble_metrics: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The two weighted averages side by side."""
    ensemble_metrics, keys = with_keys(ensemble_metrics, keys)
    label = F.when(F.col("model") == BY_R2, F.lit("R²")).when(F.col("model") == BY_MSE, F.lit("Inverse MSE"))
    return (
        ensemble_metrics.withColumn("Weighting_Method", label)
        .where(F.col("Weighting_Method").isNotNull())
        .select(*keys, "Weighting_Method", *[F.col(c).alias(REPORT_NAMES[c]) for c in ("rmse", "r2", "mae")])
    )


def weighted_parameters(params: DataFrame, weights: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Both weights and the growth rate of each curve's full fit; a curve outside the ensemble has no weights."""
    params, keys = with_keys(params, keys)
    model = F.col("model")
    rate = F.get("params", C.by_curve(model, lambda c: c.rate_index))
    joined = params.where(F.col("fold") == FULL).join(weights, [*keys, "model"], "left")
    return joined.select(
        *keys,
        model.alias("Model"),
        F.col("r2_weight").alias("Weight_R2"),
        F.col("inv_mse_weight").alias("Weight_InvMSE"),
        C.by_curve(model, lambda c: f"{c.rate} (rate)").alias("Growth_Rate_Param"),
        rate.alias("Growth_Rate_Value"),
    )


def overall_metrics(metrics: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Model, Type, RMSE, R², MAE: those of them that the table has."""
    metrics, keys = with_keys(metrics, keys)
    return metrics.select(*keys, *[F.col(c).alias(n) for c, n in REPORT_NAMES.items() if c in metrics.columns])
