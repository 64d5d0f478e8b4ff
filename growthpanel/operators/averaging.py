"""Simple and weighted averages of the growth curves."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from growthpanel.functions.columns import with_keys
from growthpanel.operators.folds import FULL, last_fold_rows
from growthpanel.operators.metrics import score
from growthpanel.operators.predictions import USABLE, curve_predictions

SIMPLE = "Simple Average"
BY_R2 = "Weighted Average (R2)"
BY_MSE = "Weighted Average (InvMSE)"
AVERAGES = [SIMPLE, BY_R2, BY_MSE]

#: keeps the inverse of a zero error finite
EPSILON = 1e-9


def components(params: DataFrame, keys: Sequence[str] = (), component_fit: str = "last_fold") -> DataFrame:
    """The curves that enter an ensemble: those of the last or first fold, or of the full fit; missing ones left out."""
    params, keys = with_keys(params, keys)
    if component_fit == "full":
        chosen = params.where(F.col("fold") == FULL)
    elif component_fit == "first_fold":
        chosen = params.where(F.col("fold") == 0)
    elif component_fit == "last_fold":
        last = F.max("fold").over(Window.partitionBy(*keys))
        chosen = params.where(F.col("fold") != FULL).withColumn("last", last).where(F.col("fold") == F.col("last"))
    else:
        raise ValueError("component_fit must be 'last_fold', 'first_fold' or 'full'")
    return chosen.where(USABLE).select(*keys, "model", "fold", "params")


def component_weights(
    target: DataFrame, folds: DataFrame, parts: DataFrame, keys: Sequence[str] = ()
) -> DataFrame:
    """r2, mse and both weights of each component on the last test block.

    The softmax subtracts the largest r2 first: same weights, and very bad scores no longer underflow to 0/0.
    """
    target, keys = with_keys(target, keys)
    block = last_fold_rows(target, folds, keys).where(F.col("role") == "test")
    scored = score(curve_predictions(block, parts, keys), [*keys, "model"])
    series = Window.partitionBy(*keys)
    weighted = scored.withColumns(
        {
            "mse": F.pow("rmse", F.lit(2.0)),
            "soft": F.exp(F.col("r2") - F.max("r2").over(series)),
        }
    ).withColumn("inverse", F.lit(1.0) / (F.col("mse") + F.lit(EPSILON)))
    return weighted.select(
        *keys,
        "model",
        "r2",
        "mse",
        (F.col("soft") / F.sum("soft").over(series)).alias("r2_weight"),
        (F.col("inverse") / F.sum("inverse").over(series)).alias("inv_mse_weight"),
    )


def average_predictions(
    rows: DataFrame, parts: DataFrame, weights: DataFrame, keys: Sequence[str] = ()
) -> DataFrame:
    """The three averages at each row (keys, pos, x and, if present, date, y), long form: model, pred."""
    rows, keys = with_keys(rows, keys)
    carried = [c for c in ("date", "x", "y") if c in rows.columns]
    each = curve_predictions(rows, parts, keys).join(weights.drop("r2", "mse"), [*keys, "model"])
    weighted = {BY_R2: F.col("r2_weight"), BY_MSE: F.col("inv_mse_weight")}
    wide = each.groupBy(*keys, "pos", *carried).agg(
        F.avg("pred").alias(SIMPLE),
        *[(F.sum(w * F.col("pred")) / F.nullif(F.sum(w), F.lit(0.0))).alias(name) for name, w in weighted.items()],
    )
    return wide.unpivot([*keys, "pos", *carried], AVERAGES, "model", "pred")


def average_metrics(predictions: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Scores of the averages over all rows: partly in-sample, which ``scope`` says."""
    predictions, keys = with_keys(predictions, keys)
    return score(predictions, [*keys, "model"]).withColumn("scope", F.lit("full_in_sample"))


def combine(*tables: DataFrame) -> DataFrame:
    """Several model tables as one; columns a table lacks are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
