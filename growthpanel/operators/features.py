"""Features for the tree ensembles: one prediction per curve, normalised time, its sine and cosine; standardised."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from growthpanel.functions import curves as C
from growthpanel.functions.columns import with_keys
from growthpanel.operators.predictions import USABLE

TIME_FEATURES = ["time_norm", "time_norm_sin", "time_norm_cos"]


def feature_names() -> list[str]:
    """The curves in fit order, then the time features."""
    return [*C.CURVE_NAMES, *TIME_FEATURES]


def time_context(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Least and greatest x per series; normalised time is measured inside this range."""
    rows, keys = with_keys(rows, keys)
    return rows.groupBy(*keys).agg(F.min("x").alias("context_min"), F.max("x").alias("context_max"))


def normalised_time() -> Column:
    """0 to 1 inside the context, beyond it outside; 0 if there is no context or it is one point."""
    span = F.col("context_max") - F.col("context_min")
    return F.when(span != 0, (F.col("x") - F.col("context_min")) / (span + F.lit(1e-9))).otherwise(F.lit(0.0))


def time_features(rows: DataFrame, context: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    rows, keys = with_keys(rows, keys)
    timed = rows.join(context, keys, "left").withColumn("time_norm", normalised_time())
    angle = F.lit(2.0 * math.pi) * F.col("time_norm")
    return timed.withColumns({"time_norm_sin": F.sin(angle), "time_norm_cos": F.cos(angle)}).drop(
        "context_min", "context_max"
    )


def curve_features(rows: DataFrame, params: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One column per curve, NULL where the series lacks that curve.

    The parameters are pivoted, one per curve, so the weekly rows are never multiplied.
    """
    rows, keys = with_keys(rows, keys)
    wide = params.where(USABLE).groupBy(*keys).pivot("model", C.CURVE_NAMES).agg(F.first("params"))
    wide = wide.select(*keys, *[F.col(m).alias(f"{m}_params") for m in C.CURVE_NAMES])
    named = {m: C.evaluate(m, F.col("x"), F.col(f"{m}_params")) for m in C.CURVE_NAMES}
    return rows.join(wide, keys, "left").withColumns(named).drop(*[f"{m}_params" for m in C.CURVE_NAMES])


def make_features(rows: DataFrame, params: DataFrame, context: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    rows, keys = with_keys(rows, keys)
    return time_features(curve_features(rows, params, keys), context, keys)


def fit_scaler(features: DataFrame, keys: Sequence[str] = (), names: Sequence[str] | None = None) -> DataFrame:
    """Mean and population standard deviation of each feature per series; a constant feature is divided by 1."""
    features, keys = with_keys(features, keys)
    names = names or feature_names()
    spread = {n: F.stddev_pop(n) for n in names}
    return features.groupBy(*keys).agg(
        *[F.avg(n).alias(f"{n}_mean") for n in names],
        *[F.when(s > 0, s).otherwise(F.lit(1.0)).alias(f"{n}_scale") for n, s in spread.items()],
    )


def scale(features: DataFrame, scaler: DataFrame, keys: Sequence[str] = (), names: Sequence[str] | None = None) -> DataFrame:
    features, keys = with_keys(features, keys)
    names = names or feature_names()
    scaled = {n: (F.col(n) - F.col(f"{n}_mean")) / F.col(f"{n}_scale") for n in names}
    used = [c for n in names for c in (f"{n}_mean", f"{n}_scale")]
    return features.join(scaler.select(*keys, *used), keys, "left").withColumns(scaled).drop(*used)
