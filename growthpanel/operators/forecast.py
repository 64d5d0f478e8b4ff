"""Future weeks, point forecasts and parameter-noise intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from growthpanel.functions import curves as C
from growthpanel.functions.columns import with_keys
from growthpanel.functions.noise import repeatable_normal

#: five years of weeks
HORIZON_WEEKS = 260


def horizon(target: DataFrame, keys: Sequence[str] = (), weeks: int = HORIZON_WEEKS) -> DataFrame:
    """The ``weeks`` Sundays after the last week of each series: date, pos, x."""
    target, keys = with_keys(target, keys)
    ends = target.groupBy(*keys).agg(
        F.max("date").alias("last_date"), F.max("x").alias("last_x"), F.max("pos").alias("last_pos")
    )
    ahead = ends.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(weeks))))
    return ahead.select(
        *keys,
        F.date_add("last_date", F.col("step") * 7).alias("date"),
        (F.col("last_pos") + F.col("step")).cast("int").alias("pos"),
        (F.col("last_x") + F.col("step")).alias("x"),
    )


def best_curve_params(params: DataFrame, best: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Full-fit parameters of each series' best curve."""
    params, keys = with_keys(params, keys)
    named = best.select(*keys, F.col("best_model").alias("model"))
    return params.join(named, [*keys, "model"]).select(*keys, "model", "params")


def noisy_params(best: DataFrame, keys: Sequence[str] = (), draws: int = 1000, spread: float = 0.05, seed: int = 42) -> DataFrame:
    """``draws`` copies of each parameter array, every parameter times 1 + N(0, spread); the same in every run."""
    best, keys = with_keys(best, keys)
    drawn = best.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    ident = [F.col(c) for c in (*keys, "model", "draw")]
    noisy = [
        F.get("params", F.lit(i)) * (F.lit(1.0) + F.lit(spread) * repeatable_normal(seed, F.lit(i), *ident))
        for i in range(max(len(c.parameters) for c in C.CURVES.values()))
    ]
    return drawn.withColumn("params", F.filter(F.array(*noisy), lambda v: v.isNotNull()))


def param_noise_interval(
    future: DataFrame,
    best: DataFrame,
    keys: Sequence[str] = (),
    draws: int = 1000,
    confidence: float = 0.95,
    spread: float = 0.05,
    seed: int = 42,
) -> DataFrame:
    """Mean and percentile bounds of the best curve under parameter noise, per future week.

    The interval shows the effect of 5 % parameter noise only, not the residual variance. The draws of a series are one
    array that each of its weeks meets; nothing is exploded.
    """
    future, keys = with_keys(future, keys)
    low, high = (1.0 - confidence) / 2.0, (1.0 + confidence) / 2.0
    drawn = noisy_params(best, keys, draws, spread, seed).groupBy(*keys, "model").agg(F.collect_list("params").alias("drawn"))
    value = F.transform("drawn", lambda params: C.evaluate_by_name(F.col("model"), F.col("x"), params))
    weeks = future.select(*keys, "pos", "x").join(drawn, keys)
    weeks = weeks.withColumn("preds", F.sort_array(F.filter(value, lambda v: v.isNotNull())))

    def bound(share: float) -> Column:
        """Between the two draws next to that share of the way, like a percentile over rows."""
        at = F.lit(share) * (F.size("preds") - 1)
        below = F.floor(at).cast("int")
        first, second = F.get("preds", below), F.get("preds", F.ceil(at).cast("int"))
        return first + (second - first) * (at - below)

    mean = F.aggregate("preds", F.lit(0.0), lambda total, v: total + v) / F.nullif(F.size("preds"), F.lit(0))
    return weeks.select(
        *keys, "pos", mean.alias("mean_pred"), bound(low).alias("lower_bound_ci"), bound(high).alias("upper_bound_ci")
    )


def forecast_table(
    future: DataFrame,
    best: DataFrame,
    ensemble_forecast: DataFrame,
    interval: DataFrame,
    keys: Sequence[str] = (),
) -> DataFrame:
    """date, time_idx, best_model_forecast, best_ensemble_forecast and bounds, one row per series and future week.

    ``ensemble_forecast`` has keys, pos and pred of each series' best ensemble.
    """
    future, keys = with_keys(future, keys)
    point = C.evaluate_by_name(F.col("model"), F.col("x"), F.col("params"))
    curve = future.join(best, keys).withColumn("best_model_forecast", point)
    ensemble = ensemble_forecast.select(*keys, "pos", F.col("pred").alias("best_ensemble_forecast"))
    bounds = interval.select(*keys, "pos", "lower_bound_ci", "upper_bound_ci")
    joined = curve.join(ensemble, [*keys, "pos"], "left").join(bounds, [*keys, "pos"], "left")
    return joined.select(
        *keys,
        "date",
        F.col("x").alias("time_idx"),
        "best_model_forecast",
        "best_ensemble_forecast",
        "lower_bound_ci",
        "upper_bound_ci",
    )
