"""The tables behind each figure. Drawing is left to the user's plotting tool."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from growthpanel.functions.columns import clip, ratio, with_keys
from growthpanel.functions.noise import normal_quantile
from growthpanel.operators.averaging import BY_MSE, BY_R2, SIMPLE
from growthpanel.operators.folds import with_last_fold_role
from growthpanel.operators.metrics import score
from growthpanel.operators.selection import ENSEMBLES, combined_metrics, melt_metrics, overall_score, top_per_group
from growthpanel.operators.trees import BOOSTING, FOREST


def residuals(predictions: DataFrame) -> DataFrame:
    """y - pred beside pred; rows without a prediction are left out."""
    return predictions.where(F.col("pred").isNotNull()).withColumn("residual", F.col("y") - F.col("pred"))


def normal_qq(resid: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Ordered residuals against normal quantiles of Filliben's order-statistic medians, with the fitted line."""
    resid, keys = with_keys(resid, keys)
    by = [*keys, "model"]
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("residual", "pos"))
    last = F.pow(F.lit(0.5), F.lit(1.0) / n)
    middle = (rank - F.lit(0.3175)) / (n + F.lit(0.365))
    position = F.when(rank == n, last).when(rank == 1, F.lit(1.0) - last).otherwise(middle)
    ordered = resid.select(
        *by, rank.alias("rank"), normal_quantile(position).alias("theoretical"), F.col("residual").alias("ordered")
    )
    model = Window.partitionBy(*by)
    y, x = F.col("ordered"), F.col("theoretical")
    return ordered.withColumns(
        {
            "slope": F.regr_slope(y, x).over(model),
            "intercept": F.regr_intercept(y, x).over(model),
            "line_r2": F.regr_r2(y, x).over(model),
        }
    ).withColumn("fitted", F.col("intercept") + F.col("slope") * F.col("theoretical"))


def histogram_bins(resid: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Bin count and width per model: the narrower of Sturges' and Freedman-Diaconis' widths (Sturges' if that is 0)."""
    resid, keys = with_keys(resid, keys)
    facts = resid.groupBy(*keys, "model").agg(
        F.count("residual").alias("n"),
        F.min("residual").alias("low"),
        F.max("residual").alias("high"),
        F.stddev_samp("residual").alias("std"),
        F.percentile("residual", F.array(F.lit(0.25), F.lit(0.75))).alias("quartiles"),
    )
    span = F.col("high") - F.col("low")
    sturges = span / (F.log2("n") + F.lit(1.0))
    spread = F.get("quartiles", F.lit(1)) - F.get("quartiles", F.lit(0))
    diaconis = F.lit(2.0) * spread / F.cbrt(F.col("n").cast("double"))
    width = F.when(diaconis > 0, F.least(diaconis, sturges)).otherwise(sturges)
    bins = F.greatest(F.coalesce(F.ceil(ratio(span, width)), F.lit(1)), F.lit(1)).cast("int")
    flat = span == 0
    sized = facts.withColumn("bins", bins).drop("quartiles")
    return sized.withColumns(
        {
            "low": F.when(flat, F.col("low") - 0.5).otherwise(F.col("low")),
            "high": F.when(flat, F.col("high") + 0.5).otherwise(F.col("high")),
        }
    ).withColumn("width", (F.col("high") - F.col("low")) / F.col("bins"))


def residual_histogram(resid: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Count per bin, empty bins included; the last bin holds its right edge."""
    resid, keys = with_keys(resid, keys)
    by = [*keys, "model"]
    bins = histogram_bins(resid, keys)
    placed = resid.join(bins, by).withColumn(
        "bin",
        clip(F.floor((F.col("residual") - F.col("low")) / F.col("width")), F.lit(0), F.col("bins") - 1).cast("int"),
    )
    counts = placed.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("count"))
    every = bins.withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)))
    left = F.col("low") + F.col("width") * F.col("bin")
    return every.join(counts, [*by, "bin"], "left").select(
        *by,
        "bin",
        left.alias("left_edge"),
        (left + F.col("width")).alias("right_edge"),
        F.coalesce("count", F.lit(0)).cast("bigint").alias("count"),
    )


def residual_density(resid: DataFrame, keys: Sequence[str] = (), grid: int = 200) -> DataFrame:
    """Gaussian kernel density (Scott's bandwidth) at ``grid`` points from least to greatest residual.

    ``scaled`` is the density times rows and bin width, which lays it over the histogram. Every task adds the kernels of
    its rows to ``grid`` sums per model, and only sums are shuffled; the grid's rows appear after them.
    """
    resid, keys = with_keys(resid, keys)
    by, facts = [*keys, "model"], ["n", "width", "low", "step", "bandwidth"]
    sized = histogram_bins(resid, keys).where((F.col("n") > 1) & (F.col("std") > 0))
    sized = sized.withColumns(
        {
            "bandwidth": F.col("std") * F.pow(F.col("n").cast("double"), F.lit(-0.2)),
            "step": (F.col("high") - F.col("low")) / F.lit(float(max(1, grid - 1))),
        }
    )
    met = resid.select(*by, "residual").join(sized.select(*by, *facts), by).withColumns(
        {"first": (F.col("low") - F.col("residual")) / F.col("bandwidth"), "stride": F.col("step") / F.col("bandwidth")}
    )
    z = [F.col("first") + F.col("stride") * F.lit(float(point)) for point in range(grid)]
    summed = met.groupBy(*by, *facts).agg(F.array(*[F.sum(F.exp(F.lit(-0.5) * at * at)) for at in z]).alias("sums"))
    mean = F.col("sum") / F.col("n") / (F.col("bandwidth") * F.lit(math.sqrt(2.0 * math.pi)))
    return summed.select(*by, *facts, F.posexplode("sums").alias("point", "sum")).select(
        *by,
        "point",
        (F.col("low") + F.col("step") * F.col("point")).alias("residual_at"),
        mean.alias("density"),
        (mean * F.col("n") * F.col("width")).alias("scaled"),
    )


def observed_and_fitted(folds: DataFrame, predictions: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Every week with its last-fold label (train, test, none) and each model's prediction."""
    predictions, keys = with_keys(predictions, keys)
    labelled = with_last_fold_role(predictions, folds, keys)
    return labelled.select(
        *keys, "date", "pos", "x", "y", F.coalesce("role", F.lit("none")).alias("split"), "model", "pred"
    )


def single_fit(observed: DataFrame, model: str, keys: Sequence[str] = ()) -> DataFrame:
    """One model of ``observed_and_fitted``, with its measures over all weeks on each row."""
    observed, keys = with_keys(observed, keys)
    chosen = observed.where(F.col("model") == model)
    measures = score(chosen, [*keys, "model"]).drop("n")
    return chosen.join(measures, [*keys, "model"])


def ensemble_comparison(observed_ensembles: DataFrame, observed_curves: DataFrame, best: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Last-fold split, the best curve and every ensemble, in the preferred plotting order."""
    observed_ensembles, keys = with_keys(observed_ensembles, keys)
    named = best.select(*keys, F.col("best_model").alias("model"))
    curve = observed_curves.join(named, [*keys, "model"]).withColumn("plot_order", F.lit(0))
    # fixed values: the order in which the ensembles are drawn
    preferred = F.array(*[F.lit(n) for n in (SIMPLE, BY_R2, BY_MSE, FOREST, BOOSTING)])
    place = F.array_position(preferred, F.col("model"))
    others = observed_ensembles.withColumn(
        "plot_order", F.when(place > 0, place).otherwise(F.lit(len(ENSEMBLES) + 1)).cast("int")
    )
    return curve.select(*others.columns).unionByName(others)


def validation(
    curve_preds: DataFrame, ensemble_preds: DataFrame, best_curve: DataFrame, best_ensemble: DataFrame, keys: Sequence[str] = ()
) -> DataFrame:
    """Actual values beside the best curve's and best ensemble's, with the six measures of the two over all weeks."""
    curve_preds, keys = with_keys(curve_preds, keys)
    series = Window.partitionBy(*keys)

    def chosen(predictions: DataFrame, best: DataFrame, role: str) -> DataFrame:
        named = best.select(*keys, F.col("best_model").alias("model"))
        return predictions.join(named, [*keys, "model"]).select(
            *keys, "date", "pos", "y", F.col("model").alias(f"{role}_model"), F.col("pred").alias(f"{role}_pred")
        )

    both = chosen(curve_preds, best_curve, "curve").join(
        chosen(ensemble_preds, best_ensemble, "ensemble"), [*keys, "date", "pos", "y"], "left"
    )
    measures = {}
    for role in ("curve", "ensemble"):
        error = F.col("y") - F.col(f"{role}_pred")
        squared = F.sum(error * error).over(series)
        measures[f"{role}_rmse"] = F.sqrt(F.avg(error * error).over(series))
        measures[f"{role}_mae"] = F.avg(F.abs(error)).over(series)
        measures[f"{role}_r2"] = F.lit(1.0) - ratio(squared, F.regr_syy("y", "y").over(series))
    return both.withColumns(measures)


def ensemble_diagnostics(folds: DataFrame, ensemble_preds: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Residuals of every ensemble on the last test block, or on all weeks for a series without one.

    Feed the result to ``normal_qq``, ``residual_histogram`` and ``residual_density``.
    """
    ensemble_preds, keys = with_keys(ensemble_preds, keys)
    chosen = with_last_fold_role(ensemble_preds, folds, keys).where((F.col("role") == "test") | F.col("no_folds"))
    return residuals(chosen.drop("role", "no_folds"))


def metric_panels(metrics: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Long form of the combined measures and the overall score, per model and type."""
    metrics, keys = with_keys(metrics, keys)
    scored = overall_score(metrics, keys).select(*keys, "model", "overall_score")
    joined = metrics.join(scored, [*keys, "model"], "left")
    return melt_metrics(joined, [*keys, "model", "type"], ["rmse", "r2", "mae", "overall_score"])


def top_importances(importances: DataFrame, ensemble: str, n: int = 15) -> DataFrame:
    """The features of one ensemble with the greatest importance; no rows if it is missing."""
    chosen = importances.where(F.col("model") == ensemble)
    return top_per_group(chosen, ["model"], "importance", n, ["feature"])


def weighted_comparison_panels(comparison: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The weighted-average comparison, one row per method and measure."""
    comparison, keys = with_keys(comparison, keys)
    return comparison.unpivot([*keys, "Weighting_Method"], ["RMSE", "R²", "MAE"], "Metric", "Score")


def monthly_mean(weekly: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    weekly, keys = with_keys(weekly, keys)
    return weekly.groupBy(*keys, "month").agg(F.avg("number").alias("mean_number"))


def yearly_distribution(weekly: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Quartiles per year, whiskers at the last value within 1.5 IQR of the box, and the number of outliers."""
    weekly, keys = with_keys(weekly, keys)
    dated = weekly.withColumn("year", F.year("date"))
    by = [*keys, "year"]
    box = dated.groupBy(*by).agg(F.percentile("number", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    q1, q2, q3 = (F.get("q", F.lit(i)) for i in range(3))
    fences = box.select(*by, q1.alias("q1"), q2.alias("median"), q3.alias("q3"))
    fences = fences.withColumn("reach", F.lit(1.5) * (F.col("q3") - F.col("q1")))
    inside = F.col("number").between(F.col("q1") - F.col("reach"), F.col("q3") + F.col("reach"))
    return (
        dated.join(fences, by)
        .groupBy(*by, "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, F.col("number"))).alias("low_whisker"),
            F.max(F.when(inside, F.col("number"))).alias("high_whisker"),
            F.count_if(~inside).alias("outliers"),
        )
    )


def counts_over_time(weekly: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    weekly, keys = with_keys(weekly, keys)
    return weekly.select(*keys, "date", "number", "cumulative")


def exploratory_panels(weekly: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The exploratory figures in one long table: panel, label, measure, value."""
    weekly, keys = with_keys(weekly, keys)
    long = ["panel", "label", "measure", "value"]

    def panel(df: DataFrame, name: str, label: str, values: list[str]) -> DataFrame:
        typed = df.select(*keys, F.lit(name).alias("panel"), F.col(label).cast("string").alias("label"), *[F.col(v).cast("double").alias(v) for v in values])
        return typed.unpivot([*keys, "panel", "label"], values, "measure", "value").select(*keys, *long)

    over_time = panel(counts_over_time(weekly, keys), "over_time", "date", ["number", "cumulative"])
    by_month = panel(monthly_mean(weekly, keys), "by_month", "month", ["mean_number"])
    boxes = ["q1", "median", "q3", "low_whisker", "high_whisker", "outliers"]
    by_year = panel(yearly_distribution(weekly, keys), "by_year", "year", boxes)
    return over_time.unionByName(by_month).unionByName(by_year)
