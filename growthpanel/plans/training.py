"""The whole training run: records to fits, ensembles, choices, forecast and reports."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from growthpanel.functions.columns import with_keys
from growthpanel.operators import averaging, chartdata, forecast, reports, selection, trees
from growthpanel.operators.fitting import FitOptions, fit_curves, hold_points
from growthpanel.operators.folds import FULL, fold_plan, make_folds, prepare_target, validate_panel
from growthpanel.operators.predictions import curve_metrics, curve_predictions, full_fit
from growthpanel.operators.trees import TreeEnsemble, TreeOptions
from growthpanel.operators.weekly import weekly_panel
from growthpanel.sources.runstore import RunStore
from growthpanel.sources.storage import save_models, write_reports


@dataclass(frozen=True)
class TrainingOptions:
    """``trees=None`` leaves the tree models out."""

    n_splits: int = 5
    gap: int = 4
    scale: int | None = None
    fit: FitOptions = FitOptions()
    trees: TreeOptions | None = TreeOptions()
    component_fit: str = "last_fold"
    tree_component_fit: str = "first_fold"
    horizon_weeks: int = forecast.HORIZON_WEEKS
    draws: int = 1000
    confidence: float = 0.95
    seed: int = 42


@dataclass(frozen=True)
class Trained:
    """Everything a run yields, as DataFrames; nothing lives in module globals.

    The tables lie in ``store`` until ``close``, or the end of a ``with`` block; save or read what is needed before that.
    """

    keys: list[str]
    weekly: DataFrame
    target: DataFrame
    folds: DataFrame
    params: DataFrame
    curve_metrics: DataFrame
    weights: DataFrame
    metrics: DataFrame
    best_curve: DataFrame
    best_ensemble: DataFrame
    curve_predictions: DataFrame
    ensemble_predictions: DataFrame
    forecast: DataFrame
    status: DataFrame
    store: RunStore
    tree_ensembles: dict[str, TreeEnsemble] = field(default_factory=dict)

    def reports(self) -> dict[str, DataFrame]:
        """The report tables by name."""
        keys = self.keys
        full = reports.full_predictions(self.curve_predictions, self.ensemble_predictions, keys)
        ensemble_metrics = self.metrics.where(F.col("type") == "Ensemble")
        tables = {
            "standalone_model_coefficients": reports.coefficient_table(self.params, keys),
            "standalone_model_metrics": reports.standalone_metrics(self.curve_metrics, keys),
            "full_predictions_table": full,
            "predictions_summary_table": reports.predictions_summary(full, keys),
            "weighted_average_comparison": reports.weighted_comparison(ensemble_metrics, keys),
            "weighted_parameters_table": reports.weighted_parameters(self.params, self.weights, keys),
            "overall_evaluation_metrics": reports.overall_metrics(self.metrics, keys),
            "forecast_results_next_5_years": self.forecast,
            "series_status": self.status,
        }
        for name in [*self.tree_ensembles, *averaging.AVERAGES]:
            tables[f"ensemble_input_table_{name}"] = reports.ensemble_input_table(
                self.curve_predictions, self.ensemble_predictions, name, keys
            )
        if self.tree_ensembles:
            long = trees.importances(self.target.sparkSession, self.tree_ensembles)
            tables["feature_importances_RF_GB"] = trees.importance_table(long)
        return tables

    def charts(self) -> dict[str, DataFrame]:
        """The tables behind the figures by name."""
        keys = self.keys
        curves = chartdata.observed_and_fitted(self.folds, self.curve_predictions, keys)
        ensembles = chartdata.observed_and_fitted(self.folds, self.ensemble_predictions, keys)
        resid = chartdata.residuals(self.curve_predictions)
        own = chartdata.residuals(self.ensemble_predictions.where("pred IS NOT NULL"))
        averages = self.metrics.where(F.col("type") == "Ensemble")
        tables = {
            "exploratory": chartdata.exploratory_panels(self.weekly, keys),
            "curves": curves,
            "ensemble_comparison": chartdata.ensemble_comparison(ensembles, curves, self.best_curve, keys),
            "validation": chartdata.validation(
                self.curve_predictions, self.ensemble_predictions, self.best_curve, self.best_ensemble, keys
            ),
            "residuals": resid,
            "normal_qq": chartdata.normal_qq(resid, keys),
            "residual_histogram": chartdata.residual_histogram(resid, keys),
            "residual_density": chartdata.residual_density(resid, keys),
            "ensemble_diagnostics": chartdata.ensemble_diagnostics(self.folds, self.ensemble_predictions, keys),
            "metric_panels": chartdata.metric_panels(self.metrics, keys),
            "weighted_panels": chartdata.weighted_comparison_panels(reports.weighted_comparison(averages, keys), keys),
            "ensemble_residuals": own,
            "ensemble_normal_qq": chartdata.normal_qq(own, keys),
            "ensemble_residual_histogram": chartdata.residual_histogram(own, keys),
            "ensemble_residual_density": chartdata.residual_density(own, keys),
        }
        long = trees.importances(self.target.sparkSession, self.tree_ensembles) if self.tree_ensembles else None
        for name in self.tree_ensembles:
            tables[f"top_importances_{name}"] = chartdata.top_importances(long, name)
        return tables

    def save(self, folder: str, format: str = "csv") -> None:
        """Reports, then curves and tree models as a new version, for later reading and for ``predict``."""
        write_reports(self.reports(), f"{folder}/reports", format, self.keys)
        save_models(self.tree_ensembles.values(), self.params, self.best_curve, f"{folder}/models")

    def close(self) -> None:
        """Delete the tables that the run wrote to the shared folder."""
        self.store.close()

    def __enter__(self) -> Trained:
        return self

    def __exit__(self, *error: object) -> None:
        self.close()


def series_status(target: DataFrame, params: DataFrame, keys: Sequence[str] = (), n_splits: int = 5, gap: int = 4) -> DataFrame:
    """One row per series: weeks, folds, fitted curves and what keeps it from being treated in full.

    ``status`` is that of the folds (``too_few_rows``, ``invalid_target``), else ``missing_curve`` if one of the curves has no
    fit to the whole series or to a fold, which leaves the series out of the tree models, else ``ok``.
    """
    target, keys = with_keys(target, keys)
    plan = fold_plan(target, keys, n_splits, gap)
    whole = F.col("params").isNotNull() & (F.col("fold") == FULL)
    fits = params.groupBy(*keys).agg(
        F.count_if(whole).cast("int").alias("curves"), F.count_if(F.col("params").isNull()).cast("int").alias("missing_fits")
    )
    rows = plan.join(fits, keys, "left").na.fill(0, subset=["curves", "missing_fits"])
    missing = (F.col("missing_fits") > 0) | (F.col("curves") == 0)
    status = F.when(F.col("status") != "ok", F.col("status")).when(missing, F.lit("missing_curve")).otherwise(F.lit("ok"))
    return rows.select(*keys, "n", "k", "curves", "missing_fits", status.alias("status"))


def train(records: DataFrame, keys: Sequence[str] = (), options: TrainingOptions = TrainingOptions()) -> Trained:
    """Run every step on records from ``select_records``.

    Tables that later steps share are kept in a store of the run: at most a few rows per series, week and model, written
    once, so that plans on top stay small and a lost executor does not bring the raw rows back. Tables that only lead to
    them go when they are written. ``Trained.close`` deletes the rest, as does a run that fails.
    """
    records, keys = with_keys(records, keys)
    store = RunStore(records.sparkSession)
    try:
        return _train(records, keys, options, store)
    except BaseException:
        store.close()
        raise


def _train(records: DataFrame, keys: list[str], options: TrainingOptions, store: RunStore) -> Trained:
    weekly = store.keep(weekly_panel(records, keys, options.scale), "weekly")
    validate_panel(weekly)
    target = store.keep(prepare_target(weekly, keys), "target")
    folds = store.keep(make_folds(target, keys, options.n_splits, options.gap), "folds")
    valid = target.where(F.col("status") == "ok")

    with store.scratch("fitting") as scratch:
        points = hold_points(target, keys, scratch)
        try:
            params = store.keep(fit_curves(points, folds, options=options.fit).params, "params")
        finally:
            points.df.unpersist()
    by_curve = store.keep(curve_metrics(valid, folds, params, keys), "curve_metrics")
    curve_preds = curve_predictions(valid, full_fit(params), keys)

    parts = store.keep(averaging.components(params, keys, options.component_fit), "components")
    weights = store.keep(averaging.component_weights(valid, folds, parts, keys), "weights")
    ensemble_preds = averaging.average_predictions(valid.drop("status"), parts, weights, keys)
    ensemble_metrics = averaging.average_metrics(ensemble_preds, keys)

    grown: dict[str, TreeEnsemble] = {}
    if options.trees is not None:
        with store.scratch("tree_folds") as scratch:
            by_tree = store.keep(trees.tree_cv_metrics(valid, folds, params, keys, options.trees, scratch), "tree_metrics")
        ensemble_metrics = averaging.combine(by_tree.withColumn("scope", F.lit("test_folds")), ensemble_metrics)
        grown = trees.train_trees(valid, params, keys, options.trees, options.tree_component_fit, store)
        tree_preds = [trees.tree_predictions(valid.drop("status"), e).drop("tree_status") for e in grown.values()]
        ensemble_preds = averaging.combine(ensemble_preds, *tree_preds)

    metrics = store.keep(selection.combined_metrics(by_curve, ensemble_metrics, keys), "metrics")
    best_curve = store.keep(selection.best_model(metrics.where(F.col("type") == "Individual"), keys), "best_curve")
    best_ensemble = store.keep(selection.best_model(metrics.where(F.col("type") == "Ensemble"), keys), "best_ensemble")

    ensemble_preds = store.keep(ensemble_preds, "ensemble_predictions")
    future = forecast.horizon(valid, keys, options.horizon_weeks)
    chosen = forecast.best_curve_params(full_fit(params), best_curve, keys)
    ahead = averaging.average_predictions(future, parts, weights, keys)
    if grown:
        ahead = averaging.combine(ahead, *[trees.tree_predictions(future, e).drop("tree_status") for e in grown.values()])
    ahead = ahead.join(best_ensemble.select(*keys, F.col("best_model").alias("model")), [*keys, "model"])
    interval = forecast.param_noise_interval(
        future, chosen, keys, options.draws, options.confidence, seed=options.seed
    )
    table = forecast.forecast_table(future, chosen, ahead, interval, keys)
    status = store.keep(series_status(target, params, keys, options.n_splits, options.gap), "status")
    return Trained(
        keys, weekly, target, folds, params, by_curve, weights, metrics, best_curve, best_ensemble,
        curve_preds, ensemble_preds, table, status, store, grown,
    )
