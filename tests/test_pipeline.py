from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from growthpanel.operators import chartdata, forecast
from growthpanel.operators.averaging import components
from growthpanel.operators.fitting import FitOptions
from growthpanel.operators.trees import TreeOptions, inner_fold
from growthpanel.plans.prediction import predict
from growthpanel.plans.training import TrainingOptions, train
from growthpanel.sources.records import select_records
from growthpanel.sources import storage
from growthpanel.sources.runstore import ensure_checkpoint_dir
from growthpanel.sources.storage import load_ensemble, slug

TREES = TreeOptions(
    trees=3, forest_depth=3, boosting_depth=2, bins=32,
    forest_grid={"trees": [3], "depth": [3]}, boosting_grid={"trees": [2], "depth": [2]},
)


@pytest.fixture(scope="module")
def records(spark):
    lineitem = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    return select_records(lineitem, ["l_returnflag"], "l_shipdate", "l_quantity", None)


@pytest.fixture(scope="module")
def trained(records):
    options = TrainingOptions(n_splits=2, fit=FitOptions(starts=2), trees=TREES, draws=50, horizon_weeks=20)
    return train(records, ["l_returnflag"], options)


def test_training_run_yields_all_tables(trained):
    series = trained.target.select("l_returnflag").distinct().count()
    assert trained.metrics.count() == series * 9
    assert trained.best_curve.count() == trained.best_ensemble.count() == series
    rows = trained.forecast.collect()
    assert len(rows) == series * 20
    assert all(r["lower_bound_ci"] <= r["upper_bound_ci"] and r["best_ensemble_forecast"] is not None for r in rows)
    weights = trained.weights.groupBy("l_returnflag").agg(F.sum("r2_weight").alias("a"), F.sum("inv_mse_weight").alias("b"))
    for row in weights.collect():
        assert row["a"] == pytest.approx(1.0) and row["b"] == pytest.approx(1.0)


def test_save_load_predict(spark, trained, records, tmp_path):
    folder = str(tmp_path / "run")
    trained.save(folder)
    loaded = load_ensemble(spark, f"{folder}/models")
    assert loaded.name == "Random Forest" and loaded.keys == ["l_returnflag"]
    predicted = predict(records, folder, ["l_returnflag"], output=str(tmp_path / "predicted.parquet"))
    assert spark.read.parquet(str(tmp_path / "predicted.parquet")).count() == trained.weekly.count()
    ours = trained.ensemble_predictions.where("model = 'Random Forest'")
    joined = predicted.join(ours, ["l_returnflag", "pos"])
    assert joined.agg(F.max(F.abs(F.col("pred") - F.col("predicted_cumulative")))).first()[0] < 1e-6
    report = spark.read.option("header", True).csv(f"{folder}/reports/overall-evaluation-metrics")
    assert report.columns == ["l_returnflag", "Model", "Type", "RMSE", "R²", "MAE"]
    assert slug("Weighted Average (R2)") == "weighted-average-r2"


def test_saved_pipeline_predicts_alone(spark, trained, tmp_path):
    path = str(tmp_path / "pipeline")
    model = trained.tree_ensembles["Gradient Boosting"]
    model.pipeline.write().overwrite().save(path)
    alone = PipelineModel.load(path).transform(trained.weekly)
    assert set(alone.columns) >= {*trained.weekly.columns, "predicted_cumulative", "tree_status"}
    ours = trained.ensemble_predictions.where("model = 'Gradient Boosting'")
    apart = alone.join(ours.select("l_returnflag", "pos", "pred"), ["l_returnflag", "pos"])
    assert apart.count() == trained.target.count()
    assert apart.agg(F.max(F.abs(F.col("pred") - F.col("predicted_cumulative")))).first()[0] < 1e-6
    unknown = PipelineModel.load(path).transform(trained.weekly.limit(3).withColumn("l_returnflag", F.lit("?")))
    assert {(r["predicted_cumulative"], r["tree_status"]) for r in unknown.collect()} == {(None, "missing_curve")}


def test_a_save_that_breaks_off_leaves_the_old_version(spark, trained, tmp_path, monkeypatch):
    folder = str(tmp_path / "models")
    models, write = list(trained.tree_ensembles.values()), storage.write_table
    storage.save_models(models[:1], trained.params, trained.best_curve, folder)
    first = storage.current_version(spark, folder)

    def breaks(df, path, *more, **options):
        if path.endswith("best_curve"):
            raise OSError("no room")
        write(df, path, *more, **options)

    monkeypatch.setattr(storage, "write_table", breaks)
    with pytest.raises(OSError, match="no room"):
        storage.save_models(models, trained.params.limit(1), trained.best_curve, folder)
    assert storage.current_version(spark, folder) == first
    assert storage.load_curves(spark, folder)[0].count() == trained.params.count()
    (tmp_path / "models" / "manifests" / "00000009.json").write_text('{"versi')  # a manifest cut short
    assert storage.load_ensemble(spark, folder).name == models[0].name
    monkeypatch.undo()
    storage.save_models(models[1:], trained.params, trained.best_curve, folder)
    assert storage.load_ensemble(spark, folder).name == models[1].name
    assert storage.drop_old_versions(spark, folder) == 2 and not Path(first).exists()
    assert storage.load_ensemble(spark, folder).name == models[1].name


def test_a_closed_run_leaves_no_files(spark, records):
    root = Path(ensure_checkpoint_dir(spark).removeprefix("file:"))
    before = {f for f in root.rglob("*") if f.is_file()}
    options = TrainingOptions(n_splits=2, fit=FitOptions(starts=1, grid_points=3, grid_rounds=1), trees=TREES, draws=5, horizon_weeks=2)
    with train(records.where("l_returnflag = 'R'"), ["l_returnflag"], options) as run:
        assert run.forecast.count() == 2
        kept = {f.relative_to(root) for f in root.rglob("*") if f.is_file()} - {f.relative_to(root) for f in before}
        assert {f.parts[0] for f in kept} == {"growthpanel-runs"} and not any("fitting" in str(f) or "tree_folds" in str(f) for f in kept)
    assert {f for f in root.rglob("*") if f.is_file()} == before
    with pytest.raises(ValueError):
        train(records.withColumn("number", F.lit(None).cast("double")).where("l_returnflag = 'none'"), ["l_returnflag"], TrainingOptions(component_fit="?"))
    assert {f for f in root.rglob("*") if f.is_file()} == before


def test_nothing_to_load(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="no saved tree model"):
        load_ensemble(spark, str(tmp_path))


def test_chart_tables(trained):
    charts = trained.charts()
    n = trained.target.count()
    assert charts["curves"].count() == 4 * n and charts["validation"].count() == n
    counted = charts["residual_histogram"].groupBy("l_returnflag", "model").agg(F.sum("count").alias("c")).agg(F.sum("c")).first()[0]
    assert counted == 4 * n
    assert {"top_importances_Random Forest", "weighted_panels", "ensemble_normal_qq", "ensemble_residual_histogram"} <= set(charts)
    assert charts["top_importances_Random Forest"].count() == 7 and charts["weighted_panels"].count() == 3 * 2 * 3
    assert charts["ensemble_normal_qq"].select("model").distinct().count() == 5
    assert {r["status"] for r in trained.status.collect()} == {"ok"}
    assert charts["residual_density"].groupBy("l_returnflag", "model").count().where("count <> 200").isEmpty()


def test_interval_is_repeatable_and_equals_numpy(spark):
    best = spark.createDataFrame([("s", "Logistic", [100.0, 0.1, 10.0, 1.0])], "sid string, model string, params array<double>")
    future = spark.range(5).selectExpr("'s' as sid", "cast(id as int) as pos", "cast(id as double) as x")
    one = forecast.param_noise_interval(future, best, ["sid"], draws=101)
    two = forecast.param_noise_interval(future.repartition(3), best.repartition(5), ["sid"], draws=101)
    a, b = ({r["pos"]: (r["lower_bound_ci"], r["upper_bound_ci"]) for r in df.collect()} for df in (one, two))
    assert a == b
    drawn = np.array([r["params"][:4] for r in forecast.noisy_params(best, ["sid"], 101).collect()])
    for x in range(5):
        value = drawn[:, 0] / (1 + np.exp(-drawn[:, 1] * (x - drawn[:, 2]))) + drawn[:, 3]
        assert a[x] == pytest.approx(tuple(np.percentile(value, [2.5, 97.5])), rel=1e-9)


def test_inner_folds_are_contiguous_blocks(spark):
    rows = spark.range(11).selectExpr("'a' as sid", "cast(id as int) as pos")
    found = [r["inner_fold"] for r in inner_fold(rows, ["sid"], 3).orderBy("pos").collect()]
    assert found == [0] * 4 + [1] * 4 + [2] * 3


def test_component_choices(spark):
    rows = [("s", "Logistic", f, [float(f)]) for f in (-1, 0, 1)] + [("s", "Gompertz", 1, None)]
    params = spark.createDataFrame(rows, "sid string, model string, fold int, params array<double>")
    for choice, fold in (("full", -1), ("first_fold", 0), ("last_fold", 1)):
        assert [(r["model"], r["fold"]) for r in components(params, ["sid"], choice).collect()] == [("Logistic", fold)]
    with pytest.raises(ValueError):
        components(params, ["sid"], "any")


def test_top_importances_of_a_missing_model(spark):
    long = spark.createDataFrame([("Random Forest", "a", 0.7), ("Random Forest", "b", 0.3)], "model string, feature string, importance double")
    assert [r["feature"] for r in chartdata.top_importances(long, "Random Forest", 1).collect()] == ["a"]
    assert chartdata.top_importances(long, "Gradient Boosting").isEmpty()


def test_reports_are_clustered_by_series(spark, tmp_path):
    rows = spark.range(0, 4000, 1, 7).selectExpr("id * 7919 % 40 as sid", "id as pos", "concat('m', id % 4) as model")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        paths = storage.write_reports({"Own rows": rows, "models": rows.select("model").distinct()}, str(tmp_path), "parquet", ["sid"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [Path(p).name for p in paths] == ["own-rows", "models"]
    ranges = []
    for file in Path(paths[0]).glob("*.parquet"):
        meta = pq.ParquetFile(file).metadata
        found = [meta.row_group(g).column(0).statistics for g in range(meta.num_row_groups)]
        ranges.append((min(f.min for f in found), max(f.max for f in found)))
        sids = pq.read_table(file).column("sid").to_pylist()
        assert sids == sorted(sids)
    ranges.sort()
    assert len(ranges) > 3 and all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))  # one series, one file
    assert spark.read.parquet(paths[0]).exceptAll(rows).isEmpty() and spark.read.parquet(paths[0]).count() == 4000
    assert spark.read.parquet(paths[1]).count() == 4
    storage.write_reports({"none": rows.where("false")}, str(tmp_path), "csv", ["sid"])
    assert not list((tmp_path / "none").glob("*.csv")) or spark.read.option("header", True).csv(str(tmp_path / "none")).isEmpty()


def test_density_adds_sums_before_rows_of_the_grid(spark):
    rng = np.random.default_rng(1)
    values = {"a": rng.normal(size=50), "b": rng.exponential(size=7), "flat": np.full(4, 2.0), "one": np.array([1.0])}
    rows = [("s", m, float(v)) for m, vs in values.items() for v in vs]
    resid = spark.createDataFrame(rows, "sid string, model string, residual double").repartition(3)
    found = chartdata.residual_density(resid, ["sid"], grid=9)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1 and plan.index("Generate") < plan.index("Aggregate")
    got = {(r["model"], r["point"]): (r["residual_at"], r["density"]) for r in found.collect()}
    assert {m for m, _ in got} == {"a", "b"} and len(got) == 18
    for model in ("a", "b"):
        v = values[model]
        h, grid = v.std(ddof=1) * len(v) ** -0.2, np.linspace(v.min(), v.max(), 9)
        for point, at in enumerate(grid):
            density = np.exp(-0.5 * ((at - v) / h) ** 2).mean() / (h * np.sqrt(2 * np.pi))
            assert got[model, point] == pytest.approx((at, density), rel=1e-9)


def test_roles_come_from_positions(spark):
    folds = spark.createDataFrame([("s", 0, 10, 2, 3, 4, 7), ("s", 1, 10, 2, 6, 7, 10)], "sid string, fold int, n int, k int, train_end int, test_start int, test_end int")
    rows = [(s, "m", None, p, float(p), 1.0, 0.5 * p) for s in ("s", "short") for p in range(10)]
    preds = spark.createDataFrame(rows, "sid string, model string, date date, pos int, x double, y double, pred double")
    split = {(r["sid"], r["pos"]): r["split"] for r in chartdata.observed_and_fitted(folds, preds, ["sid"]).collect()}
    assert [split["s", p] for p in range(10)] == ["train"] * 6 + ["none"] + ["test"] * 3
    assert {split["short", p] for p in range(10)} == {"train"}
    own = chartdata.ensemble_diagnostics(folds, preds, ["sid"])
    assert {(r["sid"], r["pos"]) for r in own.collect()} == {("s", 7), ("s", 8), ("s", 9)} | {("short", p) for p in range(10)}
    assert not {"role", "no_folds"} & set(own.columns)
