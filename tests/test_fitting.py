import numpy as np
import pytest
from pyspark.sql import functions as F

from growthpanel.functions import curves as C
from growthpanel.operators.fitting import FitOptions, fit_curves, hold_points
from growthpanel.operators.folds import FULL, make_folds
from growthpanel.operators.predictions import curve_metrics

TRUE = {
    "Exponential": [10000.0, 0.0028, -5800.0],
    "Logistic": [200000.0, 0.012, 150.0, -30000.0],
    "Richards": [200000.0, 0.02, 150.0, 2.0, -20000.0],
    "Gompertz": [200000.0, 0.01, 120.0, 1000.0],
}
WEEKS = 260


def _target(spark, frames):
    """frames: series -> (x, y)."""
    rows = [(s, i, float(a), float(b)) for s, (x, y) in frames.items() for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "sid string, pos int, x double, y double")
    return df.selectExpr("sid", "date_add(DATE'2020-01-05', 7 * pos) as date", "pos", "x", "y", "'ok' as status")


@pytest.fixture(scope="module")
def exact(spark):
    """One series per curve, drawn from it without noise."""
    rows = [(name, params) for name, params in TRUE.items()]
    params = spark.createDataFrame(rows, "sid string, params array<double>")
    weeks = params.withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(WEEKS - 1)))).withColumn("x", F.col("pos").cast("double"))
    y = C.evaluate_by_name(F.col("sid"), F.col("x"), F.col("params"))
    return weeks.select("sid", F.expr("date_add(DATE'2020-01-05', 7 * pos)").alias("date"), "pos", "x", y.alias("y"), F.lit("ok").alias("status")).persist()


@pytest.fixture(scope="module")
def fits(exact):
    return fit_curves(exact, make_folds(exact, ["sid"]), ["sid"]).params.persist()


def test_every_curve_recovers_its_own_parameters(exact, fits):
    own = fits.where((F.col("fold") == FULL) & (F.col("model") == F.col("sid"))).collect()
    assert len(own) == 4
    for row in own:
        assert row["status"] == "ok"
        assert row["sse"] / WEEKS < (1e-5 * 200000) ** 2
        for value, true in zip(row["params"], TRUE[row["sid"]]):
            assert value == pytest.approx(true, rel=2e-3)


def test_parameters_stay_in_bounds(exact, fits):
    top = {r["sid"]: r["top"] for r in exact.groupBy("sid").agg(F.max("y").alias("top")).collect()}
    for row in fits.where("params IS NOT NULL").collect():
        height, rate = row["params"][0], row["params"][1]
        low = 0.0 if row["model"] == "Exponential" else top[row["sid"]]
        assert low * (1 - 1e-12) <= height <= 2 * top[row["sid"]] * (1 + 1e-12)
        assert C.CURVES[row["model"]].rate_bounds[0] <= rate <= C.CURVES[row["model"]].rate_bounds[1]


def test_all_folds_are_there_and_metrics_follow(exact, fits):
    folds = make_folds(exact, ["sid"])
    assert fits.count() == 4 * 4 * 6
    measured = curve_metrics(exact, folds, fits, ["sid"]).where("model = sid AND model <> 'Richards'").collect()
    assert all(r["folds"] == 5 and r["train_r2"] > 0.999 for r in measured)


def test_short_and_very_long_series_get_the_fits_they_get_alone(spark):
    rng = np.random.default_rng(11)
    frames = {}
    for name, weeks in (("short", 300), ("long", 6000)):
        x = np.arange(float(weeks))
        y = 9e4 / (1 + np.exp(-0.02 * (x - weeks / 3))) + 100 * np.sqrt(x)
        frames[name] = (x, np.maximum.accumulate(y + rng.normal(0, 200, weeks)))
    both = _target(spark, frames)
    options = FitOptions(starts=2)
    panel = fit_curves(both, make_folds(both, ["sid"], n_splits=2), ["sid"], options).params
    found = {(r["sid"], r["model"], r["fold"]): r for r in panel.collect()}
    assert len(found) == 2 * 4 * 3
    for name in frames:
        one = both.where(F.col("sid") == name)
        for row in fit_curves(one, make_folds(one, ["sid"], n_splits=2), ["sid"], options).params.collect():
            other = found[name, row["model"], row["fold"]]
            assert row["status"] == other["status"] and row["params"] == pytest.approx(other["params"], rel=1e-9)
            assert row["sse"] is None or row["sse"] == pytest.approx(other["sse"], rel=1e-9)


def test_the_error_is_that_of_the_residuals(spark, exact):
    one = exact.where("sid = 'Gompertz'")
    pandas = one.orderBy("pos").toPandas()
    fits = fit_curves(one, None, ["sid"], FitOptions(models=("Logistic", "Gompertz")))
    params = fits.params
    pred = one.drop("status").crossJoin(params.select("model", "params", "sse"))
    value = C.evaluate_by_name(F.col("model"), F.col("x"), F.col("params"))
    sums = pred.groupBy("model", "sse").agg(F.sum((F.col("y") - value) * (F.col("y") - value)).alias("direct")).collect()
    assert len(pandas) == WEEKS
    for row in sums:
        assert row["sse"] == pytest.approx(row["direct"], rel=1e-6, abs=1e-9)


def test_a_fit_at_the_limit_of_passes_has_not_converged(spark, exact):
    one = exact.where("sid = 'Richards'")
    folds = make_folds(one, ["sid"])
    found = fit_curves(one, folds, ["sid"], FitOptions(models=("Richards",), starts=1, max_passes=2))
    status = {r["fold"]: (r["status"], r["params"]) for r in found.params.collect()}
    assert status[FULL] == ("not_converged", None)
    assert all(status[k][0] == "start_values" and status[k][1] for k in range(5))
    first = found.initial.first()
    assert first["status"] == "not_converged" and first["initial_params"] == first["start_params"]


def test_a_series_gets_the_same_fit_alone_and_in_a_panel(spark, exact, fits):
    alone = exact.where("sid = 'Gompertz'")
    found = fit_curves(alone, make_folds(alone, ["sid"]), ["sid"]).params
    panel = {(r["model"], r["fold"]): r["params"] for r in fits.where("sid = 'Gompertz'").collect()}
    for row in found.collect():
        assert row["params"] == pytest.approx(panel[row["model"], row["fold"]], rel=1e-9)


def test_least_squares_against_brute_force(spark):
    rng = np.random.default_rng(5)
    x = np.arange(120.0)
    y = np.maximum.accumulate(np.cumsum(rng.uniform(0, 30, 120)))
    target = _target(spark, {"r": (x, y)})
    found = fit_curves(target, None, ["sid"], FitOptions(models=("Exponential", "Gompertz"))).params.collect()
    sse = {r["model"]: r["sse"] for r in found}

    def least(shapes, absolute):
        best = np.inf
        for u in shapes:
            for height in np.linspace(0 if not absolute else y.max(), 2 * y.max(), 60):
                basis = 1 - u if absolute else np.ones_like(u)
                rest = y - height * u
                offset = (rest @ basis) / (basis @ basis)
                best = min(best, ((rest - offset * basis) ** 2).sum())
        return best

    rates = np.geomspace(1e-4, 0.1, 60)
    assert sse["Exponential"] <= least([np.exp(b * x) for b in rates], False) * (1 + 1e-9)
    shapes = [np.exp(-np.exp(-k * (x - t))) for k in np.geomspace(1e-3, 0.1, 30) for t in np.linspace(0, 119, 30)]
    assert sse["Gompertz"] <= least(shapes, True) * (1 + 1e-9)


def test_odd_series_end_in_a_status_not_an_exception(spark):
    x = np.arange(60.0)
    target = _target(
        spark,
        {"flat": (x, np.full(60, 7.0)), "negative": (x, -50 + x / 2), "one": ([0.0], [3.0]), "short": (x[:14], x[:14] ** 2)},
    ).union(_target(spark, {"bad": (x, x)}).withColumn("status", F.lit("invalid_target")))
    folds = make_folds(target, ["sid"])
    params = fit_curves(target, folds, ["sid"], FitOptions(starts=2)).params.collect()
    status = {(r["sid"], r["model"], r["fold"]): r["status"] for r in params}
    assert "bad" not in {k for k, _, _ in status}
    assert status["short", "Richards", 0] == "skipped"
    assert all(status[k, m, FULL] == "ok" for k in ("flat", "negative", "short") for m in C.CURVE_NAMES)
    flat = next(r for r in params if (r["sid"], r["model"], r["fold"]) == ("flat", "Logistic", FULL))
    assert flat["sse"] < 1.0


def test_no_folds_gives_train_measures_only(spark, exact):
    one = exact.where("sid = 'Logistic'")
    fits = fit_curves(one, None, ["sid"], FitOptions(models=("Logistic",))).params
    row = curve_metrics(one, make_folds(one, ["sid"]).limit(0), fits, ["sid"]).first()
    assert row["test_r2"] is None and row["train_r2"] > 0.999 and row["folds"] == 0


def test_start_values_of_a_series_without_positive_values(spark):
    target = _target(spark, {"n": (np.arange(30.0), np.full(30, -2.0))})
    points = hold_points(target, ["sid"])
    from growthpanel.operators.fitting import start_values

    rows = {r["model"]: r for r in start_values(points.df, ["sid"]).collect()}
    assert rows["Exponential"]["start_params"][0] == 1.0
    assert rows["Logistic"]["start_params"] == [1.2, 0.01, 14.5, -2.0]
    assert rows["Logistic"]["upper"][0] == 2.0
