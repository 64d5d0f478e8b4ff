"""A fifth curve, registered here, is fitted, scored, averaged, forecast and reported; grids seed fits that fail."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from growthpanel.functions import curves as C
from growthpanel.functions import shapes, step
from growthpanel.operators import averaging, forecast, reports, selection
from growthpanel.operators.fitting import FitOptions, fit_curves, grid_seeds, hold_points
from growthpanel.operators.folds import FULL, make_folds
from growthpanel.operators.predictions import curve_metrics, curve_predictions, full_fit

WEEKS = 260


MONOMOLECULAR = C.Curve("Monomolecular", ("top", "speed", "base"), ("height", "rate", "offset"), shapes.monomolecular, shapes.monomolecular_slopes, 0.01, (0.0001, 0.1), height_bounds=(0.0, 2.0))


@pytest.fixture(scope="module")
def target(spark):
    x = [float(i) for i in range(WEEKS)]
    rows = [("m", i, v, float(900 * (1 - np.exp(-0.013 * v)) + 40)) for i, v in enumerate(x)]
    rows += [("g", i, v, float(5 + 995 * np.exp(-np.exp(-0.03 * (v - 90))))) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "sid string, pos int, x double, y double")
    return df.selectExpr("sid", "date_add(DATE'2020-01-05', 7 * pos) as date", "pos", "x", "y", "'ok' as status").persist()


def test_a_fifth_curve_goes_all_the_way(target):
    keys = ["sid"]
    with C.registered(MONOMOLECULAR):
        assert C.CURVE_NAMES[-1] == "Monomolecular" and MONOMOLECULAR.order == 4
        folds = make_folds(target, keys)
        params = fit_curves(target, folds, keys).params.persist()
        own = params.where("sid = 'm' AND model = 'Monomolecular'").collect()
        assert len(own) == 6 and all(r.status == "ok" for r in own)
        assert next(r.params for r in own if r.fold == FULL) == pytest.approx([900, 0.013, 40], rel=1e-4)
        scored = curve_metrics(target, folds, params, keys)
        assert scored.where("sid = 'm' AND model = 'Monomolecular'").first()["test_r2"] > 0.9999
        parts = averaging.components(params, keys)
        weights = averaging.component_weights(target, folds, parts, keys).where("sid = 'm'").collect()
        assert len(weights) == 5 and sum(w["r2_weight"] for w in weights) == pytest.approx(1)
        named = scored.select("sid", "model", F.col("test_r2").alias("r2"))
        best = selection.best_model(named, keys)
        assert {r.sid: r.best_model for r in best.collect()}["m"] == "Monomolecular"
        ahead = curve_predictions(forecast.horizon(target, keys), full_fit(params), keys).where("sid = 'm' AND model = 'Monomolecular'")
        assert ahead.agg(F.max("pred")).first()[0] == pytest.approx(900 * (1 - np.exp(-0.013 * (WEEKS - 1 + 260))) + 40, rel=1e-3)
        named_rows = reports.coefficient_table(full_fit(params), keys).where("sid = 'm' AND Model = 'Monomolecular'").collect()
        assert [r.Parameter for r in sorted(named_rows, key=lambda r: r.Parameter)] == ["base", "speed", "top"]
    assert "Monomolecular" not in C.CURVES


def test_curves_that_cannot_be_registered():
    with pytest.raises(ValueError):
        C.register(C.CURVES["Logistic"])
    for roles in (("height", "rate"), ("height", "rate", "rate"), ("height", "rate", "speed")):
        with pytest.raises(ValueError):
            C.Curve("x", ("a", "b", "c")[: len(roles)], roles, shapes.logistic, shapes.logistic_slopes, 0.01, (0.1, 0.2))


@pytest.mark.parametrize("name", ["Exponential", "Logistic", "Richards", "Gompertz"])
def test_slopes_are_derivatives(name):
    curve, x, at, h = C.CURVES[name], np.linspace(0, 300, 31), np.array([0.02, 120.0, 1.7]), 1e-6
    slopes = curve.slopes(shapes.Arrays, x, *at)
    for i in range(3):
        up, down = at.copy(), at.copy()
        up[i] *= 1 + h
        down[i] *= 1 - h
        wanted = (curve.shape(shapes.Arrays, x, *up) - curve.shape(shapes.Arrays, x, *down)) / (2 * h * at[i])
        if not (i == 1 and not curve.fits_midpoint) and not (i == 2 and not curve.fits_asymmetry):
            assert np.allclose(np.broadcast_to(slopes[i], x.shape), wanted, rtol=1e-5, atol=1e-8 * np.abs(wanted).max())


def test_columns_equal_arrays(spark):
    rows = [(float(x), [100.0, 0.03, 50.0, 2.0, 7.0]) for x in range(0, 200, 7)]
    df = spark.createDataFrame(rows, "x double, p array<double>")
    for name, curve in C.CURVES.items():
        params = F.array(*[F.get("p", F.lit(C.ROLES.index(role))) for role in curve.roles])
        u = curve.shape(shapes.Arrays, np.array([x for x, _ in rows]), 0.03, 50.0 if curve.fits_midpoint else 0.0, 2.0 if curve.fits_asymmetry else 1.0)
        wanted = 7 + (93 if curve.absolute else 100) * u
        assert np.allclose([r[0] for r in df.select(C.evaluate(name, F.col("x"), params)).collect()], wanted, rtol=1e-12)


def test_grid_against_every_candidate():
    rng, x = np.random.default_rng(5), np.arange(120.0)
    y = np.maximum.accumulate(900 / (1 + np.exp(-0.07 * (x - 55))) + rng.normal(0, 20, 120))
    row = step.pd.DataFrame([{"ymax": y.max(), "xlo": 0.0, "xhi": 119.0, "k": 0.01, "t0": 60.0, "d": 1.0}])
    for name in ("Logistic", "Gompertz", "Exponential"):
        curve = C.CURVES[name].for_workers()
        shape, sse = step.grid_shape(curve, x, y, row, 9, 1)
        least = np.inf
        for k in np.exp(np.linspace(*np.log(curve.rate_bounds), 9)):
            for t0 in np.linspace(0, 119, 9) if curve.fits_midpoint else [60.0]:
                u = curve.shape(shapes.Arrays, x, k, t0, 1.0)
                low, high = (b * y.max() for b in curve.height_bounds)
                heights = np.concatenate([np.linspace(low, high, 4001), [np.clip(np.polyfit(u, y, 1)[0] if not curve.absolute else np.polyfit(u, y, 1).sum(), low, high)]])
                if curve.absolute:  # y - h u = c (1 - u)
                    c = ((y[None] - heights[:, None] * u) @ (1 - u)) / ((1 - u) @ (1 - u))
                    rest = y[None] - heights[:, None] * u - c[:, None] * (1 - u)
                else:
                    rest = y[None] - heights[:, None] * u
                    rest = rest - rest.mean(1, keepdims=True)
                least = min(least, float((rest**2).sum(1).min()))
        assert sse == pytest.approx(least, rel=1e-6)
        finer = step.grid_shape(curve, x, y, row, 9, 4)
        assert finer[1] <= sse and finer[0].shape == shape.shape


def test_fits_are_no_worse_than_the_grid(target):
    points = hold_points(target, ["sid"])
    grid = {(r.sid, r.model): r.sse for r in grid_seeds(points).collect()}
    fits = fit_curves(points, make_folds(target, ["sid"]))
    assert len(grid) == 8
    for r in fits.initial.collect():
        assert r.sse <= grid[r.sid, r.model] * (1 + 1e-9) + 1e-6


def test_a_grid_helps_where_a_fit_does_not_converge(target):
    one = target.where("sid = 'g'")
    passes = dict(models=("Logistic", "Gompertz"), max_passes=6, starts=2)
    plain = fit_curves(one, make_folds(one, ["sid"]), ["sid"], FitOptions(**passes, grid_rounds=0))
    seeded = fit_curves(one, make_folds(one, ["sid"]), ["sid"], FitOptions(**passes))
    error = lambda fits: {r.model: r.sse for r in fits.initial.collect()}
    before, after = error(plain), error(seeded)
    assert all(after[m] <= before[m] * (1 + 1e-9) for m in before) and after["Gompertz"] < 0.5 * before["Gompertz"]
