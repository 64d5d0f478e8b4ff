"""Curves against published fits of one series of 887 weeks, whose input is not public."""

import math
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from growthpanel.functions import curves as C
from growthpanel.functions.noise import normal_quantile, repeatable_normal
from growthpanel.operators import metrics, reports, selection
from growthpanel.operators.forecast import horizon
from growthpanel.operators.predictions import curve_predictions

# Published coefficients, prediction summaries, forecast ends and overall metrics.
COEFFICIENTS = {
    "Exponential": [10275.317481465265, 0.002768321284470875, -5866.139389949724],
    "Logistic": [211563.9999999961, 0.00450821083343723, 885.0527310555221, 2770.179542130328],
    "Richards": [211563.99999999997, 0.0045288744320565455, 885.9999999999999, 1.0103968510144474, 2492.4905550834087],
    "Gompertz": [211563.99999999994, 0.0024619188440262755, 776.9627316057267, 7606.610750631942],
}
SUMMARY = {
    "Exponential_Pred": (38647.798609194, 30150.796641162626, 4409.1780915155405, 113533.6355922565),
    "Logistic_Pred": (38647.799400344535, 29869.695941159072, 6612.946408181282, 108778.04958589307),
    "Richards_Pred": (38647.79969679471, 30009.55048586342, 6410.14530893687, 109031.66643626279),
    "Gompertz_Pred": (38591.05251136721, 29508.225289647027, 7840.187911070878, 102555.66651050748),
}
FORECAST = {887: 109270.43207940336, 888: 109509.18972324193, 1146: 164680.56}
OVERALL = [
    ("Exponential", "Individual", 7731.6605611145405, -1.5140727871707789, 7057.198041902117),
    ("Logistic", "Individual", 7579.2375475517065, -1.2466965870098292, 7090.880300941368),
    ("Richards", "Individual", 7522.156327993745, -1.090876718539268, 7050.070435868215),
    ("Gompertz", "Individual", 7790.874612904494, -1.1944848807062916, 7141.31587666446),
    ("Random Forest", "Ensemble", 14203.999385329133, -5.722610314559548, 12742.337034013606),
    ("Gradient Boosting", "Ensemble", 14045.089385963995, -5.487578520100206, 12577.979999842897),
    ("Simple Average", "Ensemble", 11721.264641356223, 0.8517839678126375, 5389.578466139484),
    ("Weighted Average (R2)", "Ensemble", 11581.438307620016, 0.8552990987696277, 5328.982716763706),
    ("Weighted Average (InvMSE)", "Ensemble", 11703.229813114913, 0.8522397197013659, 5382.140075072861),
]


@pytest.fixture(scope="module")
def published(spark):
    rows = [("all", m, -1, p) for m, p in COEFFICIENTS.items()]
    return spark.createDataFrame(rows, "series string, model string, fold int, params array<double>")


def test_prediction_summary(spark, published):
    weeks = spark.range(887).selectExpr("'all' as series", "cast(id as double) as x", "0D as y")
    preds = curve_predictions(weeks, published)
    full = reports.full_predictions(preds, preds.limit(0), [], [])
    found = {r["Model"]: r for r in reports.predictions_summary(full).collect()}
    for model, (mean, std, low, high) in SUMMARY.items():
        row = found[model]
        for value, expected in zip(row[2:], (mean, std, low, high)):
            assert value == pytest.approx(expected, rel=1e-12)


def test_forecast_of_the_best_curve(spark, published):
    history = spark.sql("SELECT 'all' AS series, DATE'2023-12-31' AS date, 886D AS x, 886 AS pos")
    future = horizon(history)
    assert future.count() == 260
    ends = future.agg(F.min("date"), F.max("date"), F.max("x")).first()
    assert [str(v) for v in ends] == ["2024-01-07", "2028-12-24", "1146.0"]
    ahead = curve_predictions(future, published.where("model = 'Richards'"))
    found = {r["pos"]: r["pred"] for r in ahead.collect()}
    for pos, value in FORECAST.items():
        assert found[pos] == pytest.approx(value, abs=0.005)


def test_coefficient_table_names(spark, published):
    rows = reports.coefficient_table(published).collect()
    names = [r["Parameter"] for r in rows if r["Model"] == "Gompertz"]
    assert names == ["L", "k", "t0", "c_offset"]
    failed = published.where("model = 'Logistic'").withColumn("params", F.lit(None).cast("array<double>"))
    assert [(r["Parameter"], r["Value"]) for r in reports.coefficient_table(failed).collect()] == [("Fit Failed", None)]


@pytest.fixture(scope="module")
def overall(spark):
    rows = [("all", *r) for r in OVERALL]
    return spark.createDataFrame(rows, "series string, model string, type string, rmse double, r2 double, mae double")


def test_best_models(overall):
    for kind, name in (("Individual", "Richards"), ("Ensemble", "Weighted Average (R2)")):
        assert selection.best_model(overall.where(F.col("type") == kind)).first()["best_model"] == name


def test_best_model_ties_and_missing_scores(spark):
    rows = [("a", "Gompertz", 0.5), ("a", "Logistic", 0.5), ("a", "Richards", None), ("b", "Logistic", None), ("b", "Richards", float("-inf"))]
    scores = spark.createDataFrame(rows, "series string, model string, r2 double").withColumn("rmse", F.lit(1.0))
    best = {r["series"]: r["best_model"] for r in selection.best_model(scores).collect()}
    assert best == {"a": "Logistic", "b": None}
    fallback = {r["series"]: r["best_model"] for r in selection.best_model(scores, secondary="rmse").collect()}
    assert fallback == {"a": "Logistic", "b": "Logistic"}


def test_overall_score_by_hand(overall):
    found = {r["model"]: r["overall_score"] for r in selection.overall_score(overall).collect()}
    columns = list(zip(*OVERALL))[2:]
    scaled = [[(v - min(c)) / (max(c) - min(c) + 1e-10) for v in c] for c in columns]
    for i, row in enumerate(OVERALL):
        a, b, c = (s[i] for s in scaled)
        assert found[row[0]] == pytest.approx((1 - a + b + 1 - c) / 3, abs=1e-12)


def test_extreme_arguments_stay_finite_or_null(spark):
    df = spark.sql("SELECT explode(array(-1e6D, 0D, 1e6D)) AS x")
    for name, params in {"Logistic": [1.0, 0.1, 0.0, 0.0], "Richards": [1.0, 0.1, 0.0, 0.1, 0.0], "Gompertz": [1.0, 0.1, 0.0, 0.0]}.items():
        values = [r[0] for r in df.select(C.evaluate(name, F.col("x"), F.array(*[F.lit(p) for p in params]))).collect()]
        assert values[0] == 0.0 and values[2] == 1.0
    nan = df.select(C.evaluate("Exponential", F.col("x"), F.array(F.lit(0.0), F.lit(1.0), F.lit(0.0)))).collect()
    assert nan[2][0] is None


def test_r_squared_edges(spark):
    rows = [("one", 1.0, 1.0), ("hit", 2.0, 2.0), ("hit", 2.0, 2.0), ("miss", 2.0, 2.0), ("miss", 2.0, 3.0), ("fit", 1.0, 1.0), ("fit", 3.0, 2.0)]
    scored = metrics.score(spark.createDataFrame(rows, "sid string, y double, pred double"), ["sid"])
    assert {r["sid"]: r["r2"] for r in scored.collect()} == {"one": None, "hit": 1.0, "miss": 0.0, "fit": 0.5}


def test_normal_quantile_and_noise(spark):
    points = [1e-6, 0.001, 0.02425, 0.1, 0.5, 0.9, 0.97575, 0.999, 1 - 1e-6]
    rows = spark.createDataFrame([(p,) for p in points], "p double").select("p", normal_quantile(F.col("p")).alias("z")).collect()
    for r in rows:
        assert r["z"] == pytest.approx(NormalDist().inv_cdf(r["p"]), abs=5e-9, rel=5e-9)
    ids = spark.range(20000)
    drawn = ids.select("id", repeatable_normal(1, F.col("id")).alias("z"))
    again = ids.repartition(7).select("id", repeatable_normal(1, F.col("id")).alias("z"))
    assert drawn.exceptAll(again).isEmpty()
    mean, std = drawn.agg(F.avg("z"), F.stddev("z")).first()
    assert abs(mean) < 0.03 and math.isclose(std, 1.0, abs_tol=0.03)
