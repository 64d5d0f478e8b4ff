from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from growthpanel.functions import curves as C
from growthpanel.operators import trees
from growthpanel.operators.folds import FULL, make_folds
from growthpanel.plans.training import series_status
from growthpanel.sources.runstore import packed

OPTIONS = trees.TreeOptions(
    trees=3, forest_depth=3, boosting_depth=2, bins=32,
    forest_grid={"trees": [3], "depth": [2, 3]}, boosting_grid={"trees": [2], "depth": [2, 3]}, inner_folds=2,
)


@pytest.fixture(scope="module")
def panel(spark):
    rows = spark.range(120).selectExpr("cast(id AS int) AS pos", "cast(id AS double) AS x")
    names = spark.createDataFrame([("A", 1.0), ("N", 2.0), ("R", 5.0)], "sid string, size double")
    y = F.col("size") * (F.lit(50.0) + F.col("x") * 3)
    return rows.crossJoin(F.broadcast(names)).select("sid", "pos", "x", y.alias("y"), F.lit("ok").alias("status")).persist()


@pytest.fixture(scope="module")
def params(spark, panel):
    """Curves of every fold, but for one of A's first fold."""
    start = {"Exponential": [200.0, 0.005, 10.0], "Logistic": [300.0, 0.02, 60.0, 5.0], "Richards": [300.0, 0.02, 60.0, 2.0, 5.0], "Gompertz": [400.0, 0.02, 40.0, 5.0]}
    rows = [
        (s, m, f, None if (s, m, f) == ("A", "Gompertz", 0) else start[m], "ok")
        for s in "ANR" for m in C.CURVE_NAMES for f in [FULL, *range(5)]
    ]
    return spark.createDataFrame(rows, "sid string, model string, fold int, params array<double>, status string").persist()


def test_a_series_without_a_curve_keeps_its_rows(spark, panel, params):
    grown = trees.train_trees(panel, params, ["sid"], OPTIONS)
    for ensemble in grown.values():
        found = trees.tree_predictions(panel.select("sid", "pos", "x"), ensemble)
        counts = found.groupBy("sid", "tree_status").agg(F.count(F.lit(1)).alias("rows"), F.count("pred").alias("preds")).collect()
        assert sorted(map(tuple, counts)) == [("A", "missing_curve", 120, 0), ("N", "ok", 120, 120), ("R", "ok", 120, 120)]
    status = {r["sid"]: (r["status"], r["missing_fits"]) for r in series_status(panel, params, ["sid"]).collect()}
    assert status == {"A": ("missing_curve", 1), "N": ("ok", 0), "R": ("ok", 0)}


def test_target_is_scaled_for_one_series_too(panel):
    one = trees.target_scale(panel.where("sid = 'R'"), ["sid"]).first()
    assert one["target_scale"] == pytest.approx(5 * (50 + 119 * 3))


def test_every_fold_is_scored(panel, params):
    folds = make_folds(panel, ["sid"])
    found = trees.tree_cv_metrics(panel, folds, params, ["sid"], OPTIONS).collect()
    assert {(r["sid"], r["model"]) for r in found} == {(s, m) for s in "ANR" for m in (trees.FOREST, trees.BOOSTING)}


def test_series_too_short_for_folds_have_a_status(spark, panel, params):
    short = panel.where("pos < 3").withColumn("sid", F.lit("S")).unionByName(panel)
    assert {r["sid"]: r["status"] for r in series_status(short, params, ["sid"]).collect()}["S"] == "too_few_rows"


def _tasks_during(spark, action):
    """Tasks of all jobs that an action starts, by the status tracker."""
    group = f"counted-{id(action)}"
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        action()
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    tracker = spark.sparkContext.statusTracker()
    stages = {s for job in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(job).stageIds}
    return sum(info.numTasks for info in map(tracker.getStageInfo, stages) if info is not None)


def test_training_runs_as_many_tasks_as_the_rows_ask_for(spark, panel, params):
    """Few rows in many partitions: before, each job had a task per partition, 3,123 and 4,577 in all."""
    wide = panel.repartition(24, "sid", "pos").checkpoint()
    folds = make_folds(panel, ["sid"])
    options = replace(OPTIONS, models=(trees.BOOSTING,))
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        assert _tasks_during(spark, lambda: trees.train_trees(wide, params, ["sid"], options)) < 1000
        assert _tasks_during(spark, lambda: trees.tree_cv_metrics(wide, folds.where("fold = 1"), params, ["sid"], options).collect()) < 1000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", parts)


def test_packed_rows_are_whole_and_in_few_partitions(spark):
    rows = packed(spark.range(0, 12_000, 1, 40), None, "rows")
    assert (rows.count(), rows.rdd.getNumPartitions()) == (12_000, 3)
    assert packed(spark.range(0), None, "none").count() == 0
