"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the local cores. Each query is counted over all its columns.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from growthpanel.operators import averaging, forecast, selection
from growthpanel.operators.fitting import FitOptions, fit_curves, hold_points
from growthpanel.operators.folds import make_folds, prepare_target
from growthpanel.operators.predictions import curve_metrics, full_fit
from growthpanel.operators.weekly import weekly_panel
from growthpanel.plans.queries import QUERIES
from growthpanel.sources.records import read_table, select_records

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

#: catalogue queries, in an order in which shared inputs are made by the first that needs them
CATALOGUE = [
    "flagship_weekly_by_segment",
    "w1_weekly_resample",
    "w2_fill_calendar",
    "w4_fill_missing",
    "c3_split_count",
    "c4_folds",
    "f2_linear_pair",
    "m1_forest_cv",
    "m3_forest_grid",
    "f2_full_fit",
    "a4_fold_summary",
    "e6_component_report",
    "b2_combined_metrics",
    "h5_interval",
    "h6_forecast_table",
    "r4_full_predictions",
    "d2_normal_qq",
    "d3_density",
]


def consume(df: DataFrame) -> int:
    """Make Spark compute every column of every row."""
    return df.select(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).alias("h")).agg(F.count("h")).first()[0]


def supplier_run(spark: SparkSession, timings: dict[str, float]) -> None:
    """A panel of many series: weekly table, fits of all curves and folds, averages and forecast per supplier."""
    keys = ["l_suppkey"]
    lineitem = read_table(spark, f"{FOLDER}/lineitem.parquet")

    def timed(name: str, make):
        began = time.time()
        made = make()
        timings[name] = round(time.time() - began, 3)
        return made

    weekly = weekly_panel(select_records(lineitem, keys, "l_shipdate", "l_quantity", None), keys).persist()
    timed("panel_weekly_by_supplier", lambda: consume(weekly))
    target = prepare_target(weekly, keys)
    folds = make_folds(target, keys).persist()
    points = timed("panel_points", lambda: hold_points(target, keys))
    options = FitOptions()
    params = timed("panel_fit_by_supplier", lambda: fit_curves(points, folds, options=options).params.checkpoint())
    scored = curve_metrics(target, folds, params, keys).persist()
    timed("panel_metrics_by_supplier", lambda: consume(scored))

    def ensemble():
        parts = averaging.components(params, keys)
        weights = averaging.component_weights(target, folds, parts, keys)
        return consume(averaging.average_metrics(averaging.average_predictions(target, parts, weights, keys), keys))

    timed("panel_averages_by_supplier", ensemble)

    def ahead():
        named = scored.select(*keys, "model", F.col("test_r2").alias("r2"))
        chosen = forecast.best_curve_params(full_fit(params), selection.best_model(named, keys), keys)
        future = forecast.horizon(target, keys)
        return consume(forecast.param_noise_interval(future, chosen, keys, draws=1000))

    timed("panel_interval_by_supplier", ahead)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("growthpanel-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    timings: dict[str, float] = {}
    read_table(spark, f"{FOLDER}/nation.parquet").count()
    for name in CATALOGUE:
        began = time.time()
        consume(QUERIES[name](spark, FOLDER))
        timings[name] = round(time.time() - began, 3)
    supplier_run(spark, timings)
    result = {
        "metric": "growthpanel headline queries, total",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": FOLDER.rstrip("/").rsplit("sf", 1)[-1],
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
