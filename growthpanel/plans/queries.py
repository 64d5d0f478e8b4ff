"""One query per operator, over the whole given tables.

Most read ``lineitem`` as three weekly series, one per return flag, each holding a third of all rows; gaps, short series
and intraday times come from other keys and tables. Curves come in two forms: ``paired`` has given shapes with their best
linear pair (a closed form, which plain SQL can repeat), ``fitted`` runs the fit to its end.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from growthpanel.functions import curves as C
from growthpanel.functions import shapes
from growthpanel.operators import averaging, chartdata, features, folds, forecast, metrics, predictions, reports, selection, trees, weekly
from growthpanel.operators import fitting
from growthpanel.operators.averaging import combine
from growthpanel.operators.fitting import FitOptions
from growthpanel.operators.trees import TreeOptions
from growthpanel.plans.prediction import predict, predict_weekly
from growthpanel.sources import storage
from growthpanel.sources.records import read_table, reject_table, rejected_records, select_records

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

FLAG = ["l_returnflag"]
#: shapes for ``paired``: rate and asymmetry, with the midpoint at the median week
SHAPES = {"Exponential": (0.005, 1.0), "Logistic": (0.01, 1.0), "Richards": (0.02, 0.5), "Gompertz": (0.01, 1.0)}
FITTED = FitOptions()
SMALL_TREES = TreeOptions(
    trees=4,
    forest_depth=4,
    boosting_depth=3,
    forest_grid={"trees": [3, 4], "depth": [3, 5]},
    boosting_grid={"trees": [2, 3], "depth": [2, 3]},
    bins=64,
)


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def tidy(df: DataFrame, digits: int = 6, **by_column: int) -> DataFrame:
    """Dates as text and doubles rounded, so that results compare by value."""
    columns = []
    for column in df.schema.fields:
        value = F.col(f"`{column.name}`")
        if isinstance(column.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            value = F.date_format(value, "yyyy-MM-dd")
        elif isinstance(column.dataType, T.DoubleType):
            value = F.round(value, by_column.get(column.name, digits)) + F.lit(0.0)
        columns.append(value.alias(column.name))
    return df.select(*columns)


class Inputs:
    """Tables that several queries share, made once per session and data folder."""

    _known: dict[tuple[type, str, str], Inputs] = {}

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._made = spark, folder, {}
        fitting.ensure_checkpoint_dir(spark)

    @classmethod
    def of(cls, spark: SparkSession, folder: str) -> Inputs:
        place = (cls, spark.sparkContext.applicationId, folder)
        if place not in cls._known:
            cls._known[place] = cls(spark, folder)
        return cls._known[place]

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, f"{self.folder}/{name}.parquet")

    def _once(self, name: str, make: Callable[[], object]):
        if name not in self._made:
            made = make()
            # written once: plans on top stay small, and a lost executor does not bring the raw rows back
            self._made[name] = made.checkpoint() if isinstance(made, DataFrame) else made
        return self._made[name]

    def shipped(self, keys: list[str]) -> DataFrame:
        return select_records(self.table("lineitem"), keys, "l_shipdate", "l_quantity", None)

    @property
    def weekly(self) -> DataFrame:
        return self._once("weekly", lambda: weekly.weekly_panel(self.shipped(FLAG), FLAG))

    @property
    def target(self) -> DataFrame:
        return self._once("target", lambda: folds.prepare_target(self.weekly, FLAG))

    @property
    def folds(self) -> DataFrame:
        return self._once("folds", lambda: folds.make_folds(self.target, FLAG))

    @property
    def points(self) -> fitting.Points:
        return self._once("points", lambda: fitting.hold_points(self.target, FLAG))

    @property
    def paired(self) -> DataFrame:
        """Every curve in its given shape, fitted to every fold and to the whole series (fold -1)."""

        def make() -> DataFrame:
            facts = fitting.series_facts(self.points.df, FLAG)
            ranges = self.folds.select(*FLAG, "fold", "train_end").unionByName(
                facts.select(*FLAG, F.lit(folds.FULL).alias("fold"), F.col("n").alias("train_end"))
            )
            rows = [F.struct(F.lit(m).alias("model"), F.lit(k).alias("k"), F.lit(d).alias("d")) for m, (k, d) in SHAPES.items()]
            middle = F.when(F.col("model") == "Exponential", F.lit(0.0)).otherwise(F.col("xmid"))
            shapes = ranges.join(facts.select(*FLAG, "xmid"), FLAG).withColumn("s", F.explode(F.array(*rows)))
            shapes = shapes.select(*FLAG, "fold", "train_end", "xmid", "s.*").withColumn("t0", middle)
            return fitting.linear_pairs(self.points, shapes)

        return self._once("paired", make)

    @property
    def fitted(self) -> fitting.Fits:
        return self._once("fitted", lambda: fitting.fit_curves(self.points, self.folds, options=FITTED))

    @property
    def paired_full(self) -> DataFrame:
        return predictions.full_fit(self.paired)

    @property
    def curve_preds(self) -> DataFrame:
        return predictions.curve_predictions(self.target.drop("status"), self.paired_full, FLAG)

    @property
    def curve_metrics(self) -> DataFrame:
        return self._once("curve_metrics", lambda: predictions.curve_metrics(self.target, self.folds, self.paired, FLAG))

    @property
    def parts(self) -> DataFrame:
        return averaging.components(self.paired, FLAG)

    @property
    def weights(self) -> DataFrame:
        return self._once("weights", lambda: averaging.component_weights(self.target, self.folds, self.parts, FLAG))

    @property
    def average_preds(self) -> DataFrame:
        rows = self.target.drop("status")
        return self._once("average", lambda: averaging.average_predictions(rows, self.parts, self.weights, FLAG))

    @property
    def metrics(self) -> DataFrame:
        averages = averaging.average_metrics(self.average_preds, FLAG)
        return self._once("metrics", lambda: selection.combined_metrics(self.curve_metrics, averages, FLAG))

    def best(self, kind: str) -> DataFrame:
        rows = self.metrics.where(F.col("type") == kind)
        return self._once(f"best {kind}", lambda: selection.best_model(rows, FLAG))

    @property
    def best_params(self) -> DataFrame:
        best = self.best("Individual")
        return self._once("best_params", lambda: forecast.best_curve_params(self.paired_full, best, FLAG))

    @property
    def future(self) -> DataFrame:
        return forecast.horizon(self.target, FLAG)

    @property
    def best_ensemble_ahead(self) -> DataFrame:
        ahead = averaging.average_predictions(self.future, self.parts, self.weights, FLAG)
        return ahead.join(self.best("Ensemble").select(*FLAG, F.col("best_model").alias("model")), [*FLAG, "model"])

    @property
    def trees(self) -> dict[str, trees.TreeEnsemble]:
        return self._once("trees", lambda: trees.train_trees(self.target, self.paired, FLAG, SMALL_TREES))

    @property
    def tree_cv(self) -> DataFrame:
        return self._once("tree_cv", lambda: trees.tree_cv_metrics(self.target, self.folds, self.paired, FLAG, SMALL_TREES))

    @property
    def saved(self) -> str:
        def save() -> str:
            folder = self.scratch()
            storage.save_models(self.trees.values(), self.paired, self.best("Individual"), f"{folder}/models")
            return folder

        return self._once("saved", save)

    def scratch(self) -> str:
        """A new folder on the shared storage of the session."""
        return f"{self.spark.sparkContext.getCheckpointDir()}/growthpanel-{uuid.uuid4().hex}"


class FittedInputs(Inputs):
    """The same tables on fits that were run to their end; data and fits are those of ``Inputs``."""

    SHARED = ("weekly", "target", "folds", "points", "fitted")

    def _once(self, name: str, make: Callable[[], object]):
        if name in self.SHARED:
            return Inputs.of(self.spark, self.folder)._once(name, make)
        return super()._once(name, make)

    @property
    def paired(self) -> DataFrame:
        return self.fitted.params


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Orders by market segment as gap-free weekly series with rolling means and running totals."""
    tables = Inputs(spark, folder)
    orders = tables.table("orders").join(
        tables.table("customer"), F.col("o_custkey") == F.col("c_custkey")
    )
    keys = ["c_mktsegment"]
    records = select_records(orders, keys, "o_orderdate", "o_totalprice", None)
    return tidy(weekly.weekly_panel(records, keys, scale=2), 4)


QUERIES["flagship_weekly_by_segment"] = flagship


# --- sources and sinks ------------------------------------------------------------------------------------------------


@query
def s1_load(spark, folder):
    """Orders written as CSV, then read back by name with explicit types."""
    i = Inputs.of(spark, folder)
    path = f"{i.scratch()}/orders.csv"
    storage.write_table(i.table("orders"), path)
    records = select_records(read_table(spark, path, "csv"), ["o_orderstatus"], "o_orderdate", "o_totalprice", "o_orderkey")
    return tidy(records, 2)


@query
def s2_select_columns(spark, folder):
    orders = Inputs.of(spark, folder).table("orders")
    return tidy(select_records(orders, ["o_orderpriority"], "o_orderdate", "o_totalprice", "o_orderkey"), 2)


@query
def s3_parse_dates(spark, folder):
    """Dates as text, with the status letter in place of the date where it is P: permissive mode counts those."""
    orders = Inputs.of(spark, folder).table("orders")
    text = F.when(F.col("o_orderstatus") == "P", F.col("o_orderstatus")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return rejected_records(orders.withColumn("day", text), "day", keys=["o_orderstatus"])


@query
def s3_corrupt_lines(spark, folder):
    """Orders as CSV lines, some too long, some too short, some without a date: what is kept, and what is rejected why."""
    i = Inputs.of(spark, folder)
    path = f"{i.scratch()}/orders"
    late = F.when(F.col("o_orderpriority") == "5-LOW", F.lit("soon")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    price = F.when(F.col("o_orderstatus") == "P", F.lit("dear")).otherwise(F.col("o_orderkey").cast("string"))
    fields = F.when(F.col("o_orderpriority") == "1-URGENT", F.array("o_orderstatus", late, price, F.lit("more")))
    fields = fields.when(F.col("o_orderpriority") == "2-HIGH", F.array("o_orderstatus", late)).otherwise(F.array("o_orderstatus", late, price))
    lines = i.table("orders").select(F.concat_ws(",", fields).alias("order_status,day,number"))
    lines.write.option("header", True).option("sep", "\u0001").option("quote", "").csv(path)
    read = read_table(spark, path, "csv", mode="permissive")
    kept = select_records(read, ["order_status"], "day", "number", None, mode="permissive").where("ts IS NOT NULL AND number IS NOT NULL")
    found = reject_table(read, "day", ["number"]).groupBy("order_status", "reason").agg(F.count(F.lit(1)).alias("rows"))
    return found.unionByName(kept.groupBy("order_status").agg(F.lit("kept").alias("reason"), F.count(F.lit(1)).alias("rows")))


@query
def s4_write_tables(spark, folder):
    i = Inputs.of(spark, folder)
    path = f"{i.scratch()}/weekly"
    storage.write_table(i.weekly, path, "csv", FLAG)
    back = spark.read.schema(i.weekly.schema).option("header", True).option("enforceSchema", False).csv(path)
    return tidy(back.select(*i.weekly.columns), 4)


@query
def s4_clustered_reports(spark, folder):
    """The weekly panel of all suppliers, written by supplier: weeks of each, and the files that hold them."""
    i = Inputs.of(spark, folder)
    path = f"{i.scratch()}/by_supplier"
    panel = weekly.weekly_panel(i.shipped(["l_suppkey"]), ["l_suppkey"])
    (written,) = storage.write_reports({"weekly": panel}, path, "parquet", ["l_suppkey"])
    back = spark.read.parquet(written).select("l_suppkey", F.col("_metadata.file_name").alias("file"))
    return tidy(back.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("weeks"), F.count_distinct("file").alias("files")))


@query
def s5_save_models(spark, folder):
    """What was saved, read back."""
    i = Inputs.of(spark, folder)
    curves, best = storage.load_curves(spark, f"{i.saved}/models")
    return tidy(curves.where("fold = -1").join(best, FLAG).select(*FLAG, "model", "status", "best_model"))


def _against_unsaved(i: Inputs, found: DataFrame) -> DataFrame:
    """Weeks per series, and how far predictions (pos, pred) lie from those of the model that was never saved."""
    own = trees.tree_predictions(i.target.select(*FLAG, "pos", "x"), i.trees[trees.FOREST]).select(*FLAG, "pos", F.col("pred").alias("own"))
    both = found.join(own, [*FLAG, "pos"], "full")
    return tidy(both.groupBy(*FLAG).agg(F.count("pred").alias("weeks"), F.max(F.abs(F.col("pred") - F.col("own"))).alias("difference")))


@query
def s6_load_models(spark, folder):
    i = Inputs.of(spark, folder)
    loaded = storage.load_ensemble(spark, f"{i.saved}/models")
    return _against_unsaved(i, trees.tree_predictions(i.target.select(*FLAG, "pos", "x"), loaded))


@query
def s7_predict(spark, folder):
    """Predictions by the saved model, written as CSV and read back."""
    i = Inputs.of(spark, folder)
    output = f"{i.saved}/forecast"
    made = predict(i.shipped(FLAG), i.saved, FLAG, output=output)
    back = spark.read.schema(made.schema).option("header", True).option("enforceSchema", False).csv(output)
    return _against_unsaved(i, back.select(*FLAG, "pos", F.col("predicted_cumulative").alias("pred")))


# --- projections and filters ------------------------------------------------------------------------------------------


@query
def p1_validate(spark, folder):
    i = Inputs.of(spark, folder)
    folds.validate_panel(i.weekly)
    return i.weekly.groupBy(*FLAG).agg(F.count("time_idx").alias("rows"))


@query
def p2_fold_subset(spark, folder):
    i = Inputs.of(spark, folder)
    rows = folds.fold_rows(i.target, i.folds, FLAG)
    return tidy(rows.select(*FLAG, "fold", "role", "pos", "x", "y"))


@query
def p3_last_fold(spark, folder):
    """By customer, so that series too short for folds are in it: all train, no test."""
    i = Inputs.of(spark, folder)
    target = by_customer(i)
    rows = folds.last_fold_rows(target, folds.make_folds(target, ["o_custkey"]), ["o_custkey"])
    return tidy(
        rows.groupBy("o_custkey", "role").agg(
            F.count(F.lit(1)).alias("rows"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos")
        )
    )


def by_customer(i: Inputs) -> DataFrame:
    def make() -> DataFrame:
        records = select_records(i.table("orders"), ["o_custkey"], "o_orderdate", "o_totalprice", None)
        return folds.prepare_target(weekly.weekly_panel(records, ["o_custkey"], 2), ["o_custkey"])

    return i._once("by_customer", make)


def with_gaps(i: Inputs) -> DataFrame:
    """Weeks per supplier: the empty ones have a NULL cumulative count."""
    keys = ["l_suppkey"]
    return i._once("with_gaps", lambda: weekly.fill_calendar(weekly.resample_weeks(i.shipped(keys), keys), keys))


@query
def p4_drop_missing(spark, folder):
    rows = with_gaps(Inputs.of(spark, folder))
    return tidy(metrics.prediction_summary(rows, ["l_suppkey"], "cumulative"), 4)


@query
def p5_complete_rows(spark, folder):
    """The score without the models that lack a measure: here the MAE of one curve is blanked."""
    rows = Inputs.of(spark, folder).metrics.withColumn("mae", F.when(F.col("model") != "Gompertz", F.col("mae")))
    return tidy(selection.overall_score(rows, FLAG).select(*FLAG, "model", "overall_score"), 5)


@query
def p6_filter_metric(spark, folder):
    long = selection.melt_metrics(Inputs.of(spark, folder).metrics, [*FLAG, "model"])
    return tidy(long.where(F.col("metric") == "rmse"), 3)


@query
def p7_present_columns(spark, folder):
    return tidy(reports.overall_metrics(Inputs.of(spark, folder).metrics.drop("mae"), FLAG), 3, **{"R²": 6})


# --- weekly series ----------------------------------------------------------------------------------------------------


@query
def w1_weekly_resample(spark, folder):
    """Intraday events: the running event number is the cumulative count, the last one of the week counts."""
    events = Inputs.of(spark, folder).table("events")
    records = select_records(events, ["event_type"], "ts", "value", "event_id", order_by="event_id")
    return tidy(weekly.resample_weeks(records, ["event_type"], 2), 2)


@query
def w1_weekly_by_time(spark, folder):
    """The same without an order of rows: the time alone says which count is the last."""
    events = Inputs.of(spark, folder).table("events")
    records = select_records(events, ["event_type"], "ts", "value", "event_id")
    return tidy(weekly.resample_weeks(records, ["event_type"], 2), 2)


@query
def w1_weekly_last_of_day(spark, folder):
    """Dated records: among those of the week's last day the greatest cumulative count is the last."""
    orders = Inputs.of(spark, folder).table("orders")
    records = select_records(orders, ["o_orderpriority"], "o_orderdate", "o_totalprice", "o_orderkey")
    return tidy(weekly.resample_weeks(records, ["o_orderpriority"], 2), 2)


@query
def w2_fill_calendar(spark, folder):
    return tidy(with_gaps(Inputs.of(spark, folder)))


@query
def w3_rolling_means(spark, folder):
    rows = with_gaps(Inputs.of(spark, folder))
    keys = ["l_suppkey"]
    means = {f"rolling_mean_{n}w": weekly.rolling_mean("number", n, keys) for n in (4, 12)}
    return tidy(rows.select(*keys, "date", *[m.alias(name) for name, m in means.items()]), 4)


@query
def w4_fill_missing(spark, folder):
    panel = weekly.add_calendar_columns(with_gaps(Inputs.of(spark, folder)), ["l_suppkey"])
    return tidy(panel.select("l_suppkey", "date", "cumulative", "rolling_mean_4w", "rolling_mean_12w"), 4)


@query
def w5_month_quarter(spark, folder):
    return tidy(Inputs.of(spark, folder).weekly.select(*FLAG, "date", "month", "quarter"))


@query
def w6_time_index(spark, folder):
    return tidy(Inputs.of(spark, folder).weekly.select(*FLAG, "date", "time_idx"))


@query
def w7_row_position(spark, folder):
    """Customers with a single order have one week, time index 0."""
    i = Inputs.of(spark, folder)
    return tidy(by_customer(i).select("o_custkey", "date", "pos", F.col("x").alias("time_idx")))


@query
def w8_monthly_mean(spark, folder):
    return tidy(chartdata.monthly_mean(Inputs.of(spark, folder).weekly, FLAG), 4)


@query
def w9_yearly_distribution(spark, folder):
    return tidy(chartdata.yearly_distribution(Inputs.of(spark, folder).weekly, FLAG), 4)


@query
def w10_counts_over_time(spark, folder):
    return tidy(chartdata.counts_over_time(Inputs.of(spark, folder).weekly, FLAG), 2)


# --- target and folds -------------------------------------------------------------------------------------------------


@query
def c1_target_repair(spark, folder):
    """Missing counts are filled; a type whose count turns infinite (here: errors) is marked invalid."""
    events = Inputs.of(spark, folder).table("events")
    count = (
        F.when(F.col("event_type") == "error", F.lit(float("inf")))
        .when(F.col("value") > 20, F.col("event_id").cast("double"))
    )
    records = select_records(events.withColumn("count", count), ["event_type"], "ts", "value", "count", order_by="event_id")
    target = folds.prepare_target(weekly.weekly_panel(records, ["event_type"], 2), ["event_type"])
    finite = F.when(F.col("status") == "ok", F.col("y"))
    return tidy(target.select("event_type", "date", "status", finite.alias("y")))


@query
def c2_running_maximum(spark, folder):
    """Weekly sums are not monotone: their running maximum is."""
    i = Inputs.of(spark, folder)
    raw = i.weekly.withColumn("cumulative", F.col("number"))
    return tidy(folds.prepare_target(raw, FLAG).select(*FLAG, "pos", "y"), 2)


@query
def c3_split_count(spark, folder):
    target = by_customer(Inputs.of(spark, folder))
    return folds.fold_plan(target, ["o_custkey"])


@query
def c4_folds(spark, folder):
    target = by_customer(Inputs.of(spark, folder))
    return folds.make_folds(target, ["o_custkey"])


@query
def j1_fold_membership(spark, folder):
    target = by_customer(Inputs.of(spark, folder))
    rows = folds.fold_rows(target, folds.make_folds(target, ["o_custkey"]), ["o_custkey"])
    counted = rows.groupBy("o_custkey", "fold", "role").agg(
        F.count(F.lit(1)).alias("rows"), F.min("pos").alias("first_pos"), F.max("y").alias("max_y")
    )
    return tidy(counted, 2)


# --- curves -----------------------------------------------------------------------------------------------------------


def _curve_at_start(name: str) -> Query:
    def run(spark, folder):
        """The curve with its start values, at every week."""
        i = Inputs.of(spark, folder)
        starts = fitting.start_values(i.points.df, FLAG, [name])
        rows = i.target.join(starts.select(*FLAG, "start_params"), FLAG)
        value = C.evaluate(name, F.col("x"), F.col("start_params"))
        return tidy(rows.select(*FLAG, "pos", value.alias("value")), 2)

    return run


for _key, _name in (("g1_exponential", "Exponential"), ("g2_logistic", "Logistic"), ("g4_gompertz", "Gompertz")):
    QUERIES[_key] = _curve_at_start(_name)


@query
def g3_richards(spark, folder):
    """At two asymmetries; at 1 the curve would be the logistic one."""
    i = Inputs.of(spark, folder)
    starts = fitting.start_values(i.points.df, FLAG, ["Richards"])
    rows = i.target.join(starts.select(*FLAG, "start_params"), FLAG).withColumn("nu", F.explode(F.array(F.lit(0.5), F.lit(2.0))))
    at = [F.get("start_params", F.lit(p)) if p != 3 else F.col("nu") for p in range(5)]
    value = C.evaluate("Richards", F.col("x"), F.array(*at))
    return tidy(rows.select(*FLAG, "pos", "nu", value.alias("value")), 2)


# --- fitting ----------------------------------------------------------------------------------------------------------


def _parameters_long(params: DataFrame, *carried: str) -> DataFrame:
    at = params.where(F.col("params").isNotNull())
    return at.select(*FLAG, *carried, F.posexplode("params").alias("position", "value"))


@query
def f1_start_values(spark, folder):
    i = Inputs.of(spark, folder)
    starts = fitting.start_values(i.points.df, FLAG)
    zipped = starts.select(*FLAG, "model", F.posexplode(F.arrays_zip("start_params", "lower", "upper")).alias("position", "v"))
    finite = {c: F.when(F.abs(F.col(f"v.{c}")) < float("inf"), F.col(f"v.{c}")) for c in ("lower", "upper")}
    return tidy(
        zipped.select(
            *FLAG, "model", "position", F.col("v.start_params").alias("start"), *[c.alias(n) for n, c in finite.items()]
        ),
        4,
    )


@query
def f2_linear_pair(spark, folder):
    """Given shapes with their best bounded height and offset, per fold and whole series."""
    paired = Inputs.of(spark, folder).paired
    return tidy(_parameters_long(paired, "model", "fold"), 2)


def _four_digits(value: Column) -> Column:
    size = F.pow(F.lit(10.0), F.floor(F.log10(value)))
    return F.round(value / size, 3) * size


def _errors(rows: DataFrame, measure: str) -> DataFrame:
    """Root mean squared error of whole-series fits to four digits, which SQL finds by a search over the shapes.

    Of the Richards curve: whether it is no worse than the logistic curve, its special case.
    """
    logistic = rows.where("model = 'Logistic'").select(*FLAG, F.col(measure).alias("logistic"))
    richards = F.col("model") == "Richards"
    error = F.when(~richards, _four_digits(F.col(measure))).alias("rmse")
    no_worse = (~richards | (F.col(measure) <= F.col("logistic") * (1 + 1e-9))).alias("no_worse")
    return tidy(rows.join(logistic, FLAG).select(*FLAG, "model", error, no_worse, *[c for c in ("folds", "test_rmse") if c in rows.columns]), 4)


def _whole_fits(i: Inputs, params: DataFrame) -> DataFrame:
    return metrics.score(predictions.curve_predictions(i.target, params.where("params IS NOT NULL"), FLAG), [*FLAG, "model"])


@query
def f2_full_fit(spark, folder):
    i = Inputs.of(spark, folder)
    return _errors(_whole_fits(i, i.fitted.initial.withColumn("fold", F.lit(folds.FULL))), "rmse")


@query
def f2_grid_seed(spark, folder):
    """Least error of each curve on a grid that is zoomed in three times, and whether its fit is no worse."""
    i = Inputs.of(spark, folder)
    fits = i.fitted.initial.select(*FLAG, "model", F.col("sse").alias("fit_sse"), "n")
    both = fitting.grid_seeds(i.points).join(fits, [*FLAG, "model"])
    no_worse = (F.col("fit_sse") <= F.col("sse") * (1 + 1e-9)).alias("no_worse")
    return tidy(both.select(*FLAG, "model", _four_digits(F.sqrt(F.col("sse") / F.col("n"))).alias("rmse"), no_worse), 4)


@query
def f2_registered_curve(spark, folder):
    """A fifth curve, registered for this query: error of its fit, checked against a search over its rate in SQL."""
    i = Inputs.of(spark, folder)
    curve = C.Curve(
        "Monomolecular", ("top", "speed", "base"), ("height", "rate", "offset"),
        shapes.monomolecular, shapes.monomolecular_slopes, 0.01, (0.0001, 0.1), height_bounds=(0.0, 2.0),
    )
    with C.registered(curve):
        fits = fitting.fit_curves(i.points, None, options=FitOptions(models=(curve.name,)))
        return tidy(_whole_fits(i, fits.params).select(*FLAG, "model", "rmse"), 2)


@query
def f3_fold_fits(spark, folder):
    """Fold fits per curve: how many, how many lie in their bounds, and how many are no worse than a given shape."""
    i = Inputs.of(spark, folder)
    given = i.paired.select(*FLAG, "model", "fold", F.col("sse").alias("given_sse"))
    fits = i.fitted.params.where("fold >= 0").join(given, [*FLAG, "model", "fold"])
    starts = fitting.start_values(i.points.df, FLAG).select(*FLAG, "model", "lower", "upper")
    near = F.lit(1e-9)
    inside = F.forall(
        F.arrays_zip("params", "lower", "upper"),
        lambda p: (p["params"] >= p["lower"] - near * F.abs(p["lower"])) & (p["params"] <= p["upper"] + near * F.abs(p["upper"])),
    )
    # the first and the last parameter are bounded, or free, for every curve
    bounded = fits.join(starts, [*FLAG, "model"]).withColumn("lower", F.transform("lower", lambda v: F.greatest(v, F.lit(-1e300))))
    bounded = bounded.withColumn("upper", F.transform("upper", lambda v: F.least(v, F.lit(1e300))))
    return bounded.groupBy(*FLAG, "model").agg(
        F.count(F.lit(1)).alias("fits"),
        F.count_if(inside).alias("inside"),
        F.count_if(F.col("sse") <= F.col("given_sse") * (1 + near)).alias("no_worse"),
    )


@query
def f4_skipped_folds(spark, folder):
    target = by_customer(Inputs.of(spark, folder))
    return fitting.fold_status(folds.make_folds(target, ["o_custkey"]), ["o_custkey"])


@query
def f5_fallback(spark, folder):
    """Fits held to two passes do not converge: the first fit gives way to the start values, and folds to those."""
    i = Inputs.of(spark, folder)
    options = FitOptions(models=("Richards",), starts=1, max_passes=2)
    fits = fitting.fit_curves(i.points, i.folds, options=options)
    fallen = fits.params.where("fold >= 0 AND status = 'start_values'").select(*FLAG, "model", F.explode("params").alias("value"))
    return tidy(fallen.groupBy(*FLAG, "model").agg(F.count(F.lit(1)).alias("values"), F.avg("value").alias("mean")), 4)


@query
def f6_best_fold(spark, folder):
    """The fold with the best test R2, whose parameters seed the final fit."""
    i = Inputs.of(spark, folder)
    tested = predictions.fold_metrics(i.target, i.folds, i.paired, FLAG).where(F.col("role") == "test")
    scored = i.paired.join(tested.select(*FLAG, "model", "fold", F.col("r2").alias("score")), [*FLAG, "model", "fold"])
    best = fitting.best_fold_params(scored, FLAG).withColumnRenamed("fold_best", "params")
    return tidy(best.select(*FLAG, "model", "best_fold", F.get("params", F.lit(0)).alias("first_param")), 2)


@query
def f7_final_fit(spark, folder):
    i = Inputs.of(spark, folder)
    return _errors(_whole_fits(i, predictions.full_fit(i.fitted.params)), "rmse")


@query
def f7_exponential_optimum(spark, folder):
    """Root mean squared error of the final exponential fits: checked against a search over the rate in SQL."""
    i = Inputs.of(spark, folder)
    best = predictions.full_fit(i.fitted.params).where(F.col("model") == "Exponential")
    scored = metrics.score(predictions.curve_predictions(i.target, best, FLAG), FLAG)
    return tidy(scored.select(*FLAG, "rmse"), 2)


@query
def f8_no_folds(spark, folder):
    """Folds withheld: one fit of the whole series, train measures only."""
    i = Inputs.of(spark, folder)
    fits = fitting.fit_curves(i.points, None, options=FITTED)
    measured = predictions.curve_metrics(i.target, i.folds.limit(0), fits.params, FLAG)
    return _errors(measured, "train_rmse")


@query
def f9_statuses(spark, folder):
    """By customer, where many folds are too short for a curve: how often each curve was skipped."""
    target = by_customer(Inputs.of(spark, folder))
    plan = fitting.fold_status(folds.make_folds(target, ["o_custkey"]), ["o_custkey"])
    return plan.groupBy("model", "status").agg(F.count(F.lit(1)).alias("fits"))


@query
def f9_fit_statuses(spark, folder):
    """Every fit asked for has a row and one of the known statuses, and has parameters if it may be used."""
    fits = Inputs.of(spark, folder).fitted.params
    known = F.col("status").isin("ok", "start_values", "skipped", "failed", "not_converged")
    usable = F.col("status").isin("ok", "start_values") == F.col("params").isNotNull()
    return fits.groupBy(*FLAG, "model").agg(F.count(F.lit(1)).alias("fits"), F.bool_and(known & usable).alias("sound"))


# --- metrics ----------------------------------------------------------------------------------------------------------


def _measure(name: str, digits: int) -> Query:
    def run(spark, folder):
        i = Inputs.of(spark, folder)
        scored = predictions.fold_metrics(i.target, i.folds, i.paired, FLAG)
        return tidy(scored.select(*FLAG, "model", "fold", "role", name, "n"), digits)

    return run


QUERIES["a1_rmse"] = _measure("rmse", 3)
QUERIES["a2_mae"] = _measure("mae", 3)
QUERIES["a3_r2"] = _measure("r2", 5)


@query
def a4_fold_summary(spark, folder):
    rows = Inputs.of(spark, folder).curve_metrics
    return tidy(rows.select(*FLAG, "model", "folds", "test_rmse", "test_rmse_std", "test_mae", "test_mae_std", "train_rmse"), 3)


@query
def a5_full_in_sample(spark, folder):
    i = Inputs.of(spark, folder)
    return tidy(averaging.average_metrics(i.average_preds, FLAG), 3, r2=6)


@query
def a6_prediction_summary(spark, folder):
    i = Inputs.of(spark, folder)
    return tidy(metrics.prediction_summary(i.curve_preds, [*FLAG, "model"]), 3)


# --- features ---------------------------------------------------------------------------------------------------------


@query
def x1_time_norm(spark, folder):
    """Test rows of each fold in the time range of its train rows."""
    i = Inputs.of(spark, folder)
    rows = folds.fold_rows(i.target, i.folds, FLAG)
    keys = [*FLAG, "fold"]
    context = features.time_context(rows.where(F.col("role") == "train"), keys)
    timed = features.time_features(rows, context, keys)
    return tidy(timed.select(*keys, "role", "pos", "time_norm"))


@query
def x2_curve_columns(spark, folder):
    i = Inputs.of(spark, folder)
    made = features.curve_features(i.target.select(*FLAG, "pos", "x"), i.paired_full, FLAG)
    return tidy(made.drop("x"), 2)


@query
def x3_time_waves(spark, folder):
    i = Inputs.of(spark, folder)
    timed = features.time_features(i.target.select(*FLAG, "pos", "x"), features.time_context(i.target, FLAG), FLAG)
    return tidy(timed.select(*FLAG, "pos", "time_norm_sin", "time_norm_cos"))


def _features(i: Inputs) -> DataFrame:
    first = averaging.components(i.paired, FLAG, "first_fold")
    return features.make_features(i.target.select(*FLAG, "pos", "x"), first, features.time_context(i.target, FLAG), FLAG)


@query
def x4_features(spark, folder):
    return tidy(_features(Inputs.of(spark, folder)).drop("x"), 2)


@query
def x5_scaled_features(spark, folder):
    made = _features(Inputs.of(spark, folder))
    return tidy(features.scale(made, features.fit_scaler(made, FLAG), FLAG).drop("x"), 5)


# --- tree ensembles ---------------------------------------------------------------------------------------------------


def _sound_measures(rows: DataFrame) -> DataFrame:
    """Mean test measures over all folds: the squared error is no less than the absolute one, R2 is below 1."""
    ordered = (F.col("rmse") >= F.col("mae")) & (F.col("mae") > 0)
    return rows.select(*FLAG, "model", ordered.alias("ordered"), (F.col("r2") < 1).alias("below_one"))


@query
def m1_forest_cv(spark, folder):
    return _sound_measures(Inputs.of(spark, folder).tree_cv.where(F.col("model") == trees.FOREST))


@query
def m2_boosting_cv(spark, folder):
    return _sound_measures(Inputs.of(spark, folder).tree_cv.where(F.col("model") == trees.BOOSTING))


@query
def m3_forest_grid(spark, folder):
    """The forest of the size that the grid search chose averages targets it has seen: no prediction lies outside."""
    i = Inputs.of(spark, folder)
    found = trees.tree_predictions(i.target.select(*FLAG, "pos", "x", "y"), i.trees[trees.FOREST])
    ends = i.target.groupBy(*FLAG).agg(F.max("y").alias("top"))
    seen = i.target.join(ends, FLAG).agg(F.min(F.col("y") / F.col("top")).alias("least"))
    rows = found.join(ends, FLAG).crossJoin(F.broadcast(seen))
    share = F.col("pred") / F.col("top")
    inside = (share >= F.col("least") - 1e-9) & (share <= 1 + 1e-9)
    return rows.groupBy(*FLAG).agg(F.count("pred").alias("weeks"), F.count_if(inside).alias("inside"))


@query
def m4_boosting_grid(spark, folder):
    """The size that the grid search chose is one of the candidates, and its model explains the weeks it has seen."""
    i = Inputs.of(spark, folder)
    model = i.trees[trees.BOOSTING]
    found = trees.tree_predictions(i.target.select(*FLAG, "pos", "x", "y"), model)
    stage = model.tree
    offered = stage.getMaxDepth() in SMALL_TREES.boosting_grid["depth"] and stage.getNumTrees in SMALL_TREES.boosting_grid["trees"]
    scored = metrics.score(found, FLAG)
    weeks = found.groupBy(*FLAG).agg(F.count("pred").alias("weeks")).join(scored, FLAG)
    return weeks.select(*FLAG, "weeks", F.lit(offered).alias("offered"), (F.col("r2") > 0.5).alias("explains"))


@query
def m5_predict(spark, folder):
    i = Inputs.of(spark, folder)
    found = predict_weekly(i.weekly, i.trees[trees.FOREST])
    return found.groupBy(*FLAG).agg(F.count(F.lit(1)).alias("rows"), F.count("predicted_cumulative").alias("weeks"))


@query
def m6_importances(spark, folder):
    long = trees.importances(spark, Inputs.of(spark, folder).trees)
    sums = long.groupBy("model").agg(F.count(F.lit(1)).alias("features"), F.sum("importance").alias("total"), F.min("importance").alias("least"))
    return tidy(sums.select("model", "features", "total", (F.col("least") >= 0).alias("none_negative")))


# --- averaging ensembles ----------------------------------------------------------------------------------------------


@query
def e1_components(spark, folder):
    parts = Inputs.of(spark, folder).parts
    return tidy(parts.select(*FLAG, "model", "fold", F.get("params", F.lit(0)).alias("first_param")), 2)


def _average(name: str) -> Query:
    def run(spark, folder):
        rows = Inputs.of(spark, folder).average_preds.where(F.col("model") == name)
        return tidy(rows.select(*FLAG, "pos", "model", "pred"), 2)

    return run


QUERIES["e2_simple_average"] = _average(averaging.SIMPLE)
QUERIES["e5_weighted_average"] = _average(averaging.BY_R2)
QUERIES["e5_weighted_average_mse"] = _average(averaging.BY_MSE)


@query
def e3_r2_weights(spark, folder):
    return tidy(Inputs.of(spark, folder).weights.select(*FLAG, "model", "r2_weight"))


@query
def e4_mse_weights(spark, folder):
    return tidy(Inputs.of(spark, folder).weights.select(*FLAG, "model", "inv_mse_weight"))


@query
def e6_component_report(spark, folder):
    return tidy(Inputs.of(spark, folder).weights, 5, mse=1)


@query
def e7_combined(spark, folder):
    """Averages and curves as one collection of predictions."""
    i = Inputs.of(spark, folder)
    return tidy(averaging.combine(i.average_preds, i.curve_preds).select(*FLAG, "pos", "y", "model", "pred"), 2)


# --- choice -----------------------------------------------------------------------------------------------------------


@query
def b1_best_model(spark, folder):
    i = Inputs.of(spark, folder)
    return tidy(i.best("Individual").unionByName(i.best("Ensemble")), 5)


@query
def b1_secondary_measure(spark, folder):
    """No model has the first measure: the second one decides."""
    rows = Inputs.of(spark, folder).metrics.withColumn("r2_missing", F.lit(float("-inf")))
    return tidy(selection.best_model(rows, FLAG, "r2_missing", "r2"), 5)


@query
def b2_combined_metrics(spark, folder):
    return tidy(Inputs.of(spark, folder).metrics, 3, r2=5)


@query
def b3_overall_score(spark, folder):
    scored = selection.overall_score(Inputs.of(spark, folder).metrics, FLAG)
    return tidy(scored.select(*FLAG, "model", "overall_score").orderBy(*FLAG, F.desc("overall_score")), 5)


@query
def b4_top_models(spark, folder):
    """The three fold fits with the least error per series."""
    i = Inputs.of(spark, folder)
    tested = predictions.fold_metrics(i.target, i.folds, i.paired, FLAG).where("role = 'test'")
    top = selection.top_per_group(tested.withColumn("closeness", -F.col("rmse")), FLAG, "closeness", 3, ["model"])
    return tidy(top.select(*FLAG, "rank", "model", "fold", "rmse"), 3)


@query
def b5_melt(spark, folder):
    return tidy(selection.melt_metrics(Inputs.of(spark, folder).metrics, [*FLAG, "model"]), 3)


# --- forecast ---------------------------------------------------------------------------------------------------------


@query
def h1_horizon(spark, folder):
    return tidy(Inputs.of(spark, folder).future)


@query
def h2_curve_forecast(spark, folder):
    i = Inputs.of(spark, folder)
    ahead = predictions.curve_predictions(i.future, i.best_params, FLAG)
    return tidy(ahead.select(*FLAG, "pos", "model", "pred"), 2)


@query
def h3_ensemble_forecast(spark, folder):
    return tidy(Inputs.of(spark, folder).best_ensemble_ahead.select(*FLAG, "pos", "model", "pred"), 2)


@query
def h4_noisy_parameters(spark, folder):
    """Mean and spread of the draws of each parameter."""
    drawn = forecast.noisy_params(Inputs.of(spark, folder).best_params, FLAG)
    values = drawn.select(*FLAG, "model", "draw", F.posexplode("params").alias("position", "value"))
    return tidy(values.groupBy(*FLAG, "model", "position").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")), 4)


@query
def h5_interval(spark, folder):
    i = Inputs.of(spark, folder)
    return tidy(forecast.param_noise_interval(i.future, i.best_params, FLAG, draws=1000), 2)


@query
def h6_forecast_table(spark, folder):
    i = Inputs.of(spark, folder)
    interval = forecast.param_noise_interval(i.future, i.best_params, FLAG, draws=1000)
    return tidy(forecast.forecast_table(i.future, i.best_params, i.best_ensemble_ahead, interval, FLAG), 2)


# --- reports ----------------------------------------------------------------------------------------------------------


@query
def r1_coefficients(spark, folder):
    return tidy(reports.coefficient_table(Inputs.of(spark, folder).paired, FLAG), 2)


@query
def r2_standalone_metrics(spark, folder):
    return tidy(reports.standalone_metrics(Inputs.of(spark, folder).curve_metrics, FLAG), 3, **{"R²": 5})


@query
def r3_ensemble_inputs(spark, folder):
    i = Inputs.of(spark, folder)
    return tidy(reports.ensemble_input_table(i.curve_preds, i.average_preds, averaging.SIMPLE, FLAG), 2)


@query
def r4_full_predictions(spark, folder):
    i = Inputs.of(spark, folder)
    return tidy(reports.full_predictions(i.curve_preds, i.average_preds, FLAG, averaging.AVERAGES), 2)


@query
def r5_prediction_summary(spark, folder):
    i = Inputs.of(spark, folder)
    full = reports.full_predictions(i.curve_preds, i.average_preds, FLAG, averaging.AVERAGES)
    return tidy(reports.predictions_summary(full, FLAG), 3)


@query
def r6_weighted_comparison(spark, folder):
    averages = averaging.average_metrics(Inputs.of(spark, folder).average_preds, FLAG)
    return tidy(reports.weighted_comparison(averages, FLAG), 3, **{"R²": 6})


@query
def r7_weighted_parameters(spark, folder):
    i = Inputs.of(spark, folder)
    return tidy(reports.weighted_parameters(i.paired, i.weights, FLAG))


@query
def r8_overall_metrics(spark, folder):
    return tidy(reports.overall_metrics(Inputs.of(spark, folder).metrics, FLAG), 3, **{"R²": 5})


# --- chart data -------------------------------------------------------------------------------------------------------


def _residuals(i: Inputs) -> DataFrame:
    return chartdata.residuals(i.curve_preds)


@query
def d1_residuals(spark, folder):
    return tidy(_residuals(Inputs.of(spark, folder)).select(*FLAG, "model", "pos", "pred", "residual"), 2)


@query
def d2_normal_qq(spark, folder):
    rows = chartdata.normal_qq(_residuals(Inputs.of(spark, folder)), FLAG)
    return tidy(rows, 2, theoretical=6, line_r2=5)


@query
def d3_histogram(spark, folder):
    return tidy(chartdata.residual_histogram(_residuals(Inputs.of(spark, folder)), FLAG), 2)


@query
def d3_density(spark, folder):
    rows = chartdata.residual_density(_residuals(Inputs.of(spark, folder)), FLAG)
    return tidy(rows.select(*FLAG, "model", "point", "residual_at", "scaled"), 3)


@query
def d4_observed_fitted(spark, folder):
    i = Inputs.of(spark, folder)
    return tidy(chartdata.observed_and_fitted(i.folds, i.curve_preds, FLAG), 2)


@query
def d4_single_fit(spark, folder):
    i = Inputs.of(spark, folder)
    observed = chartdata.observed_and_fitted(i.folds, i.curve_preds, FLAG)
    return tidy(chartdata.single_fit(observed, "Gompertz", FLAG).drop("x"), 2)


@query
def d5_ensemble_comparison(spark, folder):
    i = Inputs.of(spark, folder)
    curves = chartdata.observed_and_fitted(i.folds, i.curve_preds, FLAG)
    ensembles = chartdata.observed_and_fitted(i.folds, i.average_preds, FLAG)
    rows = chartdata.ensemble_comparison(ensembles, curves, i.best("Individual"), FLAG)
    return tidy(rows.select(*FLAG, "pos", "split", "model", "plot_order", "pred"), 2)


@query
def d6_validation(spark, folder):
    i = Inputs.of(spark, folder)
    rows = chartdata.validation(i.curve_preds, i.average_preds, i.best("Individual"), i.best("Ensemble"), FLAG)
    return tidy(rows.drop("date"), 2)


@query
def d7_ensemble_diagnostics(spark, folder):
    i = Inputs.of(spark, folder)
    rows = chartdata.ensemble_diagnostics(i.folds, i.average_preds, FLAG)
    return tidy(rows.select(*FLAG, "model", "pos", "pred", "residual"), 2)


@query
def d8_metric_panels(spark, folder):
    return tidy(chartdata.metric_panels(Inputs.of(spark, folder).metrics, FLAG), 3)


@query
def d9_top_importances(spark, folder):
    """Five features, none of which weighs less than any that is left out."""
    long = trees.importances(spark, Inputs.of(spark, folder).trees)
    top = chartdata.top_importances(long, trees.FOREST, 5)
    rest = long.where(F.col("model") == trees.FOREST).join(top.select("feature"), "feature", "left_anti")
    ends = top.groupBy("model").agg(F.count_distinct("rank").alias("ranks"), F.min("importance").alias("least"))
    others = rest.groupBy("model").agg(F.max("importance").alias("most"))
    return ends.join(others, "model").select("model", "ranks", (F.col("least") >= F.col("most")).alias("greatest"))


@query
def d10_weighted_panels(spark, folder):
    averages = averaging.average_metrics(Inputs.of(spark, folder).average_preds, FLAG)
    return tidy(chartdata.weighted_comparison_panels(reports.weighted_comparison(averages, FLAG), FLAG), 3)


@query
def d11_exploratory(spark, folder):
    return tidy(chartdata.exploratory_panels(Inputs.of(spark, folder).weekly, FLAG), 4)


# --- every family on fits that were run to their end --------------------------------------------------------------------


@query
def x_fitted_features(spark, folder):
    """Scaled features of each week: complete, with mean 0, and spread 1 unless constant."""
    i = FittedInputs.of(spark, folder)
    names = features.feature_names()
    rows = features.make_features(i.target.select(*FLAG, "pos", "x"), i.parts, features.time_context(i.target, FLAG), FLAG)
    scaled = features.scale(rows, features.fit_scaler(rows, FLAG), FLAG)
    complete = F.count_if(reduce(and_, (F.col(n).isNotNull() for n in names)))
    centred = reduce(and_, (F.abs(F.avg(n)) < 1e-6 for n in names))
    spread = reduce(and_, ((F.abs(F.stddev_pop(n) - 1) < 1e-6) | (F.min(n) == F.max(n)) for n in names))
    return scaled.groupBy(*FLAG).agg(F.count(F.lit(1)).alias("weeks"), complete.alias("complete"), (centred & spread).alias("standard"))


@query
def a_fitted_measures(spark, folder):
    """Fold measures per curve: rows scored in either role, and measures that agree with each other."""
    i = FittedInputs.of(spark, folder)
    scored = predictions.fold_metrics(i.target, i.folds, i.paired, FLAG)
    agree = (F.col("rmse") >= F.col("mae") - 1e-9) & (F.col("mae") >= 0) & (F.col("r2") <= 1)
    rows = {role: F.sum(F.when(F.col("role") == role, F.col("n"))).alias(f"{role}_rows") for role in ("train", "test")}
    return scored.groupBy(*FLAG, "model").agg(*rows.values(), F.min(agree).alias("agree"))


@query
def e_fitted_weights(spark, folder):
    """Weights of the components add to 1, and the best component by a measure has the greatest weight by it."""
    weights = FittedInputs.of(spark, folder).weights
    by_r2 = F.max_by("r2_weight", "r2") == F.max("r2_weight")
    by_mse = F.min_by("inv_mse_weight", "mse") == F.max("inv_mse_weight")
    sums = [F.round(F.sum(w), 9).alias(w) for w in ("r2_weight", "inv_mse_weight")]
    return weights.groupBy(*FLAG).agg(F.count(F.lit(1)).alias("components"), *sums, (by_r2 & by_mse).alias("ordered"))


@query
def e_fitted_averages(spark, folder):
    """No average lies outside what its components predict."""
    i = FittedInputs.of(spark, folder)
    each = predictions.curve_predictions(i.target.select(*FLAG, "pos", "x"), i.parts, FLAG)
    ends = each.groupBy(*FLAG, "pos").agg(F.min("pred").alias("low"), F.max("pred").alias("high"))
    slack = F.lit(1e-9) * F.greatest(F.abs("low"), F.abs("high"), F.lit(1.0))
    inside = F.col("pred").between(F.col("low") - slack, F.col("high") + slack)
    rows = i.average_preds.join(ends, [*FLAG, "pos"])
    return rows.groupBy(*FLAG, "model").agg(F.count("pred").alias("weeks"), F.count_if(inside).alias("inside"))


@query
def b_fitted_best(spark, folder):
    """The chosen curve and the chosen average have the greatest score of their kind."""
    i = FittedInputs.of(spark, folder)
    chosen = combine(*[i.best(kind).withColumn("type", F.lit(kind)) for kind in ("Individual", "Ensemble")])
    rows = i.metrics.join(chosen, [*FLAG, "type"])
    own = F.max(F.when(F.col("model") == F.col("best_model"), F.col("r2")))
    greatest = (own == F.max("r2")) & (F.max("best_score") == F.max("r2"))
    return rows.groupBy(*FLAG, "type").agg(F.count("r2").alias("models"), greatest.alias("greatest"))


@query
def h_fitted_forecast(spark, folder):
    """Weeks ahead with whole rows, and with bounds in order."""
    i = FittedInputs.of(spark, folder)
    interval = forecast.param_noise_interval(i.future, i.best_params, FLAG, draws=1000)
    table = forecast.forecast_table(i.future, i.best_params, i.best_ensemble_ahead, interval, FLAG)
    whole = F.col("best_model_forecast").isNotNull() & F.col("best_ensemble_forecast").isNotNull()
    ordered = F.count_if(F.col("lower_bound_ci") <= F.col("upper_bound_ci"))
    return table.groupBy(*FLAG).agg(F.count("date").alias("weeks"), F.count_if(whole).alias("whole"), ordered.alias("ordered"))


@query
def r_fitted_reports(spark, folder):
    """Rows per series in each report, and values in them."""
    i = FittedInputs.of(spark, folder)
    full = reports.full_predictions(i.curve_preds, i.average_preds, FLAG, averaging.AVERAGES)
    tables = {
        "coefficients": (reports.coefficient_table(i.paired, FLAG), "Value"),
        "standalone": (reports.standalone_metrics(i.curve_metrics, FLAG), "RMSE"),
        "full": (full, "Richards_Pred"),
        "summary": (reports.predictions_summary(full, FLAG), "mean_predicted"),
        "comparison": (reports.weighted_comparison(averaging.average_metrics(i.average_preds, FLAG), FLAG), "RMSE"),
        "parameters": (reports.weighted_parameters(i.paired, i.weights, FLAG), "Growth_Rate_Value"),
        "overall": (reports.overall_metrics(i.metrics, FLAG), "RMSE"),
    }
    counted = [t.groupBy(*FLAG).agg(F.lit(n).alias("report"), F.count(F.lit(1)).alias("rows"), F.count(f"`{c}`").alias("values")) for n, (t, c) in tables.items()]
    return combine(*counted)


@query
def d_fitted_charts(spark, folder):
    """Every residual is in one bin and at one place of the normal plot; the density has all its points and at most mass 1."""
    i = FittedInputs.of(spark, folder)
    resid, by = _residuals(i), [*FLAG, "model"]
    bins = chartdata.residual_histogram(resid, FLAG).groupBy(*by).agg(F.sum("count").alias("binned"))
    density = chartdata.residual_density(resid, FLAG)
    mass = F.avg("density") * (F.max("residual_at") - F.min("residual_at"))
    density = density.groupBy(*by).agg(F.count("density").alias("points"), mass.between(0.5, 1.05).alias("mass"))
    plot = chartdata.normal_qq(resid, FLAG).groupBy(*by).agg(F.count("theoretical").alias("placed"))
    rows = resid.groupBy(*by).agg(F.count("residual").alias("residuals"))
    return rows.join(bins, by).join(plot, by).join(density, by)
