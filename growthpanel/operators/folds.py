"""Target repair and gapped expanding-window cross-validation folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from growthpanel.functions.columns import check_key_names, require, with_keys
from growthpanel.operators.weekly import fill_missing

#: fold number of fits and metrics that use the whole series
FULL = -1


def validate_panel(weekly: DataFrame) -> None:
    """Raise unless the weekly table can be trained on."""
    require(weekly, ["time_idx", "cumulative"], "the weekly table")
    if weekly.isEmpty():
        raise ValueError("the weekly table has no rows")


def prepare_target(weekly: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Columns keys, date, pos, x, y, status: gaps filled, then the running maximum of the cumulative count.

    A series whose target is still missing or infinite gets ``status='invalid_target'`` instead of ending the run.
    """
    check_key_names(keys)
    require(weekly, ["time_idx", "cumulative", "pos"], "the weekly table")
    weekly, keys = with_keys(weekly, keys)
    ordered = Window.partitionBy(*keys).orderBy("pos")
    filled = fill_missing(weekly, ["cumulative"], keys, order="pos")
    target = F.col("cumulative")
    bad = F.max(target.isNull() | (F.abs(target) == F.lit(float("inf")))).over(Window.partitionBy(*keys))
    peak = F.max(target).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    return filled.select(
        *keys,
        "date",
        "pos",
        F.col("time_idx").alias("x"),
        peak.alias("y"),
        F.when(bad, F.lit("invalid_target")).otherwise(F.lit("ok")).alias("status"),
    )


def split_count(n: Column, n_splits: int = 5) -> Column:
    """Number of folds for a series of ``n`` weeks: fewer when it is short.

    Fixed values: at least 4 weeks per part, series under 52 weeks are short, under 10 very short.
    """
    k = F.lit(n_splits)
    quarter = F.floor(n / F.lit(4)).cast("int")
    short = (
        F.when((n < 10) & (k > 2), F.lit(2))
        .when((k > quarter) & (quarter > 1), F.greatest(F.lit(2), quarter))
        .otherwise(k)
    )
    k = F.when(n < 52, short).otherwise(k)
    k = F.when(k >= n, F.greatest(F.lit(2), n - 1)).otherwise(k)
    thin = (F.floor(n / (k + 1)) < 4) & (k > 2)
    fewer = F.greatest(F.lit(2), quarter - 1)
    fewer = F.when(fewer >= n, F.greatest(F.lit(2), n - 1)).otherwise(fewer)
    k = F.when(thin, fewer).otherwise(k)
    lowest = F.when(F.lit(2) >= n, F.when(n > 1, n - 1)).otherwise(F.lit(2))
    return F.when(k < 2, lowest).otherwise(k).cast("int")


def fold_plan(target: DataFrame, keys: Sequence[str] = (), n_splits: int = 5, gap: int = 4) -> DataFrame:
    """One row per series: weeks ``n``, folds ``k``, test block length ``block`` and a status."""
    target, keys = with_keys(target, keys)
    sizes = target.groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("n"), F.bool_and(F.col("status") == "ok").alias("valid"))
    planned = sizes.withColumn("k", split_count(F.col("n"), n_splits))
    planned = planned.withColumn("block", F.floor(F.col("n") / (F.col("k") + 1)).cast("int"))
    fits = (F.col("k") < F.col("n")) & (F.col("n") - gap - F.col("k") * F.col("block") > 0)
    return planned.select(
        *keys,
        "n",
        "k",
        "block",
        F.when(~F.col("valid"), F.lit("invalid_target"))
        .when(fits, F.lit("ok"))
        .otherwise(F.lit("too_few_rows"))
        .alias("status"),
    )


def make_folds(target: DataFrame, keys: Sequence[str] = (), n_splits: int = 5, gap: int = 4) -> DataFrame:
    """Half-open row ranges: train [0, train_end), test [test_start, test_end). Series too short have no row."""
    plan = fold_plan(target, keys, n_splits, gap)
    keys = with_keys(target, keys)[1]
    ready = plan.where(F.col("status") == "ok")
    folds = ready.withColumn("fold", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    start = F.col("n") - (F.col("k") - F.col("fold")) * F.col("block")
    return folds.select(
        *keys,
        F.col("fold").cast("int").alias("fold"),
        F.col("n"),
        F.col("k"),
        (start - gap).cast("int").alias("train_end"),
        start.cast("int").alias("test_start"),
        (start + F.col("block")).cast("int").alias("test_end"),
    )


def fold_rows(target: DataFrame, folds: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rows of each fold with ``role`` train or test; the gap and later weeks are in neither.

    Both sides are dealt by series: there are several folds a series, too many to broadcast, and groups by series
    need no shuffle afterwards.
    """
    target, keys = with_keys(target, keys)
    role = F.when(F.col("pos") < F.col("train_end"), F.lit("train")).when(
        (F.col("pos") >= F.col("test_start")) & (F.col("pos") < F.col("test_end")), F.lit("test")
    )
    joined = target.join(folds.drop("n").hint("shuffle_hash"), keys).withColumn("role", role)
    return joined.where(F.col("role").isNotNull())


def with_last_fold_role(rows: DataFrame, folds: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rows (keys, pos, ...) with their ``role`` in the last fold, train, test or NULL, and ``no_folds``: all rows train.

    The role follows from ``pos`` and one row per series.
    """
    rows, keys = with_keys(rows, keys)
    last = folds.where(F.col("fold") == F.col("k") - 1).select(*keys, "train_end", "test_start", "test_end")
    no_folds = F.col("train_end").isNull()
    role = (
        F.when(no_folds | (F.col("pos") < F.col("train_end")), F.lit("train"))
        .when((F.col("pos") >= F.col("test_start")) & (F.col("pos") < F.col("test_end")), F.lit("test"))
    )
    joined = rows.join(last.hint("shuffle_hash"), keys, "left").withColumns({"role": role, "no_folds": no_folds})
    return joined.drop("train_end", "test_start", "test_end")


def last_fold_rows(target: DataFrame, folds: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Last fold's train and test rows; a series without folds has all rows as train and none as test."""
    return with_last_fold_role(target, folds, keys).where(F.col("role").isNotNull()).drop("no_folds")
