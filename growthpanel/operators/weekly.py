"""Gap-free weekly series from dated records.

Raw rows meet one aggregation by series and week, which combines before the shuffle, so a key with a third of all rows
costs one partial row per task and week. Ordered windows run afterwards, on weeks: their groups are as long as the
calendar, whatever the size of the input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from growthpanel.functions.columns import require, with_keys


def week_end(ts: Column) -> Column:
    """The Sunday that closes the week of ``ts``; any time on a Sunday belongs to that same day."""
    return F.next_day(F.date_sub(F.to_date(ts), 1), "SUN")


def _rounded(value: Column, scale: int | None) -> Column:
    return value if scale is None else F.round(value, scale)


def _micros(df: DataFrame) -> Column:
    """Time as a number: of a timestamp without zone its wall time, whatever the session's zone and its clock changes."""
    if isinstance(df.schema["ts"].dataType, T.TimestampNTZType):
        # by its fields: functions of two timestamps would first give it the session's zone
        seconds = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.expr("extract(SECOND FROM ts)")
        return F.unix_date(F.to_date("ts")).cast("long") * 86_400_000_000 + (seconds * 1_000_000).cast("long")
    return F.unix_micros(F.col("ts").cast("timestamp"))


def _time_order(df: DataFrame) -> Column:
    """(ts, row_order) as one decimal: a struct would force sort-based aggregation of the raw rows."""
    # 10^19 exceeds every bigint, so the time always decides first
    micros = _micros(df).cast("decimal(38,0)") * F.lit("10000000000000000000").cast("decimal(38,0)")
    return micros + F.col("row_order").cast("decimal(38,0)")


def resample_weeks(records: DataFrame, keys: Sequence[str] = (), scale: int | None = None) -> DataFrame:
    """Sum of ``number`` and last non-null ``cumulative`` of each week that has records.

    ``scale`` rounds sums to the number of decimals in the data, which makes them independent of the order of
    addition. Without a ``cumulative`` column the running total of the weekly sums takes its place.
    Rows of one timestamp are ordered by ``row_order`` if present, else the largest ``cumulative`` counts as last.
    """
    require(records, ["ts", "number"], "the records")
    records, keys = with_keys(records, keys)
    dated = records.where(F.col("ts").isNotNull()).withColumn("date", week_end(F.col("ts")))
    total = F.coalesce(_rounded(F.sum("number"), scale), F.lit(0.0)).alias("number")
    if "cumulative" not in records.columns:
        weeks = _dealt(dated.groupBy(*keys, "date").agg(total), keys)
        running = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
        return weeks.withColumn("cumulative", _rounded(F.sum("number").over(running), scale))
    present = F.col("cumulative").isNotNull()
    if "row_order" in records.columns:
        last = F.max_by("cumulative", F.when(present, _time_order(dated)))
        return dated.groupBy(*keys, "date").agg(total, last.alias("cumulative"))
    # sorts locally, as the maximum of a struct does, but combines before the shuffle: one partial row per task and week
    last = F.max(F.when(present, F.struct("ts", "cumulative")))["cumulative"]
    return dated.groupBy(*keys, "date").agg(total, last.alias("cumulative"))


def _dealt(weeks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Weeks by series in all of the session's shuffle partitions.

    Adaptive execution would merge them by the bytes of the weeks that have records, and a task would then sort the many
    more weeks that the calendar makes of them.
    """
    return weeks.repartition(int(weeks.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _spread(weeks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each week and the empty ones up to the next: number 0, cumulative NULL. Other columns go on from week to week."""
    following = F.lead("date").over(Window.partitionBy(*keys).orderBy("date"))
    until = F.coalesce(F.date_sub("next_date", 7), F.col("date"))
    carried = [c for c in weeks.columns if c not in (*keys, "date", "number", "cumulative")]
    spread = weeks.withColumn("next_date", following).select(
        *keys,
        F.col("date").alias("own_date"),
        "number",
        "cumulative",
        *carried,
        F.explode(F.sequence(F.col("date"), until, F.expr("INTERVAL 7 DAYS"))).alias("date"),
    )
    own = F.col("date") == F.col("own_date")
    return spread.select(
        *keys,
        "date",
        F.when(own, F.col("number")).otherwise(F.lit(0.0)).alias("number"),
        F.when(own, F.col("cumulative")).alias("cumulative"),
        *carried,
    )


def fill_calendar(weeks: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Add the weeks without records: number 0, cumulative NULL.

    Each week yields itself and the empty weeks up to the next one, so there is no calendar table and no join.
    """
    weeks, keys = with_keys(weeks, keys)
    rows = weeks.select(*keys, "date", "number", "cumulative")
    return _spread(_dealt(rows, keys), keys)


def rolling_mean(value: str, rows: int, keys: Sequence[str]) -> Column:
    """Mean of the last ``rows`` weeks, NULL until there are that many."""
    frame = Window.partitionBy(*keys).orderBy("date").rowsBetween(-(rows - 1), 0)
    return F.when(F.count(F.col(value)).over(frame) == rows, F.avg(value).over(frame))


def fill_missing(df: DataFrame, columns: Sequence[str], keys: Sequence[str], order: str = "date") -> DataFrame:
    """Carry values forward, then give leading gaps the first value of the series.

    After the forward fill only leading rows are empty, so the backward fill is one value per series.
    """
    ordered = Window.partitionBy(*keys).orderBy(order)
    before = ordered.rowsBetween(Window.unboundedPreceding, 0)
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumns(
        {c: F.coalesce(F.last(c, ignorenulls=True).over(before), F.first(c, ignorenulls=True).over(whole)) for c in columns}
    )


def add_calendar_columns(weeks: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rolling means, month and quarter of the week's Sunday, weeks since the start, row position; gaps filled."""
    weeks, keys = with_keys(weeks, keys)
    whole = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    position = F.row_number().over(Window.partitionBy(*keys).orderBy("date")) - 1
    elapsed = F.datediff(F.col("date"), F.first("date").over(whole)) / F.lit(7.0)
    columns = _calendar_columns(weeks, keys, F.coalesce(elapsed, position.cast("double")), position)
    return fill_missing(columns, ["cumulative", "rolling_mean_4w", "rolling_mean_12w"], keys)


def _calendar_columns(weeks: DataFrame, keys: Sequence[str], time_idx: Column, position: Column) -> DataFrame:
    return weeks.select(
        *keys,
        "date",
        "number",
        "cumulative",
        rolling_mean("number", 4, keys).alias("rolling_mean_4w"),
        rolling_mean("number", 12, keys).alias("rolling_mean_12w"),
        F.month("date").cast(T.IntegerType()).alias("month"),
        F.quarter("date").cast(T.IntegerType()).alias("quarter"),
        time_idx.alias("time_idx"),
        position.cast(T.IntegerType()).alias("pos"),
    )


def weekly_panel(records: DataFrame, keys: Sequence[str] = (), scale: int | None = None) -> DataFrame:
    """Records to the weekly table: resample, fill the calendar, derive columns, fill gaps.

    The same as ``add_calendar_columns(fill_calendar(...))``. Counts are filled and positions counted on the weeks that
    have records, before the calendar makes many more of them: without the rolling means no week is sorted again.
    """
    records, keys = with_keys(records, keys)
    weeks = _dealt(resample_weeks(records, keys, scale), keys)
    first = F.min("date").over(Window.partitionBy(*keys))
    weeks = fill_missing(weeks.withColumn("filled", F.col("cumulative")), ["filled"], keys).withColumn("first_date", first)
    rows = _spread(weeks, keys).withColumn("cumulative", F.col("filled"))
    elapsed = F.datediff("date", "first_date") / F.lit(7.0)
    elapsed, position = F.coalesce(elapsed, F.lit(0.0)), F.coalesce(elapsed.cast("int"), F.lit(0))  # no date is null, which Spark can't tell
    return fill_missing(_calendar_columns(rows, keys, elapsed, position), ["rolling_mean_4w", "rolling_mean_12w"], keys)
