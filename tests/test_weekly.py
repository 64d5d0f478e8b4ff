import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from growthpanel.operators.weekly import add_calendar_columns, fill_calendar, resample_weeks, weekly_panel
from growthpanel.sources.records import select_records

SCHEMA = "sid string, ts timestamp, number double, cumulative double"


def _records(spark, rows):
    return spark.createDataFrame([(k, dt.datetime.fromisoformat(t), n, c) for k, t, n, c in rows], SCHEMA)


def test_weeks_end_on_sunday_whatever_the_time_of_day(spark):
    rows = [
        ("a", "2024-01-07T23:59:59", 1.0, 1.0),  # Sunday
        ("a", "2024-01-08T00:00:00", 2.0, 3.0),  # Monday
        ("a", "2024-01-14T12:00:00", 4.0, 7.0),
    ]
    weeks = {str(r["date"]): (r["number"], r["cumulative"]) for r in resample_weeks(_records(spark, rows), ["sid"]).collect()}
    assert weeks == {"2024-01-07": (1.0, 1.0), "2024-01-14": (6.0, 7.0)}


def test_last_cumulative_is_the_last_that_is_present(spark):
    rows = [
        ("a", "2024-01-01T00:00:00", 1.0, 9.0),
        ("a", "2024-01-02T00:00:00", 1.0, 5.0),
        ("a", "2024-01-03T00:00:00", 1.0, None),
    ]
    records = _records(spark, rows)
    assert resample_weeks(records, ["sid"]).first()["cumulative"] == 5.0
    ordered = records.selectExpr("*", "cast(-number as bigint) as row_order")
    assert resample_weeks(ordered, ["sid"]).first()["cumulative"] == 5.0


def test_row_order_decides_between_equal_times(spark):
    rows = [("a", "2024-01-01T00:00:00", 1.0, 9.0), ("a", "2024-01-01T00:00:00", 2.0, 5.0)]
    ordered = _records(spark, rows).selectExpr("*", "cast(number as bigint) as row_order")
    assert resample_weeks(ordered, ["sid"]).first()["cumulative"] == 5.0
    assert resample_weeks(_records(spark, rows), ["sid"]).first()["cumulative"] == 9.0


def test_gap_weeks_have_no_count_and_keep_the_total(spark):
    rows = [("a", "2024-01-01T00:00:00", 1.0, 10.0), ("a", "2024-01-24T00:00:00", 2.0, 12.0), ("b", "2024-01-01T00:00:00", 7.0, 7.0)]
    weeks = fill_calendar(resample_weeks(_records(spark, rows), ["sid"]), ["sid"])
    assert [(r["number"], r["cumulative"]) for r in weeks.where("sid = 'a'").orderBy("date").collect()] == [
        (1.0, 10.0), (0.0, None), (0.0, None), (2.0, 12.0),
    ]
    panel = weekly_panel(_records(spark, rows), ["sid"]).where("sid = 'a'").orderBy("date").collect()
    assert [r["cumulative"] for r in panel] == [10.0, 10.0, 10.0, 12.0]
    assert [r["rolling_mean_4w"] for r in panel] == [0.75] * 4
    assert [r["rolling_mean_12w"] for r in panel] == [None] * 4
    assert [r["time_idx"] for r in panel] == [0.0, 1.0, 2.0, 3.0]


def test_single_row_and_leading_missing_total(spark):
    one = weekly_panel(_records(spark, [("a", "2024-01-01T00:00:00", 1.0, 1.0)]), ["sid"]).first()
    assert (one["time_idx"], one["pos"]) == (0.0, 0)
    rows = [("a", "2024-01-01T00:00:00", 1.0, None), ("a", "2024-01-09T00:00:00", 1.0, 4.0)]
    assert [r["cumulative"] for r in weekly_panel(_records(spark, rows), ["sid"]).orderBy("date").collect()] == [4.0, 4.0]


def test_same_as_pandas_on_orders(spark):
    path = "/root/testdata/sf0.001/orders.parquet"
    records = select_records(spark.read.parquet(path), [], "o_orderdate", "o_totalprice", "o_orderkey")
    found = weekly_panel(records, [], 2).orderBy("date").toPandas()

    raw = pd.read_parquet(path).sort_values(["o_orderdate", "o_orderkey"]).set_index("o_orderdate")
    weeks = raw.resample("W").agg({"o_totalprice": "sum", "o_orderkey": "last"}).reset_index()
    for n in (4, 12):
        weeks[f"m{n}"] = weeks["o_totalprice"].rolling(n).mean()
    weeks = weeks.ffill().bfill()
    assert list(pd.to_datetime(found["date"])) == list(weeks["o_orderdate"])
    for ours, theirs in (("number", "o_totalprice"), ("cumulative", "o_orderkey"), ("rolling_mean_4w", "m4"), ("rolling_mean_12w", "m12")):
        assert (found[ours] - weeks[theirs]).abs().max() < 1e-6
    assert list(found["month"]) == list(weeks["o_orderdate"].dt.month)
    assert list(found["quarter"]) == list(weeks["o_orderdate"].dt.quarter)


def test_result_does_not_depend_on_partitioning(spark):
    records = select_records(
        spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet"), ["l_returnflag"], "l_shipdate", "l_extendedprice", None
    )
    one = weekly_panel(records.coalesce(1), ["l_returnflag"], 2)
    many = weekly_panel(records.repartition(13), ["l_returnflag"], 2)
    assert one.exceptAll(many).isEmpty() and many.exceptAll(one).isEmpty()


def test_raw_rows_meet_only_hash_aggregation(spark):
    lineitem = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    records = select_records(lineitem, ["l_returnflag"], "l_shipdate", "l_quantity", "l_tax", order_by="l_orderkey")
    plan = resample_weeks(records, ["l_returnflag"])._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and plan.count("Exchange") == 1 and "Window" not in plan


def test_a_clock_change_does_not_reorder_rows(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        rows = spark.sql(
            "SELECT 'a' AS sid, CAST(t AS TIMESTAMP_NTZ) AS ts, 1.0D AS number, c AS cumulative, CAST(c AS BIGINT) AS row_order "
            "FROM VALUES ('2024-03-10 02:30:00', 10.0D), ('2024-03-10 03:00:00', 20.0D) AS v(t, c)"
        )
        assert resample_weeks(rows, ["sid"]).first()["cumulative"] == 20.0
        assert resample_weeks(rows.drop("row_order"), ["sid"]).first()["cumulative"] == 20.0
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_raw_rows_are_combined_before_the_only_exchange(spark):
    records = _records(spark, [("a", "2024-01-01T00:00:00", 1.0, 9.0)])
    plan = resample_weeks(records, ["sid"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "partial_sum" in plan.split("Exchange hashpartitioning")[1]


def test_panel_equals_its_steps(spark):
    """Counts and positions come from the weeks with records; the calendar's weeks are as if filled one by one."""
    rows = [
        ("a", "2024-01-01T00:00:00", 1.0, None), ("a", "2024-01-24T00:00:00", 2.0, 12.0), ("a", "2024-04-24T00:00:00", 2.0, None),
        ("a", "2024-05-24T00:00:00", 3.0, 11.0), ("b", "2024-01-01T00:00:00", 7.0, 7.0), ("c", "2024-02-01T00:00:00", None, None),
        ("c", "2024-03-01T00:00:00", 1.0, None),
    ]
    for records in (_records(spark, rows), _records(spark, rows).drop("cumulative")):
        panel = weekly_panel(records, ["sid"])
        steps = add_calendar_columns(fill_calendar(resample_weeks(records, ["sid"]), ["sid"]), ["sid"])
        assert panel.schema == steps.schema
        assert sorted(map(str, panel.collect())) == sorted(map(str, steps.collect()))


def test_weeks_are_sorted_in_all_shuffle_partitions(spark):
    """Few records make many weeks: before, adaptive execution put all these series into one task."""
    records = spark.range(400).selectExpr("id % 200 AS sid", "timestamp'2000-01-01' + make_interval(0, 0, 52 * (id div 200) * 10) AS ts", "1.0D AS number")
    panel = weekly_panel(records, ["sid"])
    assert panel.count() == 200 * 521
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert panel.groupBy(F.spark_partition_id()).count().count() == parts
