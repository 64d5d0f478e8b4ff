import pytest

from growthpanel.sources.records import CORRUPT, MISSING_KEY, read_table, reject_table, rejected_records, select_records

CSV = "date,enrollment_cleaned,cumulative,note\n2007-01-03,4,4,a\n2007-01-04,6,10,b\n"


def _csv(tmp_path, text):
    path = tmp_path / "in.csv"
    path.write_text(text)
    return str(path)


def test_csv_keeps_and_renames_three_columns(spark, tmp_path):
    records = select_records(read_table(spark, _csv(tmp_path, CSV)))
    assert records.columns == ["ts", "number", "cumulative", "series"]
    assert [(r["number"], r["cumulative"]) for r in records.orderBy("ts").collect()] == [(4.0, 4.0), (6.0, 10.0)]


def test_missing_file_and_missing_column_are_named(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="nowhere"):
        read_table(spark, str(tmp_path / "nowhere.csv"))
    with pytest.raises(ValueError, match="cumulative"):
        select_records(read_table(spark, _csv(tmp_path, "date,enrollment_cleaned\n2007-01-03,1\n")))


def test_strict_fails_on_a_bad_date_and_permissive_counts_it(spark, tmp_path):
    table = read_table(spark, _csv(tmp_path, CSV + "someday,1,11,c\n"))
    with pytest.raises(Exception, match="unreadable date: someday"):
        select_records(table).collect()
    kept = select_records(table, mode="permissive").collect()
    assert sum(r["ts"] is None for r in kept) == 1
    assert rejected_records(table, "date").first()["rejected"] == 1


def test_lines_with_too_few_or_too_many_fields(spark, tmp_path):
    path = _csv(tmp_path, CSV + "2007-01-05,1\n2007-01-06,1,12,c,d\nsomeday,x,,c\n")
    strict = read_table(spark, path)
    for read in (strict.count, strict.select("date").collect, select_records(strict, mode="permissive").count):
        with pytest.raises(Exception, match="line with a wrong number of fields: 2007-01-0"):
            read()
    table = read_table(spark, path, mode="permissive")
    assert table.columns[-1] == CORRUPT and table.count() == 5
    with pytest.raises(Exception, match="wrong number of fields"):
        select_records(table).collect()
    kept = select_records(table, mode="permissive").orderBy("ts").collect()
    assert [(r["number"], r["cumulative"]) for r in kept] == [(None, None), (4.0, 4.0), (6.0, 10.0)]
    rejects = reject_table(table)
    assert rejects.columns == ["date", "enrollment_cleaned", "cumulative", "note", "reason", "value"]
    assert sorted((r["reason"], r["value"]) for r in rejects.collect()) == [
        ("corrupt_line", "2007-01-05,1"), ("corrupt_line", "2007-01-06,1,12,c,d"),
        ("unreadable_date", "someday"), ("unreadable_enrollment_cleaned", "x"),
    ]
    with pytest.raises(ValueError, match="mode"):
        read_table(spark, path, mode="lax")


def test_date_format_and_bad_number(spark, tmp_path):
    table = read_table(spark, _csv(tmp_path, "date,enrollment_cleaned,cumulative\n03/01/2007,x,4\n"))
    with pytest.raises(Exception, match="unreadable enrollment_cleaned: x"):
        select_records(table, date_format="dd/MM/yyyy").collect()
    row = select_records(table, date_format="dd/MM/yyyy", mode="permissive").first()
    assert str(row["ts"])[:10] == "2007-01-03" and row["number"] is None


def test_nan_becomes_null_and_missing_text_keys_get_a_label(spark):
    df = spark.createDataFrame(
        [(None, "2007-01-03", float("nan"), 1.0)], "sid string, date string, enrollment_cleaned double, cumulative double"
    )
    row = select_records(df, ["sid"]).first()
    assert row["sid"] == MISSING_KEY and row["number"] is None
    numbered = df.selectExpr("cast(sid as int) as sid", "date", "enrollment_cleaned", "cumulative")
    with pytest.raises(Exception, match="key column sid is NULL"):
        select_records(numbered, ["sid"]).collect()


def test_keys_that_clash_with_internal_columns_are_refused(spark):
    df = spark.createDataFrame([("a", "2007-01-03", 1.0, 1.0)], "model string, date string, enrollment_cleaned double, cumulative double")
    with pytest.raises(ValueError, match="model"):
        select_records(df, ["model"])
