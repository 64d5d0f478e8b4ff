import pytest

from growthpanel.operators.folds import fold_plan, fold_rows, last_fold_rows, make_folds, prepare_target, validate_panel


def _rule(n: int, k: int = 5):
    """The fold rule in plain Python: (splits, ranges), or None where it cannot be applied."""
    if n < 52:
        if n < 10 and k > 2:
            k = 2
        elif k > n // 4 > 1:
            k = max(2, n // 4)
    if k >= n:
        k = max(2, n - 1)
    if n // (k + 1) < 4 and k > 2:
        k = max(2, n // 4 - 1)
        if k >= n:
            k = max(2, n - 1)
    block = n // (k + 1)
    if k + 1 > n or n - 4 - k * block <= 0:
        return None
    starts = [n - (k - i) * block for i in range(k)]
    return k, [(s - 4, s, s + block) for s in starts]


def _target(spark, sizes):
    rows = [(n, p, float(p), float(p)) for n in sizes for p in range(n)]
    weekly = spark.createDataFrame(rows, "series int, pos int, time_idx double, cumulative double")
    return prepare_target(weekly.selectExpr("*", "date_add(DATE'2020-01-05', 7 * pos) as date"), ["series"])


def test_fold_rule_for_short_and_long_series(spark):
    sizes = [*range(2, 61), 887]
    target = _target(spark, sizes)
    found: dict[int, list] = {}
    for r in make_folds(target, ["series"]).collect():
        found.setdefault(r["series"], []).append((r["fold"], r["k"], r["train_end"], r["test_start"], r["test_end"]))
    for n in sizes:
        expected = _rule(n)
        if expected is None:
            assert n not in found
        else:
            k, ranges = expected
            assert sorted(found[n]) == [(i, k, *r) for i, r in enumerate(ranges)]
    assert [f[2] for f in sorted(found[887])] == [148, 295, 442, 589, 736]
    assert 11 in found and 13 in found and 10 not in found and 12 not in found


def test_status_of_series_without_folds(spark):
    target = _target(spark, [12, 60])
    assert {r["series"]: r["status"] for r in fold_plan(target, ["series"]).collect()} == {12: "too_few_rows", 60: "ok"}


def test_roles_leave_out_the_gap(spark):
    target = _target(spark, [60])
    folds = make_folds(target, ["series"])
    rows = fold_rows(target, folds, ["series"]).where("fold = 0").orderBy("pos").collect()
    train, test = [[r["pos"] for r in rows if r["role"] == role] for role in ("train", "test")]
    assert train == list(range(6)) and test == list(range(10, 20))


def test_last_fold_falls_back_to_all_rows_as_train(spark):
    target = _target(spark, [5, 60])
    rows = last_fold_rows(target, make_folds(target, ["series"]), ["series"])
    counts = {(r["series"], r["role"]): r["count"] for r in rows.groupBy("series", "role").count().collect()}
    assert counts == {(5, "train"): 5, (60, "train"): 46, (60, "test"): 10}


def test_target_is_filled_monotone_and_checked(spark):
    rows = [
        ("a", 0, None), ("a", 1, 3.0), ("a", 2, 2.0), ("a", 3, None), ("a", 4, 5.0),
        ("inf", 0, 1.0), ("inf", 1, float("inf")), ("none", 0, None), ("neg", 0, -3.0), ("neg", 1, -4.0),
    ]
    weekly = spark.createDataFrame(rows, "sid string, pos int, cumulative double").selectExpr(
        "*", "cast(pos as double) as time_idx", "date_add(DATE'2020-01-05', 7 * pos) as date"
    )
    target = prepare_target(weekly, ["sid"])
    status = {r["sid"]: r["status"] for r in target.select("sid", "status").distinct().collect()}
    assert status == {"a": "ok", "inf": "invalid_target", "none": "invalid_target", "neg": "ok"}
    assert [r["y"] for r in target.where("sid = 'a'").orderBy("pos").collect()] == [3.0, 3.0, 3.0, 3.0, 5.0]
    assert [r["y"] for r in target.where("sid = 'neg'").orderBy("pos").collect()] == [-3.0, -3.0]


def test_validation(spark):
    with pytest.raises(ValueError, match="time_idx"):
        validate_panel(spark.range(1).selectExpr("1.0 as cumulative"))
    with pytest.raises(ValueError, match="no rows"):
        validate_panel(spark.range(0).selectExpr("1.0 as cumulative", "1.0 as time_idx"))


def test_folds_are_not_broadcast(spark):
    """There are several folds a series: before, they were sent to the driver, and groups by series shuffled afterwards."""
    target = spark.range(2000).selectExpr("id % 40 AS sid", "cast(id div 40 AS int) AS pos", "1.0D AS x", "1.0D AS y", "'ok' AS status")
    folds = make_folds(target, ["sid"]).checkpoint()
    for rows in (fold_rows(target, folds, ["sid"]), last_fold_rows(target, folds, ["sid"])):
        counted = rows.groupBy("sid", "role").count()
        assert counted.count() == 80
        plan = counted._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in plan and "Broadcast" not in plan
