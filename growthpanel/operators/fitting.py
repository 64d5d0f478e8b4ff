"""Bounded least-squares fits of the growth curves, many at a time.

A fit is one row: series, curve, fold, start and a trial shape (k, t0, d). From sums of products of the shape, its
derivatives and y over the training rows follow the best ``alpha`` and ``beta``, the squared error, and a damped
Gauss-Newton step for the shape (variable projection, ``functions/step.py``).

A weekly series is as long as the calendar, not as the input: all weeks from year 1 to 9999 are 8 MB of numbers. So one task
holds the weeks of one series and runs all passes of its fits, whatever its length; each fit stops by itself.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import partial

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from growthpanel.functions import curves as C
from growthpanel.functions.columns import check_key_names, clip, with_keys
from growthpanel.functions.noise import repeatable_normal
from growthpanel.functions.step import ASKED, SHAPE, fit_groups, fresh_memory, grid_groups
from growthpanel.operators.folds import FULL
from growthpanel.sources.runstore import RunStore, ensure_checkpoint_dir, held

FIT_ID = ["model", "fold", "start"]


@dataclass(frozen=True)
class FitOptions:
    """``models``: names of curves, None for all known ones. ``grid_rounds`` of a grid of ``grid_points`` a side seed one more start where starts fail or disagree; 0: none."""

    models: tuple[str, ...] | None = None
    starts: int = 5
    max_passes: int = 200
    tolerance: float = 1e-8
    final_tolerance: float = 1e-9
    seed: int = 42
    select_on: str = "test"
    grid_points: int = 9
    grid_rounds: int = 2


@dataclass(frozen=True)
class Fits:
    """``params``: keys, model, fold (-1 = whole series), params, sse, converged, status. ``initial``: the first fits."""

    params: DataFrame
    initial: DataFrame
    keys: list[str]


@dataclass(frozen=True)
class Points:
    """Valid weekly points, held for the fits; their tables on the way go to ``store`` if there is one."""

    df: DataFrame
    keys: list[str]
    store: RunStore | None = None


def hold_points(target: DataFrame, keys: Sequence[str] = (), store: RunStore | None = None) -> Points:
    """Persist the points, partitioned by series."""
    check_key_names(keys)
    target, keys = with_keys(target, keys)
    parts = int(target.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    points = (
        target.where(F.col("status") == "ok")
        .select(*keys, "pos", "x", "y")
        .repartition(parts, *keys)
        .withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*keys)).cast("int"))
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    return Points(points, keys, store)


def series_facts(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What start values and bounds depend on: taken from the whole series, and used in every fold."""
    return points.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("int").alias("n"),
        F.max("y").alias("ymax"),
        F.min("y").alias("ymin"),
        F.min("x").alias("xlo"),
        F.max("x").alias("xhi"),
        F.median("x").alias("xmid"),
    )


def start_values(points: DataFrame, keys: Sequence[str], models: Sequence[str] | None = None) -> DataFrame:
    """Start parameters and bounds per series and curve; fixed fall-backs when the maximum is not positive."""
    positive = F.col("ymax") > 0
    top = F.when(positive, F.col("ymax")).otherwise(F.lit(1.0))
    infinity = F.lit(float("inf"))
    rows = []
    for name in models or C.CURVE_NAMES:
        curve = C.CURVES[name]
        least, most = curve.height_bounds
        first = F.when(positive, F.col("ymax") * curve.start_height).otherwise(F.lit(curve.spare_height))
        of = {
            "height": (first, top * least, top * most),
            "rate": (F.lit(curve.start_rate), *(F.lit(v) for v in curve.rate_bounds)),
            "midpoint": (F.col("xmid"), F.col("xlo"), F.col("xhi")),
            "asymmetry": (F.lit(1.0), *(F.lit(v) for v in curve.asymmetry_bounds)),
            "offset": (F.col("ymin"), -infinity, infinity),
        }
        triples = [of[role] for role in curve.roles]
        rows.append(
            F.struct(
                F.lit(name).alias("model"),
                F.array(*[clip(*t) for t in triples]).alias("start_params"),
                F.array(*[t[1] for t in triples]).alias("lower"),
                F.array(*[t[2] for t in triples]).alias("upper"),
            )
        )
    facts = series_facts(points, keys)
    return facts.withColumn("m", F.explode(F.array(*rows))).select(*keys, "n", "ymax", "xlo", "xhi", "m.*")


# --- one pass -------------------------------------------------------------------------------------------------------

_FACTS = ["ymax", "xlo", "xhi"]


def _shape_bounds() -> dict[str, tuple[Column, Column]]:
    model = F.col("model")
    return {
        "k": (C.by_curve(model, lambda c: c.rate_bounds[0]), C.by_curve(model, lambda c: c.rate_bounds[1])),
        "t0": (F.col("xlo"), F.col("xhi")),
        "d": (C.by_curve(model, lambda c: c.asymmetry_bounds[0]), C.by_curve(model, lambda c: c.asymmetry_bounds[1])),
    }


def _begin(tasks: DataFrame, keys: list[str]) -> DataFrame:
    """Fresh state for tasks: keys, model, fold, start, facts and the first shape."""
    return tasks.select(
        *keys,
        "model",
        *_FACTS,
        *ASKED,
        F.lit(0.0).alias("alpha"),
        F.lit(0.0).alias("beta"),
        F.array(*[F.lit(v) for v in fresh_memory()]).alias("memory"),
        F.lit(0).alias("passes"),
        F.lit(False).alias("done"),
        F.lit(False).alias("converged"),
        F.lit(None).cast("double").alias("score"),
    )


def _weeks(points: Points) -> DataFrame:
    """One row per series: x and y in the order of the weeks."""
    rows = points.df.groupBy(*points.keys).agg(F.sort_array(F.collect_list(F.struct("pos", "x", "y"))).alias("weeks"))
    return rows.select(*points.keys, F.col("weeks.x").alias("x"), F.col("weeks.y").alias("y"))


def grid_seeds(points: Points, models: Sequence[str] | None = None, grid_points: int = 9, grid_rounds: int = 3) -> DataFrame:
    """(keys, model, k, t0, d, sse): of each whole series and curve the best shape on a grid that is zoomed in.

    The grid runs over the bounds of rate, midpoint and asymmetry; height and offset follow in closed form.
    """
    if grid_points < 3 or grid_rounds < 1:
        raise ValueError("a grid needs three points a side and a round")
    keys = points.keys
    starts = start_values(points.df, keys, models).withColumns(_shape_of("start_params")).select(*keys, "model", *_FACTS, *SHAPE)
    curves = {name: curve.for_workers() for name, curve in C.CURVES.items()}
    best = partial(grid_groups, curves=curves, points=grid_points, rounds=grid_rounds)
    groups = starts.join(_weeks(points), keys)
    parts = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = starts.withColumn("sse", F.lit(0.0)).schema
    return groups.repartition(parts, F.xxhash64(*keys, "model")).mapInPandas(best, schema).drop(*_FACTS)


def _fit(points: Points, tasks: DataFrame, max_passes: int, tolerance: float, grid: tuple[int, int] = (9, 0)) -> DataFrame:
    """All passes of one series and curve in one task."""
    keys, weeks = points.keys, _weeks(points)
    if "score_from" not in tasks.columns:
        tasks = tasks.withColumns({"score_from": F.lit(0), "score_to": F.lit(0)})
    asked = F.sort_array(F.collect_list(F.struct(*ASKED))).alias("fits")
    groups = tasks.groupBy(*keys, "model", *_FACTS).agg(asked).join(weeks, keys)
    groups = groups.select(*keys, "model", *_FACTS, *[F.col(f"fits.{c}").alias(c) for c in ASKED], "x", "y")
    # few bytes but much work: spread over all partitions, by an expression that no earlier partitioning can stand in for
    parts = int(tasks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = groups.repartition(parts, F.xxhash64(*keys, "model"))
    curves = {name: curve.for_workers() for name, curve in C.CURVES.items()}
    solve = partial(fit_groups, curves=curves, tolerance=tolerance, max_passes=max_passes, points=grid[0], rounds=grid[1])
    return groups.mapInPandas(solve, schema=_begin(tasks, keys).schema)


def _iterate(points: Points, tasks: DataFrame, options: FitOptions, tolerance: float) -> DataFrame:
    """Run the fits asked for; one row per fit with its parameters. One that hits the limit of passes has not converged."""
    fitted = _fitted(points, tasks, options.max_passes, tolerance, (options.grid_points, options.grid_rounds))
    stopped = ~F.col("done") & (F.col("status") == "ok")
    return fitted.withColumn("status", F.when(stopped, F.lit("not_converged")).otherwise(F.col("status"))).drop("done")


def _fitted(points: Points, tasks: DataFrame, max_passes: int, tolerance: float, grid: tuple[int, int] = (9, 0)) -> DataFrame:
    ensure_checkpoint_dir(tasks.sparkSession)
    fitted = held(_fit(points, tasks, max_passes, tolerance, grid), points.store, "fits")
    sse = F.get("memory", F.lit(len(SHAPE)))
    ok = ~F.isnan(sse) & (sse < float("inf"))
    return fitted.select(
        *points.keys,
        *FIT_ID,
        _public_params().alias("params"),
        F.when(ok, sse).otherwise(F.lit(0.0)).alias("sse"),
        "converged",
        "passes",
        "done",
        F.when(~F.isnan("score"), F.col("score")).alias("score"),
        F.when(ok, F.lit("ok")).otherwise(F.lit("failed")).alias("status"),
    )


def linear_pairs(points: Points, shapes: DataFrame) -> DataFrame:
    """Best bounded height and offset, in closed form, of curves whose shapes are given.

    ``shapes``: keys, model, fold, train_end (rows to fit), k, t0 and d, one row per fit. Yields the parameters like
    ``fit_curves``: keys, model, fold, params, sse, converged, status.
    """
    facts = series_facts(points.df, points.keys).select(*points.keys, "ymax", "xlo", "xhi")
    fitted = _fitted(points, shapes.join(facts, points.keys).withColumn("start", F.lit(0)), 1, 0.0)
    return fitted.select(*points.keys, "model", "fold", "params", "sse", F.lit(True).alias("converged"), "status")


def _public_params() -> Column:
    """Accepted shape and its linear pair in each curve's own parameter order."""
    k, t0, d = (F.get("memory", F.lit(i)) for i in range(len(SHAPE)))
    alpha, beta = F.col("alpha"), F.col("beta")

    def ordered(curve: C.Curve) -> Column:
        of = {"height": alpha + beta if curve.absolute else beta, "rate": k, "midpoint": t0, "asymmetry": d, "offset": alpha}
        return F.array(*[of[role] for role in curve.roles])

    return C.by_curve(F.col("model"), ordered)


def _shape_of(params: str) -> dict[str, Column]:
    """k, t0, d out of a parameter array; without a midpoint t0 = 0, without an asymmetry d = 1."""

    def taken(role: str, otherwise: float) -> Column:
        def value(curve: C.Curve) -> Column:
            return F.lit(otherwise) if curve.place(role) is None else F.get(params, F.lit(curve.place(role)))

        return C.by_curve(F.col("model"), value)

    return {"k": taken("rate", 0.0), "t0": taken("midpoint", 0.0), "d": taken("asymmetry", 1.0)}


# --- the whole procedure ----------------------------------------------------------------------------------------------


def _perturbed(keys: list[str], seed: int) -> dict[str, Column]:
    """Start 0 is unchanged; start j multiplies each parameter by 1 + N(0, 0.1 j/4), inside the bounds."""
    spread = F.lit(0.1) * F.col("start") / F.lit(4.0)
    ident = [F.col(c) for c in (*keys, *FIT_ID)]
    fitted = {
        "k": F.lit(True),
        "t0": C.by_curve(F.col("model"), lambda c: c.fits_midpoint),
        "d": C.by_curve(F.col("model"), lambda c: c.fits_asymmetry),
    }
    bounds, moved = _shape_bounds(), {}
    for name in SHAPE:
        noisy = F.col(name) * (F.lit(1.0) + spread * repeatable_normal(seed, F.lit(name), *ident))
        moved[name] = F.when(fitted[name] & (F.col("start") > 0), clip(noisy, *bounds[name])).otherwise(F.col(name))
    return moved


def enough_rows(tasks: DataFrame) -> Column:
    """A fold with fewer training rows than the curve has parameters is skipped."""
    return F.col("train_end") >= C.by_curve(F.col("model"), lambda c: len(c.parameters))


def fold_status(folds: DataFrame, keys: Sequence[str], models: Sequence[str] | None = None) -> DataFrame:
    """Which curves each fold can fit: status ok or skipped."""
    each = folds.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models or C.CURVE_NAMES])))
    status = F.when(enough_rows(each), F.lit("ok")).otherwise(F.lit("skipped"))
    return each.select(*keys, "model", "fold", "train_end", status.alias("status"))


def best_fold_params(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Parameters of each curve's best-scoring fold, the earlier one on ties; they seed the final fit."""
    ranked = scored.where(F.col("score").isNotNull() & F.col("params").isNotNull())
    best = F.max_by(F.struct("params", "fold"), F.struct("score", -F.col("fold"))).alias("best")
    return ranked.groupBy(*keys, "model").agg(best).select(
        *keys, "model", F.col("best.fold").alias("best_fold"), F.col("best.params").alias("fold_best")
    )


def fit_curves(
    target: DataFrame | Points,
    folds: DataFrame | None = None,
    keys: Sequence[str] = (),
    options: FitOptions = FitOptions(),
) -> Fits:
    """Fit every curve to every series: whole series, then each fold from several starts, then the final fit.

    Starts and the seed of the final fit are chosen by test R2, as in the reference; ``select_on='train'`` avoids that
    look at test data. Without folds the first fit is the final one. A fit that fails, does not converge or has too few
    rows has a status; it never ends the run. A first fit without success gives way to the start values, a fold without
    one to the first fit, and a final fit is left out.
    """
    if options.select_on not in ("test", "train"):
        raise ValueError("select_on must be 'test' or 'train'")
    points = target if isinstance(target, Points) else hold_points(target, keys)
    keys = points.keys
    ensure_checkpoint_dir(points.df.sparkSession)
    starts = held(start_values(points.df, keys, options.models), points.store, "starts")

    first_tasks = starts.withColumns(
        {"fold": F.lit(FULL), "start": F.lit(0), "train_end": F.col("n"), **_shape_of("start_params")}
    )
    first = _iterate(points, first_tasks, options, options.tolerance)
    base = starts.select(*keys, "model", "n", "ymax", "xlo", "xhi", "start_params")
    usable = F.when(F.col("status") == "ok", F.col("params")).otherwise(F.col("start_params"))
    initial = base.join(
        first.select(*keys, "model", "params", "status", "sse", "converged"), [*keys, "model"], "left"
    ).withColumn("initial_params", usable)
    initial = held(initial, points.store, "initial")

    if folds is None:
        return Fits(_final_rows(initial, keys, "initial_params"), initial, keys)

    # a start is scored where it is fitted, on the rows that choose between starts
    names = ("test_start", "test_end") if options.select_on == "test" else (F.lit(0), "train_end")
    scored_rows = [(F.col(c) if isinstance(c, str) else c).cast("int").alias(a) for c, a in zip(names, ("score_from", "score_to"))]
    per_fold = initial.select(*keys, "model", "n", "ymax", "xlo", "xhi", "initial_params").join(
        folds.select(*keys, "fold", "train_end", *scored_rows), keys
    )
    enough = enough_rows(per_fold)
    seeds = F.explode(F.sequence(F.lit(0), F.lit(options.starts - 1)))
    tasks = per_fold.where(enough).withColumn("start", seeds).withColumns(_shape_of("initial_params"))
    fits = _iterate(points, tasks.withColumns(_perturbed(keys, options.seed)), options, options.tolerance)

    scored = fits.where(F.col("status") == "ok")
    order = F.struct("score", -F.col("start"))
    winners = (
        scored.where(F.col("score").isNotNull())
        .groupBy(*keys, "model", "fold")
        .agg(F.max_by(F.struct("params", "sse", "converged", "score"), order).alias("best"))
        .select(*keys, "model", "fold", "best.*")
    )
    fold_params = (
        per_fold.join(winners, [*keys, "model", "fold"], "left")
        .select(
            *keys,
            "model",
            "fold",
            F.when(enough, F.coalesce("params", "initial_params")).alias("params"),
            "sse",
            F.coalesce("converged", F.lit(False)).alias("converged"),
            "score",
            F.when(~enough, F.lit("skipped"))
            .when(F.col("params").isNull(), F.lit("start_values"))
            .otherwise(F.lit("ok"))
            .alias("status"),
        )
    )
    fold_params = held(fold_params, points.store, "fold_params")

    lead = best_fold_params(fold_params, keys)
    seeded = initial.join(lead, [*keys, "model"], "left").withColumn(
        "seed_params", F.coalesce("fold_best", "initial_params")
    )
    final_tasks = seeded.withColumns(
        {"fold": F.lit(FULL), "start": F.lit(0), "train_end": F.col("n"), **_shape_of("seed_params")}
    )
    final = _iterate(points, final_tasks, options, options.final_tolerance)
    rows = base.join(final.select(*keys, "model", "params", "status", "sse", "converged"), [*keys, "model"], "left")
    whole = _final_rows(rows, keys, None)
    return Fits(whole.unionByName(fold_params.drop("score")), initial, keys)


def _final_rows(rows: DataFrame, keys: list[str], fallback: str | None) -> DataFrame:
    status = F.coalesce("status", F.lit("failed"))
    params = F.when(status == "ok", F.col("params"))
    return rows.select(
        *keys,
        "model",
        F.lit(FULL).alias("fold"),
        (params if fallback is None else F.col(fallback)).alias("params"),
        "sse",
        F.coalesce("converged", F.lit(False)).alias("converged"),
        status.alias("status"),
    )
