"""Random forest and gradient boosting on the curve and time features, trained by MLlib over the whole panel.

All series train one model: features are standardised per series, and the target is divided by the series' maximum, which
does not change how the trees of a single series split. A series that lacks a curve is not learned from; its predictions
are NULL, with a status. Sizes default to the reference's and are all parameters.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from growthpanel.functions import curves as C
from growthpanel.functions.columns import with_keys
from growthpanel.operators.averaging import combine, components
from growthpanel.operators.features import feature_names, fit_scaler, make_features, scale, time_context
from growthpanel.operators.folds import fold_rows
from growthpanel.operators.metrics import fold_summary, score
from growthpanel.operators.stages import PREDICTED, CurveFeatures, SeriesScaling, SeriesTarget
from growthpanel.sources.runstore import RunStore, ensure_checkpoint_dir, held, packed, scratch_of

FOREST, BOOSTING = "Random Forest", "Gradient Boosting"


@dataclass(frozen=True)
class TreeOptions:
    """Fixed values of the reference; ``inner_folds`` are contiguous blocks for the grid search."""

    models: tuple[str, ...] = (FOREST, BOOSTING)
    trees: int = 100
    forest_depth: int = 10
    boosting_depth: int = 5
    forest_grid: dict = field(default_factory=lambda: {"trees": [100, 200], "depth": [10, 20]})
    boosting_grid: dict = field(default_factory=lambda: {"trees": [100, 200], "depth": [5, 10]})
    inner_folds: int = 3
    bins: int = 256
    step: float = 0.1
    seed: int = 42
    parallelism: int = 4


@dataclass(frozen=True)
class TreeEnsemble:
    """A trained model. Its pipeline holds all that predicting needs: ``pipeline.transform(weeks)`` is a prediction."""

    name: str
    pipeline: PipelineModel
    keys: list[str]

    @property
    def tree(self):
        """The stage of the pipeline that is the forest or the boosted trees."""
        return next(stage for stage in self.pipeline.stages if hasattr(stage, "featureImportances"))


def _regressor(name: str, trees: int, depth: int, options: TreeOptions):
    shared = {"featuresCol": "features", "labelCol": "label", "maxDepth": depth, "maxBins": options.bins, "seed": options.seed}
    if name == FOREST:
        return RandomForestRegressor(numTrees=trees, featureSubsetStrategy="all", **shared)
    return GBTRegressor(maxIter=trees, stepSize=options.step, **shared)


def target_scale(target: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """What the target of each series is divided by: its maximum."""
    target, keys = with_keys(target, keys)
    highest = target.where(F.col("status") == "ok").groupBy(*keys).agg(F.max("y").alias("top"))
    return highest.select(*keys, F.when(F.col("top") > 0, F.col("top")).otherwise(F.lit(1.0)).alias("target_scale"))


def _labelled(rows: DataFrame, scales: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(scales, keys).withColumn("label", F.col("y") / F.col("target_scale")).dropna(subset=[*feature_names(), "label"])


def fold_features(target: DataFrame, folds: DataFrame, params: DataFrame, fold: int, keys: Sequence[str] = ()) -> DataFrame:
    """Scaled features of one fold's train and test rows; context and scaler come from its train rows only.

    Series that lack one of the four curves in this fold are skipped.
    """
    target, keys = with_keys(target, keys)
    rows = fold_rows(target, folds.where(F.col("fold") == fold), keys).select(*keys, "role", "pos", "x", "y")
    mine = params.where((F.col("fold") == fold) & F.col("params").isNotNull())
    complete = mine.groupBy(*keys).agg(F.count(F.lit(1)).alias("curves")).where(F.col("curves") == len(C.CURVE_NAMES))
    mine = mine.join(complete.select(*keys), keys, "left_semi")
    train = rows.where(F.col("role") == "train")
    features = make_features(rows, mine, time_context(train, keys), keys)
    return scale(features, fit_scaler(features.where(F.col("role") == "train"), keys), keys)


def tree_cv_metrics(
    target: DataFrame,
    folds: DataFrame,
    params: DataFrame,
    keys: Sequence[str] = (),
    options: TreeOptions = TreeOptions(),
    store: RunStore | None = None,
) -> DataFrame:
    """Mean test measures over folds per series and tree model; at most ``options.parallelism`` folds train at a time.

    Tables on the way go to ``store`` if there is one.
    """
    target, keys = with_keys(target, keys)
    ensure_checkpoint_dir(target.sparkSession)
    scales = held(target_scale(target, keys), store, "target_scale")
    assembler = VectorAssembler(inputCols=feature_names(), outputCol="features")

    def one_fold(fold: int) -> list[DataFrame]:
        rows = packed(_labelled(fold_features(target, folds, params, fold, keys), scales, keys), store, "fold_rows")
        rows = assembler.transform(rows).persist(StorageLevel.MEMORY_AND_DISK)
        train, test = rows.where(F.col("role") == "train"), rows.where(F.col("role") == "test")
        found = []
        for name in options.models if not train.isEmpty() else ():
            depth = options.forest_depth if name == FOREST else options.boosting_depth
            model = _regressor(name, options.trees, depth, options).fit(train)
            predicted = model.transform(test).withColumn("pred", F.col("prediction") * F.col("target_scale"))
            measured = score(predicted, keys).withColumns({"model": F.lit(name), "fold": F.lit(fold)})
            found.append(held(measured, store, "fold_measures"))
        rows.unpersist()
        return found

    numbers = [fold for (fold,) in folds.select("fold").distinct().orderBy("fold").collect()]  # as many rows as there are splits
    with ThreadPool(max(1, options.parallelism)) as pool:  # a fold's jobs leave cores idle: some folds side by side
        scored = [measured for found in pool.map(inheritable_thread_target(target.sparkSession)(one_fold), numbers) for measured in found]
    if not scored:
        schema = target.select(*keys, F.lit("").alias("model"), *[F.lit(0.0).alias(m) for m in ("rmse", "r2", "mae")])
        return schema.limit(0)
    return fold_summary(combine(*scored), [*keys, "model"]).select(*keys, "model", "rmse", "r2", "mae")


def inner_fold(rows: DataFrame, keys: Sequence[str], count: int) -> DataFrame:
    """Contiguous blocks of each series for the grid search; the first ``n % count`` blocks are one row longer."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    at = F.row_number().over(Window.partitionBy(*keys).orderBy("pos")) - 1
    size, extra = F.floor(n / count), n % count
    long_part = (size + 1) * extra
    block = F.when(at < long_part, F.floor(at / (size + 1))).otherwise(
        extra + F.floor((at - long_part) / F.greatest(size, F.lit(1)))
    )
    return rows.withColumn("inner_fold", block.cast("int"))


def train_trees(
    target: DataFrame,
    params: DataFrame,
    keys: Sequence[str] = (),
    options: TreeOptions = TreeOptions(),
    component_fit: str = "first_fold",
    store: RunStore | None = None,
) -> dict[str, TreeEnsemble]:
    """Grid search and final training on all weeks, per tree model. The models' tables go to ``store`` if there is one."""
    target, keys = with_keys(target, keys)
    valid = target.where(F.col("status") == "ok").select(*keys, "pos", "x", "y")
    ensure_checkpoint_dir(target.sparkSession)
    parts = held(components(params, keys, component_fit), store, "tree_components")
    context = held(time_context(valid, keys), store, "time_context")
    scales = held(target_scale(target, keys), store, "target_scale")
    features = make_features(valid, parts, context, keys)
    scaler = held(fit_scaler(features, keys), store, "scaler")
    rows = _labelled(scale(features, scaler, keys), scales, keys)
    trained = {}
    with scratch_of(store, "tree_rows") as scratch:
        rows = packed(inner_fold(rows, keys, options.inner_folds), scratch, "rows").persist(StorageLevel.MEMORY_AND_DISK)
        for name in options.models:
            grid = options.forest_grid if name == FOREST else options.boosting_grid
            base = _regressor(name, grid["trees"][0], grid["depth"][0], options)
            size = base.numTrees if name == FOREST else base.maxIter
            pipeline = Pipeline(stages=[VectorAssembler(inputCols=feature_names(), outputCol="features"), base])
            choices = ParamGridBuilder().addGrid(size, grid["trees"]).addGrid(base.maxDepth, grid["depth"]).build()
            if len(choices) == 1:
                model = pipeline.fit(rows)
            else:
                search = CrossValidator(
                    estimator=pipeline,
                    estimatorParamMaps=choices,
                    evaluator=RegressionEvaluator(labelCol="label", metricName="mse"),
                    numFolds=options.inner_folds,
                    foldCol="inner_fold",
                    parallelism=options.parallelism,
                    seed=options.seed,
                )
                model = search.fit(rows).bestModel
            before = [CurveFeatures(keys, params=parts, context=context), SeriesScaling(keys, scaler=scaler, target_scale=scales)]
            trained[name] = TreeEnsemble(name, PipelineModel([*before, *model.stages, SeriesTarget(keys)]), keys)
        rows.unpersist()
    return trained


def tree_predictions(rows: DataFrame, ensemble: TreeEnsemble) -> DataFrame:
    """Features at any x, scaled as in training, then the model: every row with ``model``, ``pred`` and ``tree_status``.

    A row that lacks a feature, as when a curve of its series could not be fitted, has a NULL prediction and the status
    ``missing_curve``.
    """
    predicted = ensemble.pipeline.transform(rows)
    return predicted.select(*rows.columns, F.lit(ensemble.name).alias("model"), F.col(PREDICTED).alias("pred"), "tree_status")


def importances(spark: SparkSession, ensembles: dict[str, TreeEnsemble]) -> DataFrame:
    """Importance of each feature in each trained model, long form. A few numbers from the fitted models, no data."""
    rows = [
        (name, feature, float(value))
        for name, e in ensembles.items()
        for feature, value in zip(feature_names(), e.tree.featureImportances.toArray())
    ]
    return spark.createDataFrame(rows, "model string, feature string, importance double")


def importance_table(long: DataFrame) -> DataFrame:
    """Features as rows, models as columns, missing ones 0."""
    pivoted = long.groupBy(F.col("feature").alias("Feature")).pivot("model", [BOOSTING, FOREST]).agg(F.avg("importance"))
    return pivoted.na.fill(0.0).orderBy("Feature")
