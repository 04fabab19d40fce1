"""Tree models per pollutant on a stored feature table."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, SQLTransformer, VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourgrid import constants as C
from hourgrid.operators import evaluate, exports
from hourgrid.plans.boosting import HistogramBooster
from hourgrid.plans.forest import HistogramForest
from hourgrid.plans.scoring import Models, apply_models
from hourgrid.plans.staging import staged
from hourgrid.session import ensure_checkpoint_dir

# Hyper-parameters of the two learners.
GBT_PARAMS = {"maxIter": 300, "stepSize": 0.05, "maxDepth": 5, "minInstancesPerNode": 10, "lossType": "absolute"}
RF_PARAMS = {"numTrees": 200, "featureSubsetStrategy": "sqrt", "minInstancesPerNode": 10}
SEED = 42
# The forest's trees are grown to purity where leaf size allows; deeper than this they do not go.
RF_DEPTH = 30


@dataclass(frozen=True)
class TrainSettings:
    """What a run may change: learner sizes, feature set, seed, and the partitions that rows are merged to.

    By default rows keep the partitions of the feature table. ``tasks`` are those that count the rows of a boosted table
    or the cores that grow a forest's trees; by default fits that run together share the cores by their rows.
    """

    gbt: dict | None = None
    forest: dict | None = None
    features: Sequence[str] = C.FEATURES
    seed: int = SEED
    test_fraction: float = C.TEST_FRACTION
    partitions: int | None = None
    tasks: int | None = None


def _preparation(features: Sequence[str]) -> list:
    """Doubles, missing indicators, mean imputation and the vector; the learners take no nulls."""
    columns = ", ".join(
        f"cast({c} as double) as _x_{c}, cast({c} is null as double) as _missing_{c}" for c in features
    )
    values, filled = [f"_x_{c}" for c in features], [f"_i_{c}" for c in features]
    return [
        SQLTransformer(statement=f"SELECT *, {columns} FROM __THIS__"),
        Imputer(inputCols=values, outputCols=filled, strategy="mean"),
        VectorAssembler(inputCols=[*filled, *(f"_missing_{c}" for c in features)], outputCol="_features"),
    ]


def _target_scale(train: DataFrame) -> tuple[float, float]:
    row = train.agg(F.avg("target").alias("m"), F.stddev_pop("target").alias("s")).first()
    return float(row["m"]), float(row["s"] or 1.0) or 1.0


def fit(train: DataFrame, learner, features: Sequence[str], partitions: int | None = None) -> PipelineModel:
    """Fit on a standardised target, so that one step size suits every unit; ``forecast`` is unscaled."""
    mean, scale = _target_scale(train)
    rows = train.filter(F.col("target").isNotNull()).withColumn("_label", (F.col("target") - mean) / scale)
    if partitions:
        rows = rows.coalesce(partitions)
    learner = learner.setFeaturesCol("_features").setLabelCol("_label").setPredictionCol("_scaled")
    helpers = ", ".join(["_features", "_scaled", *(f"_{k}_{c}" for c in features for k in ("x", "i", "missing"))])
    unscale = SQLTransformer(
        statement=f"SELECT * EXCEPT ({helpers}), _scaled * {scale!r}D + {mean!r}D AS forecast FROM __THIS__"
    )
    # A column without any value cannot be imputed; it carries nothing either.
    return Pipeline(stages=[*_preparation(features), learner, unscale]).fit(rows)


def _usable(train: DataFrame, features: Sequence[str]) -> list[str]:
    counts = train.agg(*(F.count(c).alias(c) for c in features)).first()
    return [c for c in features if counts[c]]


def train_gbt(train: DataFrame, settings: TrainSettings = TrainSettings()) -> PipelineModel:
    ensure_checkpoint_dir(train.sparkSession)
    learner = HistogramBooster(**{**GBT_PARAMS, "tasks": settings.tasks, **(settings.gbt or {})}, seed=settings.seed)
    return fit(train, learner, _usable(train, settings.features), settings.partitions)


def train_forest(train: DataFrame, settings: TrainSettings = TrainSettings()) -> PipelineModel:
    learner = HistogramForest(**{"maxDepth": RF_DEPTH, **RF_PARAMS, "tasks": settings.tasks, **(settings.forest or {})}, seed=settings.seed)
    return fit(train, learner, _usable(train, settings.features), settings.partitions)


TRAINERS = {"GradientBoosting": train_gbt, "RandomForest": train_forest}


def train_all(
    train: DataFrame, models: Sequence[str] = ("GradientBoosting", "RandomForest"),
    pollutants: Sequence[str] = C.POLLUTANTS, settings: TrainSettings = TrainSettings(),
) -> dict[tuple[str, str], PipelineModel]:
    """One model per pollutant and learner. The fits are independent, so their jobs share the cluster.

    A pollutant without training rows gets no model. Each fit has its share of the cores' tasks: a task costs more than
    counting what it would hold if every fit had one on each core.
    """
    sizes = {r["pollutant"]: r["n"] for r in train.groupBy("pollutant").agg(F.count("target").alias("n")).collect()}
    tasks = [(p, m) for p in pollutants if sizes.get(p) for m in models]
    cores, whole = train.sparkSession.sparkContext.defaultParallelism, sum(sizes[p] for p, _ in tasks)

    def run(task):
        pollutant, model = task
        shared = replace(settings, tasks=settings.tasks or -(-cores * sizes[pollutant] // whole))
        return TRAINERS[model](train.filter(F.col("pollutant") == pollutant), shared)

    with ThreadPoolExecutor(max_workers=max(1, len(tasks))) as pool:
        return dict(zip(tasks, pool.map(inheritable_thread_target(train.sparkSession)(run), tasks)))


def predictions(test: DataFrame, models: Models) -> DataFrame:
    """``y_true`` and ``y_pred`` of every model on the test rows."""
    names = sorted({name for _, name in models})
    rows = reduce(DataFrame.unionByName, (test.withColumn("model", F.lit(n)) for n in names))
    forecast = [
        model.transform(rows.filter((F.col("pollutant") == p) & (F.col("model") == n))).select(
            "pollutant", "model", "station_id", "timestamp_utc", F.col("target").alias("y_true"),
            F.col("forecast").alias("y_pred"),
        )
        for (p, n), model in models.items()
    ]
    return reduce(DataFrame.unionByName, forecast)


def train_and_evaluate(
    features: DataFrame, models: Sequence[str] = ("GradientBoosting", "RandomForest"),
    settings: TrainSettings = TrainSettings(),
) -> tuple[dict[tuple[str, str], PipelineModel], DataFrame]:
    """Split by time, train, and measure on the test side.

    ``features`` is read several times: hand in a stored table (``staged``), not a plan from raw rows.
    """
    cutoffs = staged(evaluate.split_cutoffs(features, settings.test_fraction), "cutoffs")
    train, test, _ = evaluate.time_split(features, cutoffs=cutoffs)
    fitted = train_all(train, models, settings=settings)
    metrics = evaluate.regression_metrics(predictions(test, fitted), ("pollutant", "model"))
    return fitted, metrics


def stored_table(clean: DataFrame, path: str, build, refresh: bool = False) -> DataFrame:
    """The feature table under ``path``; it is built only where it is absent."""
    spark = clean.sparkSession
    if refresh or not exists(spark, path):
        build(clean).write.mode("overwrite").partitionBy("pollutant").parquet(path)
    return spark.read.parquet(path)


def cached_retrain(clean: DataFrame, path: str, build, settings: TrainSettings = TrainSettings(), refresh: bool = False):
    """Train from the feature table stored under ``path``."""
    return train_and_evaluate(stored_table(clean, path, build, refresh), ("GradientBoosting",), settings)


def exists(spark: SparkSession, path: str) -> bool:
    from pyspark.errors import AnalysisException

    try:
        spark.read.parquet(path)
    except AnalysisException:
        return False
    return True


def weather_ablation(with_weather: DataFrame, settings: TrainSettings = TrainSettings()) -> DataFrame:
    """Boosted trees without and with weather columns, compared per pollutant.

    The baseline keeps rows without weather, as it does not need it. ``with_weather`` holds the feature
    rows of ``build_features(..., weather='optional')``.
    """
    stored = staged(with_weather, "ablation")
    base_settings = replace(settings, features=C.BASE_FEATURES)
    tasks = (stored, base_settings), (stored.dropna(subset=list(C.WEATHER_COLUMNS)), settings)

    def run(task):
        return train_and_evaluate(task[0], ("GradientBoosting",), task[1])[1]

    with ThreadPoolExecutor(max_workers=len(tasks)) as pool:
        base, augmented = pool.map(inheritable_thread_target(stored.sparkSession)(run), tasks)
    return exports.ablation(base, augmented)


# -- Store ---------------------------------------------------------------------------------------

def save_models(models: Models, path: str) -> str:
    for (pollutant, name), model in models.items():
        model.write().overwrite().save(f"{path}/{name}_{pollutant}")
    return path


def load_models(path: str, names: Sequence[tuple[str, str]]) -> dict[tuple[str, str], PipelineModel]:
    return {(p, n): PipelineModel.load(f"{path}/{n}_{p}") for p, n in names}


__all__ = [
    "GBT_PARAMS", "RF_PARAMS", "TrainSettings", "apply_models", "cached_retrain", "fit", "load_models",
    "predictions", "save_models", "train_all", "train_and_evaluate", "train_forest", "train_gbt", "weather_ablation",
]
