"""Published versions of models: a folder of models for each, and a manifest that names the ones that count.

A version's models are written first, its row of the manifest last. The manifest is a table that only grows;
Spark shows a row when the write that brought it has been committed. Whoever dies before that leaves files
that no manifest names, and the version before stays the published one.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Sequence
from dataclasses import asdict

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourgrid.plans.scoring import Models
from hourgrid.plans.training import TrainSettings, load_models, save_models

METRICS = "pollutant string, model string, mae double, rmse double, r2 double, n_test long"
MANIFEST = (
    "version string, published_at timestamp, fingerprint string, models array<struct<pollutant: string, model: string>>, "
    "features array<string>, settings string, metrics array<struct<pollutant: string, model: string, mae: double, rmse: double, r2: double, n_test: long>>"
)


def fingerprint(table: DataFrame) -> str:
    """What a table holds, whatever the order of its rows and files."""
    row = table.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*(F.col(f"`{c}`") for c in table.columns)).cast("decimal(38,0)")).alias("h")).first()
    return f"{row['n']}-{row['h'] or 0}"


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """All published versions; empty where nothing has been."""
    try:
        return spark.read.schema(MANIFEST).json(f"{root}/manifest")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def publish(models: Models, metrics: DataFrame, root: str, source: str, settings: TrainSettings = TrainSettings()) -> str:
    """Write models and, when they are complete, the manifest's row; returns the version.

    ``metrics`` has a row for each pollutant and model, ``source`` is the fingerprint of what they learned from.
    """
    spark = metrics.sparkSession
    now = dt.datetime.now(dt.timezone.utc)
    version = f"{now:%Y%m%dT%H%M%S}-{uuid.uuid4().hex[:8]}"
    save_models(models, f"{root}/versions/{version}")
    # A row for each of a handful of models.
    measured = [tuple(r) for r in metrics.select("pollutant", "model", "mae", "rmse", "r2", F.col("n_test").cast("long")).collect()]
    row = (version, now, source, sorted(models), list(settings.features), json.dumps(asdict(settings), default=list), measured)
    spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("append").json(f"{root}/manifest")
    return version


def published(spark: SparkSession, root: str, learners: Sequence[str], source: str | None = None) -> tuple[Models, DataFrame] | None:
    """Models and metrics of the newest version with one of each learner; with ``source``, of that table only."""
    rows = manifest(spark, root)
    if source is not None:
        rows = rows.filter(F.col("fingerprint") == source)
    named = F.array_distinct(F.transform("models", lambda m: m["model"]))
    rows = rows.filter(F.size(F.array_except(F.array(*map(F.lit, learners)), named)) == 0)
    row = rows.orderBy(F.desc("published_at"), F.desc("version")).first()
    if row is None:
        return None
    names = [(m["pollutant"], m["model"]) for m in row["models"] if m["model"] in learners]
    metrics = [tuple(m) for m in row["metrics"] if m["model"] in learners]
    return load_models(f"{root}/versions/{row['version']}", names), spark.createDataFrame(metrics, METRICS)
