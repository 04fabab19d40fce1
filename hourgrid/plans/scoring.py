"""Batch scoring of requests and live requests with stored models."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourgrid import constants as C
from hourgrid.functions import scalar as S
from hourgrid.operators import live
from hourgrid.operators import requests as R
from hourgrid.plans.staging import staged

Models = Mapping[tuple[str, str], PipelineModel]


def attach_metrics(rows: DataFrame, metrics: DataFrame) -> DataFrame:
    """Test metrics of the model used; the metrics table has one row per pollutant and model."""
    side = metrics.select("pollutant", "model", F.struct("mae", "rmse", "r2", "n_test").alias("model_metrics"))
    return rows.join(side, ["pollutant", "model"], "left")


def model_inventory(metrics: DataFrame) -> DataFrame:
    """Models and their metrics per pollutant."""
    return metrics.groupBy("pollutant").agg(
        F.sort_array(F.collect_set("model")).alias("available_models"),
        F.map_from_entries(F.collect_list(F.struct("model", F.struct("mae", "rmse", "r2", "n_test")))).alias("metrics"),
    )


def apply_models(rows: DataFrame, models: Models) -> DataFrame:
    """Add ``prediction``: each model scores the rows of its pollutant and name; rows without one drop out."""
    parts = [
        model.transform(rows.filter((F.col("pollutant") == pollutant) & (F.col("model") == name)))
        .select(*rows.columns, S.clip(F.col("forecast"), F.col("pollutant")).alias("prediction"))
        for (pollutant, name), model in models.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def batch_predict(requests: DataFrame, models: Models, metrics: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Responses of the scorable requests, and rejected requests with their reasons."""
    valid, invalid = R.validate_requests(requests)
    # Every model reads its own part, so the assembled rows are written once.
    assembled = staged(R.assemble_features(valid).withColumn("missing_features", R.missing_names()), "assembled")
    scorable, incomplete = R.reject_missing(assembled)
    scored = attach_metrics(apply_models(scorable, models), metrics)
    responses = scored.select(
        "request_id", "pollutant", S.unit_label(F.col("pollutant")).alias("unit"),
        F.col("prediction").alias("prediction_24h_ahead"), F.col("model").alias("model_used"), "model_metrics",
        S.iso_utc(F.col("prediction_time")).alias("prediction_time"),
        S.iso_utc(F.col("target_time")).alias("target_time"), R.feature_map().alias("features_used"),
    )
    missing = F.transform("missing_features", lambda name: F.concat(name, F.lit(": missing")))
    rejected = invalid.select("request_id", "errors").unionByName(
        incomplete.select("request_id", missing.alias("errors"))
    )
    return responses, rejected


def live_predict(features: DataFrame, models: Models, metrics: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Response records with nested sources for the live features whose status is ``ok``.

    Every model reads ``features``: hand in a stored table (``staged``). It may hold questions instead of the names of
    sites, if ``sources`` has these for each question.
    """
    ready = features.filter(F.col("status") == "ok").withColumn("model", F.lit(C.REQUEST_MODELS[0]))
    scored = attach_metrics(apply_models(ready, models), metrics)
    counts = live.provenance_counts(scored).select("request_id", F.struct("live", "derived", "unavailable", "assumed", "total").alias("feature_summary"))
    # Names come last: no row that holds them is shuffled.
    told = scored.join(counts, "request_id")
    told = told if sources is None else live.named_sources(told, sources)
    behind = F.struct(
        F.struct(
            F.col("n_raw_obs").alias("observations_fetched"), "coverage_hours",
            F.lit(C.HISTORY_HOURS).alias("history_window_hours"), F.col("sources").alias("reporting_areas"),
            S.iso_utc(F.col("latest_hour")).alias("latest_observation_utc"),
        ).alias("observations"),
        F.struct(
            F.col("weather_source").alias("source"), F.col("temperature_2m").alias("temperature_2m_c"),
            F.col("wind_speed_10m").alias("wind_speed_10m_ms"), F.col("relative_humidity_2m").alias("humidity_pct"),
            F.col("weather_error").alias("error"),
        ).alias("weather"),
        "feature_summary",
    )
    return told.select(
        "request_id", "pollutant", S.unit_label(F.col("pollutant")).alias("unit"),
        F.col("prediction").alias("prediction_24h_ahead"), F.col("model").alias("model_used"), "model_metrics",
        S.iso_utc(F.col("latest_hour")).alias("prediction_time"), S.iso_utc(F.col("target_time")).alias("target_time"),
        "features_used", "feature_provenance", behind.alias("data_sources"), "warnings",
    )
