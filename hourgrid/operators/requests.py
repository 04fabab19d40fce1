"""Scoring requests: validation, feature assembly, guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourgrid import constants as C
from hourgrid.functions import scalar as S


def _error(broken: Column, text: str) -> Column:
    """The text where the check fails; an unknown outcome (null) is not a failure."""
    return F.when(F.coalesce(broken, F.lit(False)), F.lit(text))


def request_errors() -> Column:
    """All violations of the request contract as an array of texts."""
    lat, lon = F.col("station.latitude"), F.col("station.longitude")
    flag = F.col("readings.drift_flag")
    checks = [
        _error(F.col("pollutant").isNull() | ~F.col("pollutant").isin(*C.POLLUTANTS), "pollutant: not one of pm25, no2, ozone"),
        _error(~F.col("model").isin(*C.REQUEST_MODELS), "model: not one of GradientBoosting, RandomForest"),
        _error(lat.isNull() | ~lat.between(-90, 90), "station.latitude: required, between -90 and 90"),
        _error(lon.isNull() | ~lon.between(-180, 180), "station.longitude: required, between -180 and 180"),
        *(_error(F.col(f"readings.{k}").isNull(), f"readings.{k}: required") for k in C.ESSENTIAL_LAGS),
        _error(~flag.isin(0, 1), "readings.drift_flag: must be 0 or 1"),
    ]
    return F.array_compact(F.array(*checks))


def with_errors(requests: DataFrame) -> DataFrame:
    return requests.withColumn("errors", request_errors())


def validate_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid requests, and rejected ones with their errors."""
    checked = with_errors(requests)
    return (
        checked.filter(F.size("errors") == 0).drop("errors"), checked.filter(F.size("errors") > 0),
    )


def assemble_features(requests: DataFrame) -> DataFrame:
    """The features of a request in canonical order; weather is not part of a request."""
    ts = F.coalesce(F.col("prediction_time"), F.current_timestamp())
    out: dict[str, Column] = {name: F.col(f"readings.{name}") for name in C.READING_FEATURES}
    out.update(S.calendar_features(ts))
    out["latitude"], out["longitude"] = F.col("station.latitude"), F.col("station.longitude")
    out["drift_flag"] = F.coalesce(F.col("readings.drift_flag"), F.lit(0))
    out.update({c: F.lit(None) for c in C.WEATHER_COLUMNS})
    return requests.select(
        "request_id", "pollutant",
        F.coalesce(F.col("model"), F.lit(C.REQUEST_MODELS[0])).alias("model"),
        ts.alias("prediction_time"), target_time(ts).alias("target_time"),
        *(out[name].cast("double").alias(name) for name in C.FEATURES),
    )


def feature_map(columns=C.FEATURES) -> Column:
    return F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*map(F.col, columns)))


def target_time(ts: Column, hours: int = C.HORIZON_HOURS) -> Column:
    return ts + F.expr(f"interval {int(hours)} hours")


def missing_names(columns=C.FEATURES) -> Column:
    return F.array_compact(F.array(*(F.when(S.not_nan(F.col(c)).isNull(), F.lit(c)) for c in columns)))


def reject_missing(assembled: DataFrame, models: tuple[str, ...] = ("RandomForest",)) -> tuple[DataFrame, DataFrame]:
    """Rows a model that takes no nulls can score, and the rest with the names of what is missing."""
    known = "missing_features" in assembled.columns
    checked = assembled if known else assembled.withColumn("missing_features", missing_names())
    refused = F.col("model").isin(*models) & (F.size("missing_features") > 0)
    return checked.filter(~refused).drop("missing_features"), checked.filter(refused)


def essential_lag_guard(assembled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with both essential lags, and the rest with the names of the missing ones."""
    checked = assembled.withColumn("missing_required", missing_names(C.ESSENTIAL_LAGS))
    return (
        checked.filter(F.size("missing_required") == 0).drop("missing_required"),
        checked.filter(F.size("missing_required") > 0),
    )


def bounding_box(latitude: Column, longitude: Column, half_lat: float = C.BOX_LATITUDE, half_lon: float = C.BOX_LONGITUDE) -> dict[str, Column]:
    return {
        "min_lon": F.round(longitude - half_lon, 4), "min_lat": F.round(latitude - half_lat, 4),
        "max_lon": F.round(longitude + half_lon, 4), "max_lat": F.round(latitude + half_lat, 4),
    }
