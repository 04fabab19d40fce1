"""Explicit Spark schemas of the tables and payloads."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


_text, _real, _whole = T.StringType(), T.DoubleType(), T.LongType()

RAW_LONG = _schema(
    state_code=_text, county_code=_text, site_number=_text, parameter_code=_text,
    poc=T.IntegerType(), latitude=_real, longitude=_real, datum=_text, parameter=_text,
    date_gmt=_text, time_gmt=_text, date_local=_text, time_local=_text,
    sample_measurement=_real, units_of_measure=_text, units_of_measure_code=_text,
    sample_duration=_text, sample_duration_code=_text, sample_frequency=_text,
    detection_limit=_real, uncertainty=_real, qualifier=_text, method_type=_text,
    method=_text, method_code=_text, state=_text, county=_text,
    date_of_last_change=_text, cbsa_code=_text, datetime_local=T.TimestampNTZType(),
)

# Payload form of the same rows: numbers arrive as text or numbers, so every field is read as text.
RAW_PAYLOAD_ROW = T.StructType([
    T.StructField(name, _text)
    for name in (
        "state_code", "county_code", "site_number", "parameter_code", "poc", "latitude", "longitude",
        "datum", "parameter", "date_gmt", "time_gmt", "date_local", "time_local",
        "sample_measurement", "units_of_measure", "mdl", "uncertainty", "state_name", "state", "county",
    )
])
ENVELOPE = T.StructType([
    T.StructField("Header", T.ArrayType(_schema(status=_text, error=_text, message=_text))),
    T.StructField("Data", T.ArrayType(RAW_PAYLOAD_ROW)),
])

WEATHER = _schema(
    station_id=_text, timestamp_utc=T.TimestampType(),
    temperature_2m=_real, wind_speed_10m=_real, relative_humidity_2m=_real,
)
WEATHER_PAYLOAD = T.StructType([
    T.StructField("hourly", T.StructType([
        T.StructField("time", T.ArrayType(_text)),
        T.StructField("temperature_2m", T.ArrayType(_real)),
        T.StructField("wind_speed_10m", T.ArrayType(_real)),
        T.StructField("relative_humidity_2m", T.ArrayType(_real)),
    ]))
])
CURRENT_WEATHER_PAYLOAD = T.StructType([
    T.StructField("main", _schema(temp=_text, humidity=_text)),
    T.StructField("wind", _schema(speed=_text)),
    T.StructField("weather", T.ArrayType(_schema(description=_text))),
    T.StructField("name", _text),
])
CURRENT_WEATHER_PAYLOAD_B = T.StructType([
    T.StructField("current", _schema(
        temperature_2m=_text, wind_speed_10m=_text, relative_humidity_2m=_text,
    ))
])

LIVE_OBSERVATIONS = T.StructType([
    T.StructField("Latitude", _real), T.StructField("Longitude", _real),
    T.StructField("UTC", _text), T.StructField("Parameter", _text), T.StructField("Unit", _text),
    T.StructField("Value", _text), T.StructField("RawConcentration", _text),
    T.StructField("AQI", T.IntegerType()), T.StructField("Category", T.IntegerType()),
    T.StructField("SiteName", _text), T.StructField("AgencyName", _text),
    T.StructField("FullAQSCode", _text),
])

REQUESTS = T.StructType([
    T.StructField("request_id", _whole),
    T.StructField("pollutant", _text), T.StructField("model", _text),
    T.StructField("station", _schema(latitude=_real, longitude=_real)),
    T.StructField("readings", T.StructType([
        *(T.StructField(name, _real) for name in (
            "lag_1h", "lag_24h", "lag_168h", "roll_24h_mean", "roll_24h_std",
            "roll_168h_mean", "roll_168h_std",
        )),
        T.StructField("drift_flag", T.IntegerType()),
    ])),
    T.StructField("prediction_time", T.TimestampType()),
])

METRIC = _schema(mae=_real, rmse=_real, r2=_real, n_test=_whole)
METRICS_TREE = T.MapType(_text, T.MapType(_text, METRIC))
STATE_METRIC = _schema(
    mae=_real, rmse=_real, r2=_real, n_test=_whole, region=_text, n_stations=_whole,
    flagged=T.BooleanType(),
)
REGION_METRIC = T.StructType([
    *METRIC.fields, T.StructField("n_stations", _whole), T.StructField("states", T.ArrayType(_text)),
])
AUDIT_TREE = T.MapType(_text, T.StructType([
    T.StructField("overall", METRIC),
    T.StructField("by_state", T.MapType(_text, STATE_METRIC)),
    T.StructField("by_region", T.MapType(_text, REGION_METRIC)),
]))
TIMED_RUNS = _schema(
    path=_text, run=T.IntegerType(), load=_real, clean=_real, features=_real, train=_real, total=_real,
)

DAILY_STATION = _schema(
    station_id=_text, date=_text, state=_text, county=_text, latitude=_real, longitude=_real,
    month=T.IntegerType(), season=T.IntegerType(),
    pm25_mean=_real, no2_mean=_real, ozone_mean=_real,
)
