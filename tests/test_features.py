from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hourgrid import constants as C
from hourgrid.functions import scalar as S
from hourgrid.operators import cleaning, features, live, weather
from hourgrid.operators import timeblocks as B
from tests.helpers import START, clean_frame, pulled, series, to_spark

WX = list(C.WEATHER_COLUMNS)


def with_weather(frame):
    return frame.assign(temperature_2m=15.0, wind_speed_10m=3.0, relative_humidity_2m=50.0)


@pytest.fixture(scope="module")
def built(spark):
    frame = with_weather(clean_frame(500))
    return frame, pulled(features.build_features(to_spark(spark, frame), ["pm25"]))


def test_all_columns_are_present(built):
    assert set(C.FEATURES) <= set(built[1].columns) and len(C.FEATURES) == 20
    assert not built[1][list(C.FEATURES) + ["target"]].isna().any().any()


def test_target_is_the_value_a_day_ahead(built):
    frame, out = built
    row = out.iloc[50]
    assert row.target == frame.set_index("timestamp_utc").loc[row.timestamp_utc + pd.Timedelta(hours=24), "pm25"]


def test_rolling_mean_excludes_the_row(built):
    frame, out = built
    row = out.iloc[100]
    past = frame[(frame.timestamp_utc < row.timestamp_utc) & (frame.timestamp_utc >= row.timestamp_utc - pd.Timedelta(hours=24))]
    assert row.roll_24h_mean == pytest.approx(past["pm25"].mean())


def test_both_ends_are_dropped(built):
    frame, out = built
    assert out.timestamp_utc.min() >= frame.timestamp_utc.iloc[24]
    assert out.timestamp_utc.max() <= frame.timestamp_utc.iloc[-25]


def test_types_and_ranges(built):
    _, out = built
    assert out["season"].between(0, 3).all() and set(out["drift_flag"]) == {0}
    for name in ("hour_sin", "dow_cos", "month_sin"):
        assert out[name].abs().le(1).all()


def test_absent_weather_passes_as_null(spark):
    out = pulled(features.build_features(to_spark(spark, clean_frame(400)), ["pm25"]))
    assert len(out) > 0 and out[WX].isna().all().all()


def test_present_weather_is_required(spark):
    frame = with_weather(clean_frame(400))
    frame.loc[300:309, "temperature_2m"] = np.nan
    df = to_spark(spark, frame)
    strict = features.build_features(df, ["pm25"]).count()
    assert features.build_features(df, ["pm25"], weather="optional").count() == strict + 10
    audit = features.feature_audit(df, ["pm25"]).first()
    assert (audit.usable_rows, audit.weather_null_dropped, audit.stations_used) == (strict, 10, 1)


def test_sparse_stations_are_skipped(spark):
    a, b = clean_frame(500, "AAA"), clean_frame(500, "BBB")
    b["pm25"] = np.nan
    b.loc[:50, "pm25"] = 1.0
    out = pulled(features.build_features(to_spark(spark, pd.concat([a, b])), ["pm25"], min_readings=100))
    assert set(out.station_id) == {"AAA"}


@pytest.mark.parametrize("gaps", [0.2, 0.6])
def test_series_features_match_an_array_library_across_blocks(spark, gaps):
    n = 2 * B.BLOCK_HOURS + 700
    values = series(n, 5, gaps)
    values[3000:3100] = 4.0
    frame = clean_frame(n, pm25=values)
    out = pulled(features.feature_rows(to_spark(spark, frame), ["pm25"]))
    s = pd.Series(values)
    past = s.shift(1)
    week = past.rolling(168, min_periods=84).mean()
    want = {
        "lag_1h": s.shift(1), "lag_24h": s.shift(24), "lag_168h": s.shift(168).fillna(week), "target": s.shift(-24),
        "roll_24h_mean": past.rolling(24, min_periods=12).mean(), "roll_24h_std": past.rolling(24, min_periods=12).std(),
        "roll_168h_mean": week, "roll_168h_std": past.rolling(168, min_periods=84).std(),
    }
    assert len(out) == n
    for name, expected in want.items():
        assert np.allclose(out[name], expected, equal_nan=True, atol=1e-9), name


def test_frames_wider_than_a_week_see_all_their_rows(spark):
    n = 2 * B.BLOCK_HOURS + 700
    values = series(n, 3, 0.3)
    frame = pd.DataFrame({"station_id": "S", "timestamp_utc": pd.date_range(START, periods=n, freq="h"), "v": values})
    s, df = pd.Series(values), to_spark(spark, frame)
    assert np.allclose(pulled(features.lags(df, "v", (720,)))["lag_720h"], s.shift(720), equal_nan=True)
    assert np.allclose(pulled(features.target_lead(df, "v", 720))["target"], s.shift(-720), equal_nan=True)
    out = pulled(live.rolling_range_stats(df, "v", 720, None))
    assert np.allclose(out["mean_720h"], s.shift(1).rolling(720, min_periods=2).mean(), equal_nan=True, atol=1e-9)


@pytest.mark.parametrize("where", [500, B.BLOCK_HOURS - 200, B.BLOCK_HOURS - 600])
def test_long_fills_cross_block_edges(spark, where):
    n = 2 * B.BLOCK_HOURS
    values = np.arange(n, dtype=float)
    values[where:where + 900] = np.nan
    frame = pd.DataFrame({"station_id": "S", "timestamp_utc": pd.date_range(START, periods=n, freq="h"), "v": values})
    out = pulled(cleaning.interpolate_gaps(to_spark(spark, frame), ["v"], limit=400))
    want = pd.Series(np.arange(n, dtype=float))
    want[where + 400:where + 900] = np.nan
    assert np.allclose(out["v"], want, equal_nan=True)


def test_fill_both_ways_across_blocks(spark):
    n = 2 * B.BLOCK_HOURS + 100
    values = series(n, 9, 0.9995)
    values[:40] = np.nan
    frame = pd.DataFrame({"station_id": "S", "timestamp_utc": pd.date_range(START, periods=n, freq="h"), "v": values})
    out = pulled(features.fill_both_ways(to_spark(spark, frame), "v"))
    assert np.allclose(out["v"], pd.Series(values).ffill().bfill(), equal_nan=True)


def test_seasons(spark):
    df = spark.range(1, 13).select(S.season_quarter(F.col("id")).alias("q"), S.season_meteo(F.col("id")).alias("m"))
    rows = df.collect()
    assert [r.q for r in rows] == [0, 0, 0, 1, 1, 1, 2, 2, 2, 3, 3, 3]
    assert [r.m for r in rows] == [0, 0, 1, 1, 1, 2, 2, 2, 3, 3, 3, 0]


def test_weekday_starts_on_monday(spark):
    df = spark.sql("select timestamp'2024-01-01 00:00:00' as t")
    row = df.select(*(c.alias(k) for k, c in S.calendar_features(F.col("t")).items())).first()
    assert row.dow_sin == 0.0 and row.dow_cos == 1.0


def test_duplicate_weather_does_not_multiply_rows(spark):
    clean = clean_frame(3)[["station_id", "timestamp_utc", "pm25"]]
    wx = with_weather(pd.concat([clean, clean]))[["station_id", "timestamp_utc", *WX]]
    out = weather.join_weather(to_spark(spark, clean), to_spark(spark, wx))
    assert out.count() == 3 and out.filter("temperature_2m = 15").count() == 3


def test_weather_payloads(spark):
    payloads = spark.createDataFrame([
        ("A", '{"hourly": {"time": ["2023-01-01T00:00", "2023-01-01T01:00"], "temperature_2m": [1.5, null]}}'),
        ("B", '{"hourly": {"time": []}}'), ("C", "{}"),
    ], "station_id string, payload string")
    rows = pulled(weather.explode_hourly_payload(payloads))
    assert len(rows) == 2 and rows["temperature_2m"].tolist()[0] == 1.5 and rows["relative_humidity_2m"].isna().all()


def test_current_weather_defaults_and_errors(spark):
    payloads = spark.createDataFrame([
        (1, '{"main": {"temp": 20.04, "humidity": 55}, "wind": {"speed": 3.26}, "weather": [{"description": "clear"}], "name": "X"}'),
        (2, "{}"), (3, '{"main": {"temp": "warm"}}'), (4, "no json"),
    ], "request_id int, payload string")
    a, b, c, d = weather.flatten_current(payloads).orderBy("request_id").collect()
    assert (a.temp_c, a.wind_speed_ms, a.humidity_pct, a.conditions, a.station_name, a.error) == (20.0, 3.3, 55, "clear", "X", None)
    assert (b.temp_c, b.wind_speed_ms, b.conditions, b.station_name, b.error) == (None, 0.0, "unknown", "unknown", None)
    assert c.error == "Parse error: temp" and c.wind_speed_ms is None
    assert d.error is not None


def test_rows_meet_their_stations_readings_before_they_become_one_per_pollutant(spark):
    plan = features.feature_rows(to_spark(spark, clean_frame(300, "A")))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Union" in plan


def test_only_pollutants_with_enough_readings_give_rows_in_every_block(spark):
    n = 2688 + 400
    few = np.where(np.arange(n) < 30, 5.0, np.nan)
    frame = pd.concat([clean_frame(n, "A", no2=few), clean_frame(40, "B")])
    rows = features.feature_rows(to_spark(spark, frame), min_readings=200)
    counts = {(r.station_id, r.pollutant): r["count"] for r in rows.groupBy("station_id", "pollutant").count().collect()}
    assert counts == {("A", "pm25"): n, ("A", "ozone"): n}
    assert features.feature_rows(to_spark(spark, frame).limit(0)).count() == 0


def test_the_smallest_weather_row_stays_and_one_sort_finds_it(spark):
    time = pd.Timestamp("2024-01-01").to_pydatetime()
    rows = [("A", time, 2.0, 1.0, 1.0), ("A", time, None, 9.0, 9.0), ("A", time, None, 9.0, 3.0), ("B", time, 2.0, 1.0, 5.0),
            ("B", time, 2.0, 1.0, 4.0), ("B", time, 2.0, 1.0, 4.0)]
    table = spark.createDataFrame(rows, "station_id string, timestamp_utc timestamp, temperature_2m double, wind_speed_10m double, relative_humidity_2m double")
    kept = weather.deduplicate(table)
    assert {r.station_id: tuple(r)[2:] for r in kept.collect()} == {"A": (None, 9.0, 3.0), "B": (2.0, 1.0, 4.0)}
    clean = to_spark(spark, clean_frame(5, "A")).select("station_id", "timestamp_utc", "pm25")
    joined = weather.join_weather(clean.hint("merge"), table)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and plan.count("Sort [") == 2 and plan.count("Exchange") == 2
