from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from hourgrid import constants as C
from hourgrid import schemas
from hourgrid.functions import scalar as S
from hourgrid.operators import live, weather
from hourgrid.operators import requests as R

END = dt.datetime(2024, 1, 10, 12)


def observation(lat=34.0, lon=-118.0, hour=END, parameter="PM2.5", unit="UG/M3", value="1.0", raw=None, site="A", code="1"):
    return (lat, lon, hour.strftime("%Y-%m-%dT%H:%M") if isinstance(hour, dt.datetime) else hour, parameter, unit, value, raw, None, None, site, None, code)


def table(spark, rows):
    return spark.createDataFrame(rows, schemas.LIVE_OBSERVATIONS)


def ask(spark, *rows):
    return spark.createDataFrame(
        [(i, p, lat, lon, end) for i, (p, lat, lon, end) in enumerate(rows)],
        "request_id bigint, pollutant string, latitude double, longitude double, end_hour timestamp")


ONE = ("pm25", 34.0, -118.0, END)


def test_values_fall_back_and_bad_ones_are_dropped(spark):
    rows = [observation(value="1.5"), observation(raw="2.5"), observation(value="x"), observation(value="-1"),
            observation(hour="soon"), observation(value=None)]
    got = [r.value for r in live.readings(table(spark, rows)).collect()]
    assert got == [1.5, 2.5, None, None, None]


def test_range_join_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    n = 800
    lat, lon = 34 + rng.uniform(-0.6, 0.6, n).round(2), -118 + rng.uniform(-0.7, 0.7, n).round(2)
    back = rng.integers(-5, 200, n)
    obs = [observation(float(a), float(o), END - dt.timedelta(hours=int(h)), code=str(i)) for i, (a, o, h) in enumerate(zip(lat, lon, back))]
    asked = [("pm25", float(a), float(o), END - dt.timedelta(hours=int(h))) for a, o, h in zip(34 + rng.uniform(-0.5, 0.5, 30), -118 + rng.uniform(-0.5, 0.5, 30), rng.integers(0, 60, 30))]
    got = live.nearby(ask(spark, *asked), live.site_hours(live.readings(table(spark, obs)))).select("request_id", F.inline("entries")).groupBy("request_id").agg(F.sum("n_raw").alias("n")).collect()
    want = {}
    for i, (_, a, o, end) in enumerate(asked):
        hours = np.array([(end - (END - dt.timedelta(hours=int(h)))).total_seconds() / 3600 for h in back])
        inside = ((lat >= round(a - 0.15, 4)) & (lat <= round(a + 0.15, 4)) & (lon >= round(o - 0.18, 4)) & (lon <= round(o + 0.18, 4)) & (hours >= 0) & (hours <= 170))
        if inside.sum():
            want[i] = int(inside.sum())
    assert {r.request_id: r.n for r in got} == want and len(want) > 10


def test_joined_rows_follow_places_not_requests(spark):
    obs = [observation(34.0 + 0.01 * k, hour=END - dt.timedelta(hours=h), code=str(k)) for k in range(5) for h in range(200)]
    asked = [("pm25", 34.0, -118.0, END - dt.timedelta(hours=h % 30)) for h in range(300)] + [("no2", 10.0, 10.0, END)]
    sites = live.site_hours(live.readings(table(spark, obs)))
    requests = ask(spark, *asked)
    index = live.place_hours(live.place_days(requests), sites)
    assert index.count() == 200 and {len(r.entries) for r in index.collect()} == {1}
    assert index.agg(F.sum(F.col("entries")[0]["n_raw"])).first()[0] == 1000
    hours = live.nearby(requests, sites).groupBy("request_id").count().collect()
    assert len(hours) == 300 and {r["count"] for r in hours} == {171}


@pytest.mark.parametrize("unit, expected", [("PPB", 0.06), (None, 0.06), (" ppm ", 60.0), ("mg", 60.0)])
def test_ozone_units(spark, unit, expected):
    rows = [observation(parameter="OZONE", unit=None, value="60", hour=END - dt.timedelta(hours=1)), observation(parameter="OZONE", unit=unit, value="60")]
    hours = live.hourly_area_mean(live.nearby(ask(spark, ("ozone", *ONE[1:])), live.site_hours(live.readings(table(spark, rows)))))
    assert {r.value for r in hours.collect()} == {expected}
    assert hours.first().unit_warning == (unit == "mg")


def test_features_of_one_request_equal_direct_ones(spark):
    rng = np.random.default_rng(1)
    values = {END - dt.timedelta(hours=int(h)): [float(v) for v in rng.uniform(1, 50, 2).round(2)] for h in range(3, 171) if rng.random() < 0.8 or h in (3, 4, 27)}
    obs = [observation(34.0 + 0.1 * k, value=str(v), hour=t, site=f"s{k}", code=str(k)) for t, pair in values.items() for k, v in enumerate(pair)]
    obs += [observation(parameter="CO", value="1"), observation(36.0, value="999")]
    row = live.live_features(ask(spark, ONE), table(spark, obs)).first()
    mean = {t: round(sum(p) / 2, 4) for t, p in values.items()}
    t0 = max(mean)
    assert row.status == "ok" and row.latest_hour == t0 and row.target_time == t0 + dt.timedelta(hours=24)
    for k in (1, 24, 168):
        want = mean.get(t0 - dt.timedelta(hours=k))
        assert row[f"lag_{k}h"] == (pytest.approx(want, abs=1e-4) if want is not None else None)
    for width in (24, 168):
        inside = [v for t, v in mean.items() if t0 - dt.timedelta(hours=width) <= t < t0]
        assert row[f"roll_{width}h_mean"] == pytest.approx(np.mean(inside), abs=1e-4)
        assert row[f"roll_{width}h_std"] == pytest.approx(np.std(inside), abs=1e-4)
    assert row.n_raw_obs == len(obs) - 1 and row.sources == ["s0", "s1"]
    assert row.coverage_hours == len(mean) and row.missing_hours == 171 - len(mean)
    assert set(row.features_used) == set(C.FEATURES)
    assert row.feature_provenance["latitude"] == "input" and row.feature_provenance["drift_flag"] == live.ASSUMED
    assert row.feature_provenance["temperature_2m"] == live.UNAVAILABLE


def test_rejected_requests_say_why(spark):
    rows = [observation(parameter="NO2"), observation(hour=END), observation(hour=END - dt.timedelta(hours=1))]
    out = live.live_features(ask(spark, ONE, ("ozone", *ONE[1:]), ("pm25", 10.0, 10.0, END)), table(spark, rows)).orderBy("request_id").collect()
    assert [r.status for r in out] == ["missing essential lags", "no observations", "no observations"]
    warnings = [[tuple(w) for w in r.warnings] for r in out]
    assert ("lag_missing", "lag_24h", None) in warnings[0] and ("hours_missing", None, 169) in warnings[0]
    assert ("few_values", "roll_168h_mean", 1) in warnings[0]
    assert warnings[1] == [("other_parameters_only", None, 3)] and out[1].parameters_seen == ["NO2", "PM2.5"]
    assert warnings[2] == [("no_records", None, 0)]
    assert (out[1].missing_hours, out[2].n_raw_obs) == (0, 0)


def test_provenance_totals(spark):
    rows = [observation(hour=END - dt.timedelta(hours=h)) for h in range(30)]
    row = live.provenance_counts(live.live_features(ask(spark, ONE), table(spark, rows))).first()
    assert (row.live, row.derived, row.unavailable, row.assumed, row.total) == (2, 11, 4, 1, 20)


def test_weather_falls_back_as_a_whole(spark):
    asked = spark.range(4).selectExpr("id as request_id")
    schema = "request_id bigint, temp_c double, wind_speed_ms double, humidity_pct double, error string"
    first = spark.createDataFrame([(0, 1.0, None, 3.0, None), (1, None, None, None, "x"), (2, None, None, None, "x")], schema)
    second = spark.createDataFrame([(0, 9.0, 9.0, 9.0, None), (1, 8.0, 8.0, 8.0, None), (2, None, None, None, "down")], schema)
    a, b, c, d = weather.weather_fallback(asked, first, second).orderBy("request_id").collect()
    assert (a.temperature_2m, a.wind_speed_10m, a.weather_source) == (1.0, None, "provider A")
    assert (b.temperature_2m, b.weather_source, b.weather_error) == (8.0, "provider B", None)
    assert c.weather_error == "all weather sources failed: down" and d.weather_error == "all weather sources failed: no answer"


def scoring_request(i=1, pollutant="pm25", model=None, lat=34.0, lon=-118.0, lag1=1.0, lag24=2.0, rest=3.0, flag=0):
    return (i, pollutant, model, (lat, lon), (lag1, lag24, rest, rest, rest, rest, rest, flag), END)


def test_requests_are_validated(spark):
    rows = [scoring_request(1), scoring_request(2, pollutant="so2", lat=91.0), scoring_request(3, model="Other", lag1=None, flag=2),
            scoring_request(4, lon=None), scoring_request(5, flag=None)]
    valid, rejected = R.validate_requests(spark.createDataFrame(rows, schemas.REQUESTS))
    assert [r.request_id for r in valid.collect()] == [1, 5]
    errors = {r.request_id: r.errors for r in rejected.collect()}
    assert [e.split(":")[0] for e in errors[2]] == ["pollutant", "station.latitude"]
    assert [e.split(":")[0] for e in errors[3]] == ["model", "readings.lag_1h", "readings.drift_flag"]
    assert len(errors[4]) == 1


def test_forest_needs_every_feature(spark):
    rows = [scoring_request(1, model="RandomForest"), scoring_request(2)]
    fine, refused = R.reject_missing(R.assemble_features(spark.createDataFrame(rows, schemas.REQUESTS)))
    assert [r.request_id for r in fine.collect()] == [2]
    assert refused.first().missing_features == list(C.WEATHER_COLUMNS)


def test_clipping_keeps_missing_values_missing(spark):
    df = spark.createDataFrame([(5000.0,), (-1.0,), (3.14159,), (None,), (float("nan"),)], "v double")
    assert [r.c for r in df.select(S.clip(F.col("v"), F.lit("pm25")).alias("c")).collect()] == [2000.0, 0.0, 3.1416, None, None]


def test_a_question_is_worked_out_once_whoever_asks_it(spark, monkeypatch):
    rows = [observation(hour=END - dt.timedelta(hours=k), value=str(k)) for k in range(30)]
    asked, nearby = [], live.nearby
    monkeypatch.setattr(live, "nearby", lambda requests, *more: asked.append(requests.count()) or nearby(requests, *more))
    requests = ask(spark, ONE, ONE, (None, *ONE[1:]), ("pm25", None, *ONE[2:]), ONE)
    out = live.live_features(requests, table(spark, rows)).orderBy("request_id").collect()
    assert asked == [3]
    assert [(r.request_id, r.status, r.n_raw_obs, r.lag_24h) for r in out] == [
        (0, "ok", 30, 24.0), (1, "ok", 30, 24.0), (2, "no observations", 30, None), (3, "no observations", 0, None), (4, "ok", 30, 24.0)]


def test_grids_of_questions_meet_all_their_requests(spark, monkeypatch):
    from catalog import QUERIES, ingest_queries as Q

    rows = [observation(hour=END - dt.timedelta(hours=k), value=str(k)) for k in range(30)]
    asked, nearby = [], live.nearby
    monkeypatch.setattr(live, "nearby", lambda requests, *more: asked.append(requests.count()) or nearby(requests, *more))
    monkeypatch.setattr(Q.A, "live_requests", lambda *_: ask(spark, ONE, ONE, ONE))
    monkeypatch.setattr(Q.A, "observations", lambda *_: table(spark, rows))
    grid = QUERIES["request_grid"](spark, "").groupBy("request_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s")).collect()
    assert asked == [1]
    assert sorted(map(tuple, grid)) == [(i, C.HISTORY_HOURS + 1, sum(range(30))) for i in range(3)]


class Constant:
    """A model that always says the same."""

    def transform(self, rows):
        return rows.withColumn("forecast", F.lit(5.0))


def test_names_of_sites_are_stored_once_for_each_question(spark, monkeypatch):
    from catalog import QUERIES
    from catalog import job_queries as Q
    from hourgrid.plans import scoring

    obs = [observation(34.0 + 0.01 * k, hour=END - dt.timedelta(hours=h), site=f"S{k}", code=str(k)) for k in range(4) for h in range(30)]
    asked = ask(spark, *[ONE] * 6, ("no2", 34.0, -118.0, END), ("pm25", 10.0, 10.0, END), ("pm25", 34.0, -118.0, END - dt.timedelta(hours=1)))
    seen = asked.select("request_id", F.lit(20.0).alias("temp_c"), F.lit(1.0).alias("wind_speed_ms"), F.lit(30).alias("humidity_pct"), F.lit(None).cast("string").alias("error"))
    forecast = weather.weather_fallback(asked, seen.filter("request_id % 2 = 0"), seen.filter("request_id = 1"))
    models = {("pm25", C.REQUEST_MODELS[0]): Constant()}
    metrics = spark.createDataFrame([("pm25", C.REQUEST_MODELS[0], 1.0, 2.0, 0.5, 9)], "pollutant string, model string, mae double, rmse double, r2 double, n_test long")
    whole = live.live_features(asked, table(spark, obs), forecast, digits=None)
    want = scoring.live_predict(whole, models, metrics)
    stored, asked_sources = {}, []

    def staged(df, label):
        stored[label] = df.columns
        return df

    monkeypatch.setattr(Q, "staged", staged)
    monkeypatch.setattr(Q, "trained", lambda *_: (models, metrics))
    monkeypatch.setattr(Q, "live_weather", lambda *_: forecast)
    monkeypatch.setattr(Q.A, "live_requests", lambda *_: asked)
    monkeypatch.setattr(Q.A, "observations", lambda *_: table(spark, obs))
    predict = scoring.live_predict

    def told(*args):
        asked_sources.append(predict(*args))
        return asked_sources[-1]

    monkeypatch.setattr(Q.scoring, "live_predict", told)
    rows = QUERIES["live_predict"](spark, "sf").collect()
    assert "_sources" in stored["answers"] and not {"sources", "_sources", "_names"} & set(stored["live"])
    assert sorted(r.request_id for r in rows) == [0, 1, 2, 3, 4, 5, 8]
    # The records are those of rows that hold their names.
    columns = [c for c in want.columns if c not in ("features_used", "feature_provenance")]
    got = asked_sources[0]
    assert got.columns == want.columns
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))
    assert {tuple(r[0]) for r in got.select("data_sources.observations.reporting_areas").collect()} == {("S0", "S1", "S2", "S3")}


def test_no_row_that_holds_names_of_sites_is_dealt_out_again(spark, monkeypatch):
    asked = ask(spark, ONE)
    told = asked.select("request_id", *(F.lit(1.0).alias(c) for c in C.WEATHER_COLUMNS), F.lit("A").alias("weather_source"), F.lit(None).cast("string").alias("weather_error"))
    monkeypatch.setattr(live, "question_answers", lambda requests, *_: live.questions(requests).select("request_id", *(
        F.lit(None).cast(t).alias(c) for c, t in (("_sources", "array<string>"), ("_seen", "array<string>"), ("_raw", "long"), ("_mine", "long"), ("_covered", "long"),
                                                  ("_t0", "long"), ("_week_count", "long"), ("_unit_warning", "boolean"))), *(
        F.lit(None).cast("double").alias(c) for c in ("lag_1h", "lag_24h", "lag_168h", "roll_24h_mean", "roll_24h_std", "roll_168h_mean", "roll_168h_std"))))
    plan = live.live_features(asked, None, told)._jdf.queryExecution().analyzed().toString().splitlines()
    depth = {name: min(len(line) - len(line.lstrip(" :+-")) for line in plan if "Join LeftOuter" in line and name in line) for name in ("_question", "(request_id")}
    assert depth["_question"] < depth["(request_id"]
