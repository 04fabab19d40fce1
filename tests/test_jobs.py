"""Models and streams on small data."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hourgrid import constants as C
from hourgrid.operators import features
from hourgrid.plans import arima, scoring, training
from hourgrid.plans.staging import staged
from hourgrid.streaming import jobs
from tests.helpers import START, clean_frame, pulled, to_spark
from tests.test_live import scoring_request

SMALL = training.TrainSettings(gbt={"maxIter": 8, "maxDepth": 3}, forest={"numTrees": 8, "maxDepth": 4})


@pytest.fixture(scope="module")
def table(spark):
    """A daily wave with noise, which yesterday's value predicts."""
    n = 900
    rng = np.random.default_rng(0)
    wave = 20 + 8 * np.sin(2 * np.pi * np.arange(n) / 24)
    frame = clean_frame(n, pm25=wave + rng.normal(0, 0.5, n), ozone=wave / 500 + rng.normal(0, 0.001, n))
    return staged(features.build_features(to_spark(spark, frame), ["pm25", "ozone"]), "table")


@pytest.fixture(scope="module")
def trained(table):
    return training.train_and_evaluate(table, ("GradientBoosting", "RandomForest"), SMALL)


def test_learners_beat_the_mean(trained):
    rows = trained[1].collect()
    assert len(rows) == 4
    for r in rows:
        assert r.r2 > 0.5, r


def test_training_is_reproducible(table, trained):
    again = training.train_and_evaluate(table, ("GradientBoosting",), SMALL)[1]
    assert {(r.pollutant, r.mae) for r in again.collect()} == {(r.pollutant, r.mae) for r in trained[1].filter("model = 'GradientBoosting'").collect()}


def test_registered_fits_run_over_the_partitions_of_the_table(table, monkeypatch):
    from catalog import job_queries

    counts = []

    class Seen(training.Pipeline):
        def fit(self, rows):
            counts.append(rows.rdd.getNumPartitions())

    monkeypatch.setattr(training, "Pipeline", Seen)
    for train in training.TRAINERS.values():
        train(table.repartition(5), job_queries.FULL)
    assert counts == [5, 5]


def test_store_round_trip_and_batch_scoring(spark, tmp_path, trained):
    from hourgrid import schemas

    models = training.load_models(training.save_models(trained[0], str(tmp_path)), list(trained[0]))
    rows = [scoring_request(1, lag1=20.0, lag24=20.0, rest=20.0), scoring_request(2, model="RandomForest"),
            scoring_request(3, pollutant="so2"), scoring_request(4, rest=None)]
    responses, rejected = scoring.batch_predict(spark.createDataFrame(rows, schemas.REQUESTS), models, trained[1])
    got = {r.request_id: r for r in responses.collect()}
    assert set(got) == {1, 4} and 0 <= got[1].prediction_24h_ahead <= 2000
    assert got[1].model_metrics.n_test > 0 and got[1].features_used["lag_1h"] == 20.0
    assert got[1].target_time == "2024-01-11T12:00:00+00:00"
    assert {r.request_id for r in rejected.collect()} == {2, 3}


def test_cached_retrain_reads_the_stored_table(spark, tmp_path, table):
    path, built = str(tmp_path / "features"), []

    def build(_):
        built.append(1)
        return table

    first = training.cached_retrain(table, path, build, SMALL)[1].collect()
    second = training.cached_retrain(table, path, build, SMALL)[1].collect()
    assert len(built) == 1 and {tuple(r) for r in first} == {tuple(r) for r in second}


def test_series_model_recovers_its_coefficients(spark):
    n, rng = 6000, np.random.default_rng(2)
    shocks, d = rng.normal(0, 1, n), np.zeros(n)
    for i in range(2, n):
        d[i] = 0.5 * d[i - 1] - 0.2 * d[i - 2] + shocks[i] + 0.3 * shocks[i - 1]
    frame = pd.DataFrame({"station_id": "S", "pollutant": "pm25", "timestamp_utc": pd.date_range(START, periods=n, freq="h"), "value": 100 + d.cumsum()})
    row = arima.coefficients(to_spark(spark, frame)).first()
    # One shock lag is redundant here, so compare what the model implies: its first responses.
    a, b, t1, t2 = row.coefficients
    assert a + t1 == pytest.approx(0.8, abs=0.06)
    assert a * (a + t1) + b + t2 == pytest.approx(0.5 * 0.8 - 0.2, abs=0.08)
    assert row.state[0] == pytest.approx(frame["value"].iloc[-1]) and row.last_hour == frame["timestamp_utc"].iloc[-1].to_pydatetime()


def test_series_forecasts_cover_the_test_span(spark):
    frame = clean_frame(800, "A")
    short = clean_frame(300, "B")
    cutoffs = spark.createDataFrame([(p, (START + pd.Timedelta(hours=640)).to_pydatetime()) for p in C.POLLUTANTS], "pollutant string, cutoff timestamp")
    out = arima.station_forecasts(to_spark(spark, pd.concat([frame, short])), cutoffs)
    counts = {(r.station_id, r.pollutant): r["count"] for r in out.groupBy("station_id", "pollutant").count().collect()}
    assert counts == {("A", p): 160 for p in C.POLLUTANTS}
    assert out.filter("y_pred is null or y_true is null").count() == 0
    assert arima.stable_pair(1.2, 0.3) != (1.2, 0.3) and arima.stable_pair(0.5, 0.1) == (0.5, 0.1)


def test_explosive_series_are_reported_and_kept_as_estimated(spark):
    n, rng = 700, np.random.default_rng(4)
    d = np.zeros(n)
    for i in range(1, n):
        d[i] = 1.02 * d[i - 1] + rng.normal(0, 0.01)
    frame = clean_frame(n, "A", pm25=d.cumsum())
    cutoffs = spark.createDataFrame([("pm25", (START + pd.Timedelta(hours=640)).to_pydatetime())], "pollutant string, cutoff timestamp")
    found = {damp: arima.fitted_series(to_spark(spark, frame), cutoffs, ["pm25"], damp).first() for damp in (False, True)}
    assert not found[False].stationary and not found[True].stationary and found[False].steps == 60
    roots = {damp: max(abs(np.roots([1.0, -r.coefficients[0], -r.coefficients[1]]))) for damp, r in found.items()}
    assert roots[False] == pytest.approx(1.02, abs=0.005) and roots[True] == pytest.approx(0.99, abs=1e-6)


def test_series_sums_are_those_of_the_whole_series_and_a_station_without_readings_gives_none(spark):
    n = 3 * 2688 + 50
    value = np.random.default_rng(5).normal(50, 5, n).round(2)
    frame = clean_frame(n, "A", pm25=value, no2=np.full(n, np.nan), ozone=np.full(n, np.nan))
    cutoffs = spark.createDataFrame([(p, (START + pd.Timedelta(hours=n)).to_pydatetime()) for p in C.POLLUTANTS], "pollutant string, cutoff timestamp")
    rows = arima.long_regression(arima.training_rows(to_spark(spark, frame), cutoffs)).collect()
    assert [r.pollutant for r in rows] == ["pm25"]
    d = np.diff(value)
    width = arima.LONG_LAGS + 2
    lagged = np.stack([d[width - k:len(d) - k] for k in range(arima.LONG_LAGS + 1)])
    assert rows[0].rows == lagged.shape[1]
    assert np.allclose(rows[0].sums, (lagged @ lagged.T)[np.triu_indices(len(lagged))])
    assert np.allclose(rows[0].a, np.linalg.lstsq(lagged[1:].T, lagged[0], rcond=None)[0])


def test_the_history_meets_its_coefficients_without_another_shuffle(spark):
    rows = arima.long_series(to_spark(spark, clean_frame(800, "A")))
    plan = arima.coefficients(rows)._jdf.queryExecution().executedPlan().toString().splitlines()
    joins = [i for i, line in enumerate(plan) if "SortMergeJoin [station_id" in line and "_block" in line]
    # The left side, the history, comes straight from its windows.
    assert joins and all("Exchange" not in line for i in joins for line in plan[i + 1:i + 5])


def test_a_version_counts_once_its_manifest_is_written(spark, tmp_path, trained, monkeypatch):
    from hourgrid.plans import store

    root, (models, metrics) = str(tmp_path / "store"), trained
    learner = next(iter(models))[1]
    assert store.published(spark, root, (learner,)) is None
    first = store.publish(models, metrics, root, "table 1")
    found, measured = store.published(spark, root, (learner,), "table 1")
    assert set(found) == {k for k in models if k[1] == learner} and measured.count() == len(found)
    assert store.published(spark, root, (learner,), "table 2") is None and store.published(spark, root, ("Other",)) is None

    def killed(*_, **__):
        raise KeyboardInterrupt

    monkeypatch.setattr(store.json, "dumps", killed)  # after the models have been written
    with pytest.raises(KeyboardInterrupt):
        store.publish(models, metrics, root, "table 1")
    monkeypatch.undo()
    assert [r.version for r in store.manifest(spark, root).collect()] == [first]
    assert set(store.published(spark, root, (learner,))[0]) == set(found)
    second = store.publish(models, metrics, root, "table 2")
    assert {r.version for r in store.manifest(spark, root).collect()} == {first, second}
    assert store.published(spark, root, (learner,), "table 1") is not None
    table = spark.range(5).selectExpr("id", "id * 2 as b")
    assert store.fingerprint(table) == store.fingerprint(table.orderBy(F.desc("id")).repartition(3)) != store.fingerprint(table.limit(4))


MEASURED = "station_id string, pollutant string, timestamp_utc timestamp, value double"


def arrive(spark, path, hours, value=1.0):
    rows = [("S", "pm25", (START + pd.Timedelta(hours=h, minutes=m)).to_pydatetime(), value + h) for h in hours for m in (5, 35)]
    spark.createDataFrame(rows, MEASURED).coalesce(1).write.mode("append").parquet(path)


def test_hourly_means_drop_late_readings(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for hours in (range(100, 110), range(3), range(110, 115)):
        arrive(spark, source, hours)
        jobs.run(jobs.to_table(jobs.hourly_means(jobs.read_stream(spark, source, MEASURED)), out, state))
    rows = pulled(spark.read.parquet(out))
    hours = [int((t - START).total_seconds() // 3600) for t in rows["timestamp_utc"]]
    assert hours == list(range(100, 112)) and (rows["readings"] == 2).all()
    assert rows["value"].tolist() == [1.0 + h for h in hours]


def test_streamed_features_equal_batch_ones(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    rng = np.random.default_rng(3)
    values = pd.Series(rng.uniform(1, 9, 400), index=range(400))
    missing = set(rng.choice(400, 60, replace=False).tolist())
    for start in (0, 150, 300):
        rows = [("S", "pm25", (START + pd.Timedelta(hours=h)).to_pydatetime(), float(values[h])) for h in range(start, min(start + 150, 400)) if h not in missing]
        spark.createDataFrame(rows, MEASURED).write.mode("append").parquet(source)
        jobs.run(jobs.to_table(jobs.live_features(jobs.read_stream(spark, source, MEASURED)), out, state))
    got = pulled(spark.read.parquet(out))
    known = values.where(~values.index.isin(missing))
    assert len(got) == 400 - len(missing)
    hours = ((got["timestamp_utc"] - START).dt.total_seconds() // 3600).astype(int)
    past = known.shift(1)
    want = {"lag_1h": past, "lag_24h": known.shift(24), "lag_168h": known.shift(168),
            "roll_24h_mean": past.rolling(24, min_periods=2).mean(), "roll_168h_std": past.rolling(168, min_periods=2).std(ddof=0)}
    for name, expected in want.items():
        assert np.allclose(got[name], expected.loc[hours].values, equal_nan=True), name


def test_hours_out_of_order_are_all_emitted_in_order(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for hours in (range(30, 60), range(30)):
        rows = [("S", "pm25", (START + pd.Timedelta(hours=h)).to_pydatetime(), float(h)) for h in hours]
        spark.createDataFrame(rows, MEASURED).coalesce(1).write.mode("append").parquet(source)
    stream = jobs.read_stream(spark, source, MEASURED, files_per_trigger=1)
    jobs.run(jobs.to_table(jobs.live_features(stream), out, state))
    got = pulled(spark.read.parquet(out)).sort_values("timestamp_utc")
    hours = ((got["timestamp_utc"] - START).dt.total_seconds() // 3600).astype(int)
    assert hours.tolist() == list(range(60))
    # The later file came first; its hours still see the earlier ones.
    assert np.allclose(got["lag_24h"], [h - 24 if h >= 24 else np.nan for h in range(60)], equal_nan=True)


def test_an_hour_behind_the_watermark_is_emitted_late(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for hours in (range(10, 20), range(5), range(20, 22)):
        rows = [("S", "pm25", (START + pd.Timedelta(hours=h)).to_pydatetime(), float(h)) for h in hours]
        spark.createDataFrame(rows, MEASURED).write.mode("append").parquet(source)
        jobs.run(jobs.to_table(jobs.live_features(jobs.read_stream(spark, source, MEASURED)), out, state))
    got = pulled(spark.read.parquet(out))
    hours = ((got["timestamp_utc"] - START).dt.total_seconds() // 3600).astype(int)
    assert sorted(hours) == [*range(5), *range(10, 22)]


class Rows:
    """Map state of one series in a dictionary."""

    def __init__(self):
        self.rows = {}

    def getMapState(self, *_):
        return self

    def containsKey(self, key):
        return key in self.rows

    def getValue(self, key):
        return self.rows[key]

    def updateValue(self, key, value):
        self.rows[key] = value

    def removeKey(self, key):
        del self.rows[key]


def test_days_of_a_series_are_held_a_few_at_a_time():
    rng, rows = np.random.default_rng(8), Rows()
    days, want = jobs.DayState(rows), {}
    for hour in rng.integers(0, 24 * 400, 5000).tolist():
        assert days.put(hour, hour / 2 if hour % 9 else None) == (hour not in want)
        want[hour] = hour / 2 if hour % 9 else np.nan
        assert len(days._held) <= jobs.HELD_DAYS
    for start in rng.integers(200, 24 * 390, 50).tolist():
        expected = [want[h] for h in range(start, start + 168) if h in want and want[h] == want[h]]
        assert days.span(start, start + 168).tolist() == expected and len(days._held) <= jobs.HELD_DAYS
    first = min(want)
    assert days.waiting(first // 24)[0] == first
    days.emitted(first)
    days.forget_held()
    assert first not in days.waiting(first // 24) and not days.put(first, 7.0) and days.get(first) == 7.0
    days.drop(first // 24)
    assert days.waiting(first // 24) == [] and days.put(first, 1.0)


def test_a_long_backfill_gives_the_same_rows_in_one_and_in_many_triggers(spark, tmp_path):
    rng = np.random.default_rng(6)
    hours = [h for h in range(24 * 365 * 2) if rng.random() < 0.9 and not 3000 < h < 5000]
    rows = [("S", "pm25", (START + pd.Timedelta(hours=h)).to_pydatetime(), float(rng.uniform(1, 9))) for h in hours]
    results = []
    for parts in (1, 4):
        source, out, state = (str(tmp_path / f"{x}{parts}") for x in ("in", "out", "state"))
        for k in range(parts):
            part = rows[k * len(rows) // parts:(k + 1) * len(rows) // parts]
            spark.createDataFrame(part, MEASURED).repartition(2).write.mode("append").parquet(source)
            jobs.run(jobs.to_table(jobs.live_features(jobs.read_stream(spark, source, MEASURED)), out, state))
        results.append(pulled(spark.read.parquet(out)).sort_values("timestamp_utc", ignore_index=True))
    one, many = results
    assert len(one) == len(hours)
    pd.testing.assert_frame_equal(one, many)


def test_rolling_of_any_width_equals_a_direct_one(spark, tmp_path):
    rng = np.random.default_rng(5)
    hours = sorted(rng.choice(500, 350, replace=False).tolist())
    value = dict(zip(hours, rng.uniform(1, 9, 350).tolist(), strict=True))
    for width in (24, 200):
        source, out, state = (str(tmp_path / f"{x}{width}") for x in ("in", "out", "state"))
        for part in (hours[:120], hours[120:121], hours[121:]):
            spark.createDataFrame([("S", "pm25", (START + pd.Timedelta(hours=h)).to_pydatetime(), value[h]) for h in part], MEASURED).write.mode("append").parquet(source)
            jobs.run(jobs.to_table(jobs.rolling_means(jobs.read_stream(spark, source, MEASURED), width), out, state))
        got = {int((r.timestamp_utc - START.to_pydatetime()).total_seconds() // 3600): (r["mean"], r["std"], r.hours) for r in spark.read.parquet(out).collect()}
        want = {}
        for t in range(hours[0] + 1, hours[-1] - 2 + 1):
            inside = [value[h] for h in range(t - width, t) if h in value]
            if len(inside) >= 2:
                want[t] = (pytest.approx(np.mean(inside)), pytest.approx(np.std(inside)), len(inside))
        assert got == want


def test_streamed_scores(spark, tmp_path, trained):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    rows = [("S", "pm25", (START + pd.Timedelta(hours=h)).to_pydatetime(), 20.0) for h in range(40)]
    spark.createDataFrame(rows, MEASURED).write.parquet(source)
    places = spark.createDataFrame([("S", 34.0, -118.0)], "station_id string, latitude double, longitude double")
    stream = jobs.live_features(jobs.read_stream(spark, source, MEASURED))
    jobs.run(jobs.to_batches(stream, out, state, lambda batch: jobs.scored(batch, places, trained[0])))
    scored = spark.read.parquet(out)
    assert scored.count() == 16 and scored.filter("prediction is null").count() == 0


def test_spans_of_a_day_read_their_hours_once():
    rng = np.random.default_rng(0)
    values = np.where(rng.random(400) < 0.4, np.nan, rng.normal(size=400))
    reads = []

    class Days:
        def hours(self, start, end):
            reads.append((start, end))
            return np.array([values[h] if 0 <= h < 400 else np.nan for h in range(start, end)])

    processor = jobs._Rolling(168)
    processor.days, state = Days(), [1]
    rows = list(processor.ready(state, 399, 500 * jobs.HOUR_MS))
    assert state == [501] and len(reads) == -(-500 // 24)
    direct = []
    for t in range(1, 501):
        inside = values[max(0, t - 168):t]
        inside = inside[~np.isnan(inside)]
        if len(inside) >= 2:
            direct.append((t, inside.mean(), inside.std(), len(inside)))
    assert [(r[0].value // 3_600_000_000_000, r[3]) for r in rows] == [(t, n) for t, _, _, n in direct]
    assert np.allclose([r[1:3] for r in rows], [d[1:3] for d in direct])
