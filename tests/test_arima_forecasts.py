"""Forecast recursions of many series at once."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd

from hourgrid.plans import arima

LAST = dt.datetime(2024, 1, 1)


def test_recursions_side_by_side_equal_one_after_another(monkeypatch):
    rng = np.random.default_rng(5)
    frame = pd.DataFrame({
        "station_id": [str(i) for i in range(7)], "pollutant": "no2", "coefficients": list(rng.normal(0, 0.4, (7, 4))),
        "state": list(rng.normal(0, 1, (7, 5))), "steps": [1, 5, 24, 3, 30, 2, 9], "last_hour": pd.Timestamp(LAST), "stationary": True})
    monkeypatch.setattr(arima, "SIDE_BY_SIDE", 3)
    got = list(arima._recursions(iter([frame])))
    assert len(got) == 3
    want = []
    for row in frame.itertuples():
        (phi1, phi2, theta1, theta2), (level, d1, d2, e1, e2) = row.coefficients, row.state
        for k in range(row.steps):
            step = phi1 * d1 + phi2 * d2 + theta1 * e1 + theta2 * e2
            d1, d2, e1, e2, level = step, d1, 0.0, e1, level + step
            want.append((row.station_id, "no2", pd.Timestamp(LAST) + pd.Timedelta(hours=k + 1), level, True))
    assert list(pd.concat(got).itertuples(index=False, name=None)) == want


def test_forecasts_are_spread_and_take_a_fit_that_is_there(spark, monkeypatch):
    fitted = spark.createDataFrame(
        [(str(i), "no2", [0.1, 0.0, 0.0, 0.0], [1.0, 0.0, 0.0, 0.0, 0.0], 24, LAST, True) for i in range(40)],
        "station_id string, pollutant string, coefficients array<double>, state array<double>, steps long, last_hour timestamp, stationary boolean")
    clean = spark.createDataFrame([], "station_id string, timestamp_utc timestamp, no2 double")
    cutoffs = spark.createDataFrame([("no2", LAST)], "pollutant string, cutoff timestamp")
    monkeypatch.setattr(arima, "fitted_series", None)
    seen = arima.station_forecasts(clean, cutoffs, ["no2"], fitted=fitted)
    assert seen.count() == 40 * 24
    assert "REPARTITION_BY_NUM" in seen._jdf.queryExecution().executedPlan().toString()
