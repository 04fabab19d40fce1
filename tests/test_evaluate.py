from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hourgrid.functions.significance import correlation_p_value
from hourgrid.operators import evaluate, exports
from hourgrid.plans import audit
from tests.helpers import START, clean_frame, to_spark


def predictions(spark, groups):
    """``groups``: {(state, station): (truth, forecast)}."""
    rows = [
        ("pm25", station, (START + pd.Timedelta(hours=i)).to_pydatetime(), None if a is None else float(a), float(b))
        for (_, station), (truth, guess) in groups.items() for i, (a, b) in enumerate(zip(truth, guess))
    ]
    pred = spark.createDataFrame(rows, "pollutant string, station_id string, timestamp_utc timestamp, y_true double, y_pred double")
    places = spark.createDataFrame(sorted({(st, s, f"region_{s[:1]}") for s, st in groups}), "station_id string, state string, region string")
    return pred, places


def test_split_takes_the_element_at_the_position(spark):
    rows = [("p", (START + pd.Timedelta(hours=h)).to_pydatetime()) for h in (0, 1, 1, 2, 3, 3, 3, 4, 5, 6)]
    df = spark.createDataFrame(rows, "pollutant string, timestamp_utc timestamp")
    train, test, cutoffs = evaluate.time_split(df)
    assert cutoffs.first().cutoff == (START + pd.Timedelta(hours=5)).to_pydatetime()
    assert (train.count(), test.count()) == (8, 2)
    assert evaluate.time_split(df, embargo_hours=2)[0].count() == 4


def test_metrics(spark):
    truth, guess = np.array([1.0, 2.0, 4.0, 8.0]), np.array([1.5, 2.0, 3.0, 9.0])
    pred, _ = predictions(spark, {("a", "1"): (truth, guess)})
    row = evaluate.regression_metrics(pred).first()
    assert row.mae == 0.625 and row.rmse == 0.75 and row.n_test == 4
    assert row.r2 == round(1 - 2.25 / ((truth - truth.mean()) ** 2).sum(), 4)


@pytest.mark.parametrize("guess, r2", [([3.0, 3.0], 1.0), ([3.0, 4.0], 0.0)])
def test_metrics_without_spread(spark, guess, r2):
    pred, _ = predictions(spark, {("a", "1"): ([3.0, 3.0], guess)})
    assert evaluate.regression_metrics(pred).first().r2 == r2


def test_metrics_skip_pairs_and_small_groups(spark):
    pred, _ = predictions(spark, {("a", "1"): ([1.0, None, float("nan")], [1.0, 2.0, 3.0])})
    row = evaluate.regression_metrics(pred).first()
    assert row.mae is None and row.n_test == 1


def test_group_metrics_equal_direct_ones(spark):
    rng = np.random.default_rng(0)
    groups = {(s, f"{s}{i}"): (rng.normal(10, 3, 50 + i), rng.normal(10, 3, 50 + i)) for s in ("ax", "ay", "bz") for i in range(3)}
    pred, places = predictions(spark, groups)
    got = {(r.level, r.name): r for r in evaluate.metrics_by_group(evaluate.geo_join(pred, places)).collect()}
    located = evaluate.geo_join(pred, places)
    for r in evaluate.regression_metrics(located, ("pollutant", "state")).collect():
        g = got["state", r.state]
        assert (g.mae, g.rmse, g.r2, g.n_test, g.n_stations) == (r.mae, r.rmse, r.r2, r.n_test, 3)
    assert got["region", "region_a"].states == ["ax", "ay"] and got["region", "region_a"].n_stations == 6
    whole = evaluate.regression_metrics(located).first()
    assert (got["overall", "all"].r2, got["overall", "all"].n_test) == (whole.r2, whole.n_test)


def test_ties_take_the_first_name_and_flags_are_strict(spark):
    errors = {"a": 1.0, "b": 1.0, "c": 3.0, "d": 3.0}
    groups = {(s, s): ([0.0, 1.0], [e, 1.0 + e]) for s, e in errors.items()}
    pred, places = predictions(spark, groups)
    report = evaluate.metrics_by_group(evaluate.geo_join(pred, places))
    ends = {r.level: r for r in evaluate.best_worst(report).collect()}
    assert (ends["state"].best, ends["state"].worst, ends["state"].mae_ratio) == ("a", "c", 3.0)
    flags = {r.name: r.flagged for r in evaluate.flag_groups(report, 1.5).filter("level = 'state'").collect()}
    assert flags == {"a": False, "b": False, "c": False, "d": False}
    assert evaluate.flag_groups(report, 1.4).filter("flagged").count() == 2
    out = evaluate.disparity(report, 1.4).first()
    assert out.flagged_states == ["c", "d"] and out.interpretation == "insufficient data"


def test_document_round_trip(spark):
    groups = {(s, s): ([0.0, 1.0, 2.0], [0.5, 1.5, 2.5]) for s in ("a", "b")}
    pred, places = predictions(spark, groups)
    document = audit.audit_document(audit.group_report(pred, places))
    rows = exports.flatten_audit_states(document).orderBy("state").collect()
    assert [(r.state, r.mae, r.n_test, r.flagged) for r in rows] == [("a", 0.5, 3, False), ("b", 0.5, 3, False)]
    assert exports.flatten_audit_regions(document).count() == 2


def test_rank_correlation(spark):
    data = [("p", n, m) for n, m in ((10, 5.0), (20, 4.0), (20, 4.0), (40, 1.0), (50, 2.0))]
    df = spark.createDataFrame(data, "pollutant string, n_test int, mae double")
    x, y = pd.Series([d[1] for d in data]).rank(), pd.Series([d[2] for d in data]).rank()
    row = evaluate.spearman(df, "n_test", "mae").first()
    assert row.rho == pytest.approx(x.corr(y)) and 0 < row.p_value < 0.1
    assert evaluate.spearman(df.limit(3), "n_test", "mae").first().rho is None


def exact_p(rho, n):
    """Student's distribution with n - 2 degrees of freedom as a finite sum."""
    size, cos, nu = abs(rho), math.sqrt(1 - rho * rho), n - 2
    if nu % 2 == 0:
        term, total = 1.0, 0.0
        for k in range(nu // 2):
            total += term
            term *= cos * cos * (2 * k + 1) / (2 * k + 2)
        return 1 - size * total
    term, total = cos, 0.0
    for k in range((nu - 1) // 2):
        total += term
        term *= cos * cos * (2 * k + 2) / (2 * k + 3)
    return 1 - 2 / math.pi * (math.asin(size) + size * total)


def test_p_values_equal_finite_sums(spark):
    rows = [(rho, n) for rho in (0.0, 1e-9, 0.01, -0.2, 0.5, 0.576, -0.83, 0.999, 1.0, -1.0) for n in (3, 4, 5, 7, 12, 51, 400)]
    rows += [(None, 9), (0.5, 2), (float("nan"), 9), (0.5, None)]
    out = spark.createDataFrame(rows, "rho double, n bigint").repartition(3).select("rho", "n", correlation_p_value(F.col("rho"), F.col("n")).alias("p")).collect()
    for r in out:
        if r.rho is None or r.n is None or r.rho != r.rho or r.n < 3:
            assert r.p is None
        else:
            assert r.p == pytest.approx(exact_p(r.rho, r.n), abs=1e-11), (r.rho, r.n)
    assert exact_p(0.5760, 12) == pytest.approx(0.05, abs=1e-4)
    large = spark.createDataFrame([(0.002, 1_000_000)], "rho double, n bigint").select(correlation_p_value(F.col("rho"), F.col("n")).alias("p")).first().p
    assert large == pytest.approx(math.erfc(0.002 * math.sqrt(1e6 - 2) / math.sqrt(2)), abs=1e-6)


def test_daily_and_annual(spark):
    frame = clean_frame(48, pm25=np.r_[np.full(24, 10.0), np.full(24, 40.0)], no2=np.full(48, np.nan))
    frame.loc[:23, "ozone"] = np.nan
    df = to_spark(spark, frame)
    days = exports.daily_station(df).orderBy("date").collect()
    assert [(d.date, d.pm25_mean, d.no2_mean, d.season) for d in days] == [("2023-01-01", 10.0, None, 0), ("2023-01-02", 40.0, None, 0)]
    row = exports.station_annual(df).first()
    assert (row.avg_pm25, row.aqi_cat_pm25, row.aqi_cat_no2) == (25.0, "Moderate", "No Data")
    month = exports.monthly_state(df).first()
    assert (month.year_month, month.stations_pm25, month.stations_no2) == ("2023-01", 1, 0)


def test_bands_are_inclusive(spark):
    from pyspark.sql import functions as F

    from hourgrid.functions import scalar as S

    df = spark.createDataFrame([(12.0,), (12.1,), (250.4,), (250.5,), (None,)], "v double")
    assert [r.c for r in df.select(S.category(F.col("v"), "pm25").alias("c")).collect()] == [
        "Good", "Moderate", "Very Unhealthy", "Hazardous", "No Data"]


def test_overlay_replaces_whole_rows(spark):
    schema = "pollutant string, model string, mae double, rmse double, r2 double, n_test int"
    old = spark.createDataFrame([("p", "A", 1.0, 1.0, 1.0, 1), ("p", "B", 2.0, 2.0, 2.0, 2)], schema)
    new = spark.createDataFrame([("p", "A", 9.0, None, None, 9), ("q", "A", 3.0, 3.0, 3.0, 3)], schema)
    rows = {(r.pollutant, r.model): (r.mae, r.rmse) for r in exports.metrics_overlay(old, new).collect()}
    assert rows == {("p", "A"): (9.0, None), ("p", "B"): (2.0, 2.0), ("q", "A"): (3.0, 3.0)}


def test_verdicts(spark):
    schema = "pollutant string, model string, mae double, rmse double, r2 double, n_test int"
    base = spark.createDataFrame([(p, "m", m, 1.0, 0.5, 9) for p, m in (("a", 1.0), ("b", 1.0), ("c", 1.0), ("d", 1.0))], schema)
    new = spark.createDataFrame([(p, "m", m, 1.0, 0.5, 9) for p, m in (("a", 0.99), ("b", 1.01), ("c", 1.004))], schema)
    rows = {r.pollutant: (r.verdict, r.delta_text) for r in exports.ablation(base, new).collect()}
    assert rows == {"a": ("improved", "-0.0100 ↓"), "b": ("degraded", "+0.0100 ↑"), "c": ("no change", "+0.0040 ↑"), "d": ("unknown", "n/a")}
