from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from hourgrid import constants as C
from hourgrid.operators import cleaning, quality
from hourgrid.operators import timeblocks as B
from tests.helpers import START, clean_frame, pulled, raw_rows, raw_table, series, to_spark


def wide(spark, **columns):
    n = len(next(iter(columns.values())))
    frame = pd.DataFrame({"station_id": "S", "timestamp_utc": pd.date_range(START, periods=n, freq="h")})
    for p in C.POLLUTANTS:
        frame[p] = columns.get(p, np.full(n, np.nan))
    return to_spark(spark, frame)


def test_station_id_pads_but_never_cuts(spark):
    df = spark.createDataFrame([("6", "37", "1"), ("06", "1234", "12345")], "state_code string, county_code string, site_number string")
    assert [r.station_id for r in cleaning.with_station_id(df).collect()] == ["060370001", "06123412345"]


def test_normalize_builds_the_complete_grid(spark):
    rows = raw_rows(24)
    out = pulled(cleaning.normalize(raw_table(spark, rows[:5] + rows[9:])))
    assert len(out) == 24 and out["pm25"].isna().sum() == 4
    assert set(C.POLLUTANTS) <= set(out.columns) and out["no2"].isna().all()
    assert (out["station_id"] == "060370001").all() and (out["county"] == "Los Angeles").all()


def test_unreadable_times_and_unknown_parameters_are_counted(spark):
    rows = raw_rows(5) + [("06", "037", "0001", "99999", 1, 1.0, 1.0, "x", "y", "2023-01-01", "00:00", 1.0),
                          ("06", "037", "0001", " 88101 ", 1, 1.0, 1.0, "x", "y", "nonsense", "00:00", 1.0)]
    raw = raw_table(spark, rows)
    got = quality.schema_metrics(raw, cleaning.normalize(raw)).first()
    assert (got.raw_rows, got.rows_after_ts_parse, got.rows_after_param_filter) == (7, 6, 5)
    assert (got.pivoted_rows, got.station_count, got.pivoted_cols) == (5, 1, 9)


def test_parallel_sensors_are_averaged_and_codes_trimmed(spark):
    rows = raw_rows(2, values=[1.0, 3.0]) + raw_rows(2, code=" 88101", poc=2, values=[3.0, None])
    out = pulled(cleaning.pivot_hours(cleaning.measurements(raw_table(spark, rows))))
    assert out["pm25"].tolist() == [2.0, 3.0]


def test_hours_without_any_value_trim_the_grid(spark):
    out = pulled(cleaning.normalize(raw_table(spark, raw_rows(5, values=[None, 1.0, None, 2.0, None]))))
    assert len(out) == 3 and out["timestamp_utc"].min() == START + pd.Timedelta(hours=1)


def test_nan_counts_as_missing(spark):
    out = pulled(cleaning.normalize(raw_table(spark, raw_rows(3, values=[1.0, float("nan"), 3.0]))))
    assert out["pm25"].isna().tolist() == [False, True, False]


def test_first_known_metadata_wins(spark):
    rows = [(*r[:5], None if i == 0 else r[5], r[6], f"state{i}", *r[8:]) for i, r in enumerate(raw_rows(3))]
    got = cleaning.station_metadata(cleaning.measurements(raw_table(spark, rows))).first()
    assert got.latitude == 34.05 and got.state == "state0"


def test_metadata_order_is_hour_then_sensor(spark):
    rows = spark.createDataFrame(
        [("A", 5, 1, "late"), ("A", 3, 900, "sensor 900"), ("A", 3, 2, "sensor 2"), ("A", 1, 1, None),
         ("B", 3, 2, "second"), ("B", 3, None, "no sensor"), ("C", None, 7, "no hour"), ("C", 2, 1, "hour 2"),
         ("D", 4, 1, "tie b"), ("D", 4, 1, "tie a"), ("E", 1, 1, None)],
        "station_id string, hour long, poc int, state string",
    ).selectExpr("station_id", "timestamp_seconds(hour * 3600) timestamp_utc", "poc", "state")
    found = {r.station_id: r.state for r in cleaning.station_metadata(rows).collect()}
    assert found == {"A": "sensor 2", "B": "no sensor", "C": "no hour", "D": "tie a", "E": None}


def test_metadata_of_raw_rows_aggregates_in_hash_tables(spark, tmp_path):
    path = str(tmp_path / "raw")
    raw_table(spark).write.parquet(path)
    rows = cleaning.measurements(spark.read.parquet(path))
    plan = cleaning.station_metadata(rows)._jdf.queryExecution().executedPlan().toString()
    lines = [line for line in plan.splitlines() if "Aggregate" in line or "FileScan" in line]
    assert "FileScan" in lines[-1] and all("HashAggregate" in line for line in lines[-3:-1])


def test_gap_at_the_limit_is_filled_and_counted(spark):
    values = np.arange(1.0, 25.0)
    values[10:13] = np.nan
    out = pulled(cleaning.interpolate_gaps(wide(spark, pm25=values)))
    assert out["pm25"].tolist() == pytest.approx(np.arange(1.0, 25.0).tolist())
    assert out["pm25_interp_flag"].sum() == 3


def test_longer_gap_keeps_its_tail(spark):
    values = np.arange(1.0, 25.0)
    values[10:15] = np.nan
    out = pulled(cleaning.interpolate_gaps(wide(spark, pm25=values)))
    assert out["pm25"].isna().sum() == 2
    strict = pulled(cleaning.interpolate_gaps(wide(spark, pm25=values), strict=True))
    assert strict["pm25"].isna().sum() == 5


@pytest.mark.parametrize("gaps", [0.3, 0.97, 0.999])
def test_filling_matches_an_array_library_across_blocks(spark, gaps):
    n = 3 * B.BLOCK_HOURS + 500
    values = series(n, 7, gaps)
    values[:5] = np.nan
    values[-9:] = np.nan
    values[B.BLOCK_HOURS - 300:2 * B.BLOCK_HOURS + 400] = np.nan
    out = pulled(cleaning.interpolate_gaps(wide(spark, pm25=values)))
    expected = pd.Series(values).interpolate(method="linear", limit=3)
    assert np.allclose(out["pm25"], expected, equal_nan=True, atol=1e-9)


@pytest.mark.parametrize("gaps", [0.3, 0.99])
def test_whole_step_matches_an_array_library_across_blocks(spark, gaps):
    """Raw rows to clean table against the same steps in pandas, on series longer than several blocks."""
    rng = np.random.default_rng(3)
    rows, expected = [], []
    for s, (site, n) in enumerate((("0001", 2 * B.BLOCK_HOURS + 900), ("0002", 700))):
        values = series(n, 11 + s, gaps)
        values[rng.integers(0, n, 12)] = -5.0
        values[rng.integers(0, n, 12)] = 9999.0
        values[rng.integers(0, n, 12)] = 60.0
        values[0] = values[-1] = 20.0
        rows += [r for r in raw_rows(n, site=site, values=[None if np.isnan(v) else float(v) for v in values]) if r[-1] is not None]
        filled = pd.Series(values).interpolate(method="linear", limit=3)
        bounded = filled.where((filled >= 0) & (filled <= 2000))
        roll = bounded.rolling(168, center=True, min_periods=24)
        drift = (((bounded - roll.mean()) / roll.std()).abs() > 3.5).fillna(False)
        expected.append(pd.DataFrame({"v": bounded, "interp": pd.Series(values).isna() & filled.notna(),
                                      "neg": filled < 0, "bounds": filled.notna() & bounded.isna(), "drift": drift}))
    want = pd.concat(expected, ignore_index=True)
    out = pulled(cleaning.clean_hourly(raw_table(spark, rows)))
    assert len(out) == len(want)
    assert np.allclose(out["pm25"], want["v"], equal_nan=True)
    for flag in ("interp", "neg", "bounds", "drift"):
        assert (out[f"pm25_{flag}_flag"].values == want[flag].values).all(), flag


def test_negative_and_extreme_values(spark):
    values = np.arange(1.0, 49.0)
    values[5], values[6] = -5.0, 9999.0
    out = pulled(cleaning.flag_bounds(cleaning.flag_negative(wide(spark, pm25=values))))
    assert out["pm25_neg_flag"].sum() == 1 and out["pm25_bounds_flag"].sum() == 2
    assert out["pm25"].isna().sum() == 2


def test_constant_series_does_not_drift(spark):
    for constant in (7.0, 0.1, 1 / 3):
        values = np.full(600, constant)
        assert not pulled(cleaning.flag_drift(wide(spark, pm25=values)))["pm25_drift_flag"].any()
    quiet = np.concatenate([series(400, 1, scale=50), np.full(600, 5.0)])
    quiet[900] = 5.01
    drift = pulled(cleaning.flag_drift(wide(spark, pm25=quiet)))["pm25_drift_flag"]
    roll = pd.Series(quiet).rolling(168, center=True, min_periods=24)
    want = (((pd.Series(quiet) - roll.mean()) / roll.std()).abs() > 3.5).fillna(False)
    assert (drift.values == want.values).all() and drift[900]


def test_hourly_grid_spans_blocks(spark):
    ranges = spark.createDataFrame([("S", "2020-01-01 00:00:00", "2022-01-01 05:00:00")], "station_id string, a string, z string").selectExpr(
        "station_id", "cast(a as timestamp) first_hour", "cast(z as timestamp) last_hour")
    out = cleaning.hourly_grid(ranges)
    assert out.count() == out.distinct().count() == 731 * 24 + 6


def test_grid_join_equals_the_dense_form(spark):
    raw = raw_table(spark, [r for i, r in enumerate(raw_rows(4000)) if i % 7 or i == 0])
    hours = cleaning.pivot_hours(cleaning.measurements(raw))
    joined = pulled(cleaning.grid_join(cleaning.hourly_grid(cleaning.station_range(hours)), hours))
    dense = pulled(cleaning.normalize(raw))
    pd.testing.assert_frame_equal(joined, dense[joined.columns])


def at_minutes(site, times):
    return [row for t, v in times for row in raw_rows(1, site=site, values=[v], start=START + pd.Timedelta(t))]


@pytest.mark.parametrize("step", [cleaning.normalize, cleaning.clean_hourly])
def test_readings_off_the_grid_are_left_out(spark, step):
    rows = at_minutes("0001", [("0h", 1.0), ("1h", 2.0), ("90min", 50.0), ("3h", 4.0), ("330min", 60.0)])
    rows += at_minutes("0002", [("30min", 5.0), ("1h", 70.0), ("150min", 7.0)])
    got = pulled(step(raw_table(spark, rows)))
    minutes = ((got["timestamp_utc"] - START).dt.total_seconds() // 60).astype(int)
    # The grid steps from the station's first reading up to its last one, wherever that lies.
    assert minutes.tolist() == [*range(0, 301, 60), 30, 90, 150]
    known = dict(zip(zip(got["station_id"].str[-4:], minutes), got["pm25"]))
    assert known["0001", 60] == 2.0 and known["0001", 180] == 4.0 and known["0002", 30] == 5.0 and known["0002", 150] == 7.0
    if step is cleaning.clean_hourly:
        assert known["0001", 120] == 3.0 and known["0001", 300] == 4.0 and known["0002", 90] == 6.0
    else:
        assert got["pm25"].isna().sum() == 4


def test_off_grid_readings_beyond_the_halo_do_not_fill_gaps(spark):
    far = B.BLOCK_HOURS * 2
    rows = at_minutes("0001", [("0h", 1.0), (f"{far * 60 - 30}min", 90.0), (f"{far}h", 5.0)])
    got = pulled(cleaning.clean_hourly(raw_table(spark, rows)))
    wide = cleaning.pivot_hours(cleaning.measurements(raw_table(spark, rows)))
    grid = cleaning.grid_join(cleaning.hourly_grid(cleaning.station_range(wide)), wide)
    assert len(got) == grid.count() == far + 1
    assert got["pm25"][1] == pytest.approx(1.0 + 4.0 / far) and got["pm25"].iloc[-1] == 5.0


def test_missingness_counts_measuring_stations_only(spark):
    a, b = clean_frame(10, "A"), clean_frame(10, "B")
    a["no2"] = np.nan
    b.loc[:3, "no2"] = np.nan
    got = {r.pollutant: r for r in quality.missingness(to_spark(spark, pd.concat([a, b]))).collect()}
    assert (got["no2"].total_expected, got["no2"].missing_count, got["no2"].missing_pct) == (10, 4, 40.0)


def test_report_reads_each_table_once(spark, tmp_path):
    raw = raw_table(spark, [])
    raw.write.parquet(str(tmp_path / "raw"))
    raw = spark.read.schema(raw.schema).parquet(str(tmp_path / "raw"))
    cleaning.clean_hourly(raw).write.parquet(str(tmp_path / "clean"))
    clean = spark.read.schema(cleaning.clean_hourly(raw).schema).parquet(str(tmp_path / "clean"))
    for report in (quality.cleaning_report(raw, clean), quality.cleaning_report_rows(raw, clean)):
        plan = report._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation") == 2
    assert report.filter("pollutant = ''").count() == 6


def test_report_is_one_nested_row(spark):
    raw = raw_table(spark, raw_rows(30)[:10] + raw_rows(30)[12:])
    report = quality.cleaning_report(raw, cleaning.clean_hourly(raw)).collect()
    assert len(report) == 1 and report[0].schema.raw_rows == 28
    assert report[0].missingness["pm25"].interpolated == 2


def test_windows_run_on_one_exchange_by_block(spark):
    plan = cleaning.clean_hourly(raw_table(spark))._jdf.queryExecution().executedPlan().toString()
    by_block = [line for line in plan.splitlines() if "Exchange hashpartitioning(station_id" in line and "_block" in line]
    # One for all windows; small tables of one row per block may add theirs.
    assert 1 <= len(by_block) <= 2
    assert "CartesianProduct" not in plan
