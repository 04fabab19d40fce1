from __future__ import annotations

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from hourgrid import schemas
from hourgrid.operators import ingest
from hourgrid.sources import payloads, readers, sinks


def ranges(spark, *pairs):
    return spark.createDataFrame(
        [(i, dt.date.fromisoformat(a), dt.date.fromisoformat(b)) for i, (a, b) in enumerate(pairs)],
        "i int, start_date date, end_date date")


def test_year_windows_within_a_year(spark):
    rows = ingest.year_windows(ranges(spark, ("2023-03-01", "2023-11-30"))).collect()
    assert [(str(r.window_start), str(r.window_end)) for r in rows] == [("2023-03-01", "2023-11-30")]


def test_year_windows_split_at_year_ends(spark):
    rows = ingest.year_windows(ranges(spark, ("2022-06-01", "2024-02-28"), ("2024-02-01", "2024-01-01"))).orderBy("window_start").collect()
    assert [(str(r.window_start), str(r.window_end)) for r in rows] == [
        ("2022-06-01", "2022-12-31"), ("2023-01-01", "2023-12-31"), ("2024-01-01", "2024-02-28")]


def test_plan_is_numbered_in_order_and_resumes(spark):
    counties = spark.createDataFrame(
        [(s, c, dt.date(2022, 7, 1), dt.date(2023, 3, 1)) for s, c in (("06", "037"), ("04", "013"), ("04", "019"))],
        "state_code string, county_code string, start_date date, end_date date")
    plan = ingest.pull_plan(counties)
    rows = plan.orderBy("position").collect()
    assert [r.position for r in rows] == list(range(1, 19))
    keys = [(r.parameter_code, r.state_code, r.county_code, r.window_start) for r in rows]
    order = {"88101": 0, "42602": 1, "44201": 2}
    assert keys == sorted(keys, key=lambda k: (order[k[0]], *k[1:]))
    assert rows[0].chunk_key == "88101_04_013_2022"
    left = ingest.resume_filter(plan, spark.createDataFrame([("88101_04_013_2022",)], "chunk_key string"))
    assert left.count() == 17


def test_payload_rows_and_types(spark):
    body = '{"Header": [{"status": "Success"}], "Data": [%s]}' % ", ".join(
        ['{"date_local": "2023-01-01", "time_local": "13:00", "sample_measurement": "12.3", "parameter": "P", "state_name": "California"}'] * 5)
    rows, errors = payloads.unwrap_envelope(spark.createDataFrame([(1, body)], "payload_id int, payload string"))
    out = ingest.normalize_pull(rows).collect()
    assert len(out) == 5 and out[0].sample_measurement == 12.3 and out[0].datetime_local == dt.datetime(2023, 1, 1, 13)
    assert errors.count() == 0


@pytest.mark.parametrize("body, outcome", [
    ('{"Data": [{"state_code": "06"}]}', "success"), ('{"Header": [{}], "Data": []}', "success"),
    ('{"Header": [{"status": "No Data matched your selection"}]}', "no data"),
    ('{"Header": [{"status": "Failed", "error": "NO MATCHING DATA"}]}', "no data"),
    ('{"Header": [{"status": "Failed", "message": "bad key"}]}', "error"), ("<html>", "error"),
])
def test_payload_outcomes(spark, body, outcome):
    row = payloads.classify_envelope(spark.createDataFrame([(body,)], "payload string")).first()
    assert row.outcome == outcome


def test_bad_numbers_become_null(spark):
    df = spark.createDataFrame([("abc", "1.5", "2023-01-01", "25:00")], "sample_measurement string, latitude string, date_local string, time_local string")
    row = ingest.normalize_pull(df).first()
    assert row.sample_measurement is None and row.latitude == 1.5 and row.datetime_local is None


def test_chunks_without_columns_read_as_nothing(spark, tmp_path):
    pd.DataFrame().to_parquet(tmp_path / "empty.parquet", index=False)
    pd.DataFrame({"state_code": ["06"], "sample_measurement": [1.0]}).to_parquet(tmp_path / "full.parquet", index=False)
    out = readers.scan_chunks(spark, str(tmp_path))
    assert out.schema == schemas.RAW_LONG and out.count() == 1 and out.first().county_code is None


def test_only_footers_tell_blank_chunks(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    note = {b"note": b"x" * 100_000}
    for k in range(3):
        pq.write_table(pa.table({}).replace_schema_metadata(note), tmp_path / f"blank{k}.parquet")
    (tmp_path / "year=2024").mkdir()
    rows = pa.table({"sample_measurement": pa.array([1.0, 2.0, None]), "other": ["a", "b", "c"], "state_code": pa.array(["01", "02", "03"])})
    pq.write_table(rows.replace_schema_metadata(note), tmp_path / "year=2024" / "full.parquet")
    pq.write_table(pa.table({"other": ["a", "b"]}), tmp_path / "foreign.parquet")
    out = readers.scan_chunks(spark, str(tmp_path))
    assert out.schema == schemas.RAW_LONG and sorted(str(r.state_code) for r in out.collect()) == ["01", "02", "03", "None", "None"]
    assert out.agg(F.sum("sample_measurement")).first()[0] == 3.0
    assert readers.scan_hours(spark, str(tmp_path / "absent"), str(tmp_path)).count() == 5
    assert readers.scan_hours(spark, str(tmp_path / "year=2024"), str(tmp_path)).count() == 3
    (tmp_path / "torn.parquet").write_bytes((tmp_path / "year=2024" / "full.parquet").read_bytes()[:-7])
    with pytest.raises(Exception, match="torn.parquet"):
        readers.scan_chunks(spark, str(tmp_path)).collect()


def test_chunks_are_landed_once(spark, tmp_path):
    path = str(tmp_path / "store")
    batch = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "chunk_key string, v int")
    sinks.land_new_chunks(batch.filter("chunk_key = 'a'"), path)
    sinks.land_new_chunks(batch, path)
    sinks.land_new_chunks(batch, path)
    assert sorted((r.chunk_key, r.v) for r in spark.read.parquet(path).collect()) == [("a", 1), ("a", 2), ("b", 3)]


def test_stored_keys_come_from_the_file_listing(spark, tmp_path):
    path = tmp_path / "store"
    (path / "chunk_key=a").mkdir(parents=True)
    (path / "chunk_key=a" / "part-0.parquet").write_bytes(b"not opened")
    assert [r.chunk_key for r in sinks._stored_keys(spark, str(path), "chunk_key").collect()] == ["a"]
    (tmp_path / "bare").mkdir()
    assert sinks._stored_keys(spark, str(tmp_path / "bare"), "chunk_key") is None
    assert sinks._stored_keys(spark, str(tmp_path / "absent"), "chunk_key") is None


def test_complete_chunks_and_row_counts(spark):
    rows = spark.createDataFrame([("A",)] * 3 + [("B",)] * 2, "station_id string")
    assert [r.station_id for r in ingest.complete_chunks(rows, 3).collect()] == ["A"]
    stations = spark.createDataFrame([("A",), ("B",), ("C",)], "station_id string")
    assert {r.station_id for r in ingest.still_to_fetch(stations, rows, 3).collect()} == {"B", "C"}
    assert [(r.station_id, r.rows) for r in ingest.row_count_check(rows, 3).collect()] == [("B", 2)]


def test_filters_reach_the_scan(spark, tmp_path):
    from hourgrid.operators import cleaning
    from tests.helpers import raw_table

    path = str(tmp_path / "raw")
    raw_table(spark).write.parquet(path)
    plan = cleaning.pivot_hours(cleaning.measurements(spark.read.parquet(path)))._jdf.queryExecution().executedPlan().toString()
    assert "StringContains(parameter_code,88101)" in plan
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "county:string" not in scan.split("ReadSchema")[-1]


def test_a_payload_is_parsed_once(spark):
    rows, failed = payloads.unwrap_envelope(spark.createDataFrame([(1, "{}")], "payload_id long, payload string"))
    for df in (ingest.normalize_pull(rows).select("payload_id", "sample_measurement"), failed):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json") == 1
