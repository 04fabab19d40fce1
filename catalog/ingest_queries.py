"""Scans, sinks, ingest planning, requests and live features."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import adapter as A
from catalog.cleaning_queries import REPORT, clean
from catalog.ctes import CALENDAR, READINGS, calendar, fields, text_time
from catalog.feature_queries import DAILY
from catalog.registry import register
from catalog.snap import sql as snap
from hourgrid import constants as C
from hourgrid import schemas
from hourgrid.functions import scalar as S
from hourgrid.operators import cleaning, exports, ingest, live, quality, weather
from hourgrid.operators import requests as R
from hourgrid.plans.staging import staged
from hourgrid.session import scratch_dir
from hourgrid.sources import payloads, readers, sinks

KEY = "parameter_code || '_' || state_code || '_' || county_code || '_' || year(ts_utc)"
RAW_TIME = "try_strptime(date_gmt || ' ' || time_gmt, '%Y-%m-%d %H:%M')"


def chunked(spark, sf):
    """Raw rows with the key of their chunk; rows without a readable time have none."""
    rows = cleaning.parse_utc(A.raw_long(spark, sf))
    return rows.withColumn("chunk_key", ingest.chunk_key(F.year("timestamp_utc")))


CHUNKED = f"(SELECT *, {KEY} AS chunk_key FROM (SELECT *, {RAW_TIME} AS ts_utc FROM raw) WHERE ts_utc IS NOT NULL)"


# -- Scans and sinks -----------------------------------------------------------------------------

@register("scan_chunks", f"""SELECT parameter_code, count(*) AS rows, {snap('sum(sample_measurement)', 4)} AS total,
    min(date_gmt) AS first_date FROM raw GROUP BY parameter_code""")
def _(spark, sf):
    path = sinks.write_parquet(A.raw_long(spark, sf).drop("event_id"), scratch_dir(spark, "chunks"))
    rows = readers.scan_chunks(spark, path)
    from catalog.snap import snap as cut
    return rows.groupBy("parameter_code").agg(
        F.count(F.lit(1)).alias("rows"), cut(F.sum("sample_measurement"), 4).alias("total"), F.min("date_gmt").alias("first_date"))


@register("scan_clean", "SELECT station_id, count(*) AS drifting FROM clean WHERE pm25_drift_flag OR no2_drift_flag GROUP BY station_id")
def _(spark, sf):
    path = sinks.write_parquet(clean(spark, sf), scratch_dir(spark, "clean"))
    rows = readers.scan_table(spark, path).filter("pm25_drift_flag or no2_drift_flag")
    return rows.groupBy("station_id").agg(F.count(F.lit(1)).alias("drifting"))


@register("scan_live_observations", f"""SELECT parameter, count(*) AS rows, count(value) AS readable, {snap('sum(value)', 4)} AS total FROM obs GROUP BY parameter""")
def _(spark, sf):
    path = sinks.write_json(A.observations(spark, sf), scratch_dir(spark, "observations"))
    rows = live.readings(readers.scan_observations(spark, path))
    from catalog.snap import snap as cut
    return rows.groupBy("parameter").agg(
        F.count(F.lit(1)).alias("rows"), F.count("value").alias("readable"), cut(F.sum("value"), 4).alias("total"))


@register("scan_csv_tables", DAILY)
def _(spark, sf):
    path = sinks.write_csv(exports.daily_station(clean(spark, sf), digits=None), scratch_dir(spark, "csv"))
    return readers.scan_csv(spark, path, schemas.DAILY_STATION)


@register("write_csv", DAILY)
def _(spark, sf):
    """All rows and columns, as text files hold them."""
    path = sinks.write_csv(exports.daily_station(clean(spark, sf), digits=None), scratch_dir(spark, "csv"))
    lines = spark.read.option("header", True).csv(path)
    return lines.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.DAILY_STATION))


@register("write_parquet", DAILY)
def _(spark, sf):
    daily = exports.daily_station(clean(spark, sf), digits=None)
    path = sinks.write_parquet(daily.withColumn("year", F.substring("date", 1, 4)), scratch_dir(spark, "daily"), ["year"])
    return spark.read.parquet(path).drop("year")


@register("write_json", REPORT)
def _(spark, sf):
    """Every value of the report, as the file holds it."""
    raw = A.raw_long(spark, sf)
    path = sinks.write_json(quality.cleaning_report(raw, staged(cleaning.clean_hourly(raw), "clean")), scratch_dir(spark, "report"))
    counts = ", ".join(f"{p}: MAP<STRING, DOUBLE>" for p in C.POLLUTANTS)
    kind = f"schema STRUCT<{', '.join(f'{m}: DOUBLE' for m in quality.SCHEMA)}, stations_by_pollutant: STRUCT<{counts}>>, missingness STRUCT<{counts}>, outliers STRUCT<{counts}>"
    stored = spark.read.schema(kind).json(path)

    def entries(section, field, p):
        return F.transform(F.map_entries(F.col(f"{field}.{p}")), lambda e: F.struct(
            F.lit(section).alias("section"), F.lit(p).alias("pollutant"), e["key"].alias("metric"), e["value"].alias("value")))

    def of(section, field):
        return F.explode(F.flatten(F.array(*(entries(section, field, p) for p in C.POLLUTANTS)))).alias("e")

    whole = stored.select(F.explode(F.array(*(F.struct(F.lit("schema").alias("section"), F.lit("").alias("pollutant"), F.lit(m).alias("metric"),
                                                       F.col(f"schema.{m}").alias("value")) for m in quality.SCHEMA))).alias("e"))
    parts = [whole, *(stored.select(of(*names)) for names in (("schema", "schema.stations_by_pollutant"), ("missingness", "missingness"), ("outliers", "outliers")))]
    return exports.union_parts([part.select("e.*") for part in parts])


@register("unwrap_envelope", f"""SELECT event_id AS payload_id, state_code, parameter_code, {snap('sample_measurement')} AS sample_measurement
    FROM raw WHERE event_id % 10 > 2""")
def _(spark, sf):
    rows, _ = payloads.unwrap_envelope(A.envelopes(spark, sf))
    return ingest.normalize_pull(rows).select("payload_id", "state_code", "parameter_code", "sample_measurement")


@register("envelope_errors", "SELECT event_id AS payload_id, 'quota exceeded' AS message FROM raw WHERE event_id % 10 = 1")
def _(spark, sf):
    return payloads.unwrap_envelope(A.envelopes(spark, sf))[1]


@register("coerce_types", f"""SELECT event_id AS payload_id, {snap('sample_measurement')} AS sample_measurement,
    {text_time("strptime(date_local || ' ' || time_local, '%Y-%m-%d %H:%M')", 'datetime_local')} FROM raw WHERE event_id % 10 > 2""")
def _(spark, sf):
    rows, _ = payloads.unwrap_envelope(A.envelopes(spark, sf))
    return ingest.normalize_pull(rows).select("payload_id", "sample_measurement", "datetime_local")


# -- Planning ------------------------------------------------------------------------------------

def customer_ranges(spark, sf):
    """The span of each customer's orders."""
    return A.table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.min(F.to_date("o_orderdate")).alias("start_date"), F.max(F.to_date("o_orderdate")).alias("end_date"))


@register("year_windows", """SELECT o_custkey, y AS year,
    strftime(greatest(a, make_date(y, 1, 1)), '%Y-%m-%d') AS window_start, strftime(least(z, make_date(y, 12, 31)), '%Y-%m-%d') AS window_end
    FROM (SELECT o_custkey, a, z, unnest(generate_series(year(a), year(z))) AS y FROM
      (SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS a, max(CAST(o_orderdate AS DATE)) AS z FROM orders GROUP BY o_custkey))""")
def _(spark, sf):
    return ingest.year_windows(customer_ranges(spark, sf)).select("o_custkey", "year", "window_start", "window_end")


def county_ranges(spark, sf):
    """Suppliers' nations as states, their customers' keys as counties, with the span of their orders."""
    customers = A.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0").alias("state_code"),
        F.lpad((F.col("c_custkey") % 40).cast("string"), 3, "0").alias("county_code"))
    orders = A.table(spark, sf, "orders").select("o_custkey", F.to_date("o_orderdate").alias("day"))
    return orders.join(customers, "o_custkey").groupBy("state_code", "county_code").agg(
        F.min("day").alias("start_date"), F.max("day").alias("end_date"))


COUNTIES = """(SELECT lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS state_code, lpad(CAST(c_custkey % 40 AS VARCHAR), 3, '0') AS county_code,
    min(CAST(o_orderdate AS DATE)) AS a, max(CAST(o_orderdate AS DATE)) AS z FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL)"""
PLAN = f"""(SELECT row_number() OVER (ORDER BY k, state_code, county_code, y) AS position, parameter_code, state_code, county_code,
    strftime(greatest(a, make_date(y, 1, 1)), '%Y-%m-%d') AS window_start, strftime(least(z, make_date(y, 12, 31)), '%Y-%m-%d') AS window_end,
    parameter_code || '_' || state_code || '_' || county_code || '_' || y AS chunk_key
    FROM (SELECT *, unnest(generate_series(year(a), year(z))) AS y FROM {COUNTIES})
    CROSS JOIN (VALUES (0, '88101'), (1, '42602'), (2, '44201')) p(k, parameter_code))"""


@register("pull_plan", f"SELECT * FROM {PLAN}")
def _(spark, sf):
    return ingest.pull_plan(county_ranges(spark, sf))


@register("plan_cross", f"SELECT state_code, parameter_code, count(*) AS entries, min(position) AS first_position FROM {PLAN} GROUP BY state_code, parameter_code")
def _(spark, sf):
    return ingest.pull_plan(county_ranges(spark, sf)).groupBy("state_code", "parameter_code").agg(
        F.count(F.lit(1)).alias("entries"), F.min("position").alias("first_position"))


def _large_years(spark, sf):
    """Chunks that exist already: county years with an order above a price."""
    orders = A.table(spark, sf, "orders").filter(F.col("o_totalprice") > 300000).select(
        "o_custkey", F.year("o_orderdate").alias("year"))
    customers = A.table(spark, sf, "customer")
    return orders.join(customers, orders.o_custkey == customers.c_custkey).select(F.concat_ws(
        "_", F.lit("88101"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0"),
        F.lpad((F.col("c_custkey") % 40).cast("string"), 3, "0"), F.col("year").cast("string")).alias("chunk_key")).distinct()


@register("resume_filter", f"""SELECT * FROM {PLAN} WHERE chunk_key NOT IN (SELECT '88101_' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || '_' ||
    lpad(CAST(c_custkey % 40 AS VARCHAR), 3, '0') || '_' || year(o_orderdate) FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice > 300000)""")
def _(spark, sf):
    return ingest.resume_filter(ingest.pull_plan(county_ranges(spark, sf)), _large_years(spark, sf))


@register("complete_chunks", "SELECT station_id, count(*) AS rows FROM wx GROUP BY station_id HAVING count(*) >= 672")
def _(spark, sf):
    return ingest.complete_chunks(A.weather(spark, sf), 672)


@register("anti_cached", "SELECT station_id, state FROM meta WHERE station_id NOT IN (SELECT station_id FROM wx GROUP BY station_id HAVING count(*) >= 672)")
def _(spark, sf):
    stations = cleaning.station_metadata(cleaning.measurements(A.raw_long(spark, sf)), ["state"])
    return ingest.still_to_fetch(stations, A.weather(spark, sf), 672)


@register("row_count_check", "SELECT station_id, count(*) AS rows, CAST(716 AS BIGINT) AS expected FROM wx GROUP BY station_id HAVING count(*) <> 716")
def _(spark, sf):
    return ingest.row_count_check(A.weather(spark, sf), 716)


@register("chunk_row_counts", f"SELECT chunk_key, count(*) AS rows, CAST(sum(count(*)) OVER () AS BIGINT) AS total_rows FROM {CHUNKED} GROUP BY chunk_key")
def _(spark, sf):
    return ingest.chunk_row_counts(chunked(spark, sf))


@register("file_row_counts", " UNION ALL ".join(f"SELECT '{t}.parquet' AS file, count(*) AS rows FROM {t} HAVING count(*) > 0" for t in ("events", "orders", "lineitem", "customer")))
def _(spark, sf):
    return exports.union_parts([readers.file_row_counts(A.table(spark, sf, t)) for t in ("events", "orders", "lineitem", "customer")])


@register("pull_summary", f"""SELECT section, name, rows, {text_time('first_local')}, {text_time('last_local')}, below_target FROM (
    SELECT 'total' AS section, 'all' AS name, count(*) AS rows, min(t) AS first_local, max(t) AS last_local, count(*) < 500000 AS below_target FROM (SELECT strptime(date_local || ' ' || time_local, '%Y-%m-%d %H:%M') AS t FROM raw)
    UNION ALL SELECT 'parameter', parameter, count(*), min(t), max(t), false FROM (SELECT parameter, strptime(date_local || ' ' || time_local, '%Y-%m-%d %H:%M') AS t FROM raw) GROUP BY parameter
    UNION ALL SELECT 'state', state, count(*), min(t), max(t), false FROM (SELECT state, strptime(date_local || ' ' || time_local, '%Y-%m-%d %H:%M') AS t FROM raw) GROUP BY state)""")
def _(spark, sf):
    return ingest.pull_summary(ingest.normalize_pull(A.raw_long(spark, sf)).withColumnRenamed("state", "state_name"))


@register("reference_lists", "SELECT DISTINCT state_code, county_code, county FROM raw")
def _(spark, sf):
    return ingest.list_counties(A.raw_long(spark, sf))


@register("reference_states", "SELECT DISTINCT state_code, state FROM raw")
def _(spark, sf):
    return ingest.list_states(A.raw_long(spark, sf))


@register("incremental_chunk_load", f"SELECT chunk_key, count(*) AS rows, {snap('sum(sample_measurement)', 4)} AS total FROM {CHUNKED} GROUP BY chunk_key")
def _(spark, sf):
    """Land half of the parameters, then all of them: no chunk is landed twice."""
    rows, store = chunked(spark, sf).drop("timestamp_utc"), scratch_dir(spark, "store")
    sinks.land_new_chunks(rows.filter(F.col("parameter_code").isin("88101", "42602")), store)
    sinks.land_new_chunks(rows, store)
    from catalog.snap import snap as cut
    return spark.read.parquet(store).groupBy("chunk_key").agg(
        F.count(F.lit(1)).alias("rows"), cut(F.sum("sample_measurement"), 4).alias("total"))


# -- Requests ------------------------------------------------------------------------------------

@register("validate_requests", "SELECT request_id, errors FROM req_checked")
def _(spark, sf):
    return R.with_errors(A.scoring_requests(spark, sf)).select("request_id", F.array_join("errors", "; ").alias("errors"))


@register("rejected_requests", "SELECT request_id, errors FROM req_checked WHERE errors <> ''")
def _(spark, sf):
    return R.validate_requests(A.scoring_requests(spark, sf))[1].select("request_id", F.array_join("errors", "; ").alias("errors"))


OK = "(SELECT *, coalesce(model, 'GradientBoosting') AS used FROM req_checked WHERE errors = '')"
ASSEMBLED = (*READINGS, *CALENDAR, "latitude", "longitude")


def assembled(spark, sf):
    return R.assemble_features(R.validate_requests(A.scoring_requests(spark, sf))[0])


@register("assemble_request_features", f"""SELECT request_id, pollutant, model, {text_time('prediction_time')},
    {text_time('prediction_time + INTERVAL 24 HOUR', 'target_time')}, {fields(ASSEMBLED)}, {snap('season')} AS season, {snap('drift_flag')} AS drift_flag
    FROM (SELECT request_id, pollutant, used AS model, prediction_time, {', '.join(READINGS)}, latitude, longitude,
      CAST(drift_flag AS DOUBLE) AS drift_flag, {calendar('prediction_time', 'DOUBLE')} FROM {OK})""")
def _(spark, sf):
    return assembled(spark, sf).drop(*C.WEATHER_COLUMNS)


@register("target_time", """SELECT event_id, strftime(hour + INTERVAL 24 HOUR, '%Y-%m-%dT%H:%M:%S+00:00') AS target_time FROM ev""")
def _(spark, sf):
    return A.events(spark, sf).select("event_id", S.iso_utc(R.target_time(F.col("hour"))).alias("target_time"))


OPTIONAL = ("lag_168h", "roll_24h_mean", "roll_24h_std")


@register("missing_features", f"""SELECT request_id, concat_ws(', ', {', '.join(f"CASE WHEN {c} IS NULL THEN '{c}' END" for c in OPTIONAL)},
    'temperature_2m', 'wind_speed_10m', 'relative_humidity_2m') AS missing_features FROM {OK} WHERE used = 'RandomForest'""")
def _(spark, sf):
    refused = R.reject_missing(assembled(spark, sf))[1]
    return refused.select("request_id", F.array_join("missing_features", ", ").alias("missing_features"))


@register("essential_lag_guard", """SELECT request_id, concat_ws(', ', CASE WHEN lag_1h IS NULL THEN 'lag_1h' END,
    CASE WHEN lag_24h IS NULL THEN 'lag_24h' END) AS missing_required FROM req WHERE lag_1h IS NULL OR lag_24h IS NULL""")
def _(spark, sf):
    refused = R.essential_lag_guard(R.assemble_features(A.scoring_requests(spark, sf)))[1]
    return refused.select("request_id", F.array_join("missing_required", ", ").alias("missing_required"))


@register("bbox", f"""SELECT request_id, {snap('round(longitude - 0.18, 4)')} AS min_lon, {snap('round(latitude - 0.15, 4)')} AS min_lat,
    {snap('round(longitude + 0.18, 4)')} AS max_lon, {snap('round(latitude + 0.15, 4)')} AS max_lat FROM req""")
def _(spark, sf):
    box = R.bounding_box(F.col("station.latitude"), F.col("station.longitude"))
    return A.scoring_requests(spark, sf).select("request_id", *(c.alias(k) for k, c in box.items()))


# -- Live ----------------------------------------------------------------------------------------

@register("value_fallback", f"SELECT parameter, {text_time('timestamp_utc')}, site_code, {snap('value')} AS value FROM obs WHERE value IS NOT NULL")
def _(spark, sf):
    rows = live.readings(A.observations(spark, sf)).filter(F.col("value").isNotNull())
    return rows.select("parameter", "timestamp_utc", "site_code", "value")


@register("unit_normalise", f"""SELECT parameter, {text_time('timestamp_utc')}, site_code,
    {snap("CASE WHEN parameter = 'OZONE' THEN value / 1000 ELSE value END")} AS value FROM obs WHERE value IS NOT NULL""")
def _(spark, sf):
    rows = live.normalise_units(live.readings(A.observations(spark, sf))).filter(F.col("value").isNotNull())
    return rows.select("parameter", "timestamp_utc", "site_code", "value")


def near(spark, sf):
    return live.nearby(A.live_requests(spark, sf), live.site_hours(live.readings(A.observations(spark, sf))))


def hours(spark, sf):
    return live.hourly_area_mean(near(spark, sf), None)


@register("bbox_range_join", f"SELECT request_id, parameter, count(*) AS records, count(value) AS readable, {snap('sum(value)', 4)} AS total FROM near GROUP BY request_id, parameter")
def _(spark, sf):
    from catalog.snap import snap as cut
    entries = near(spark, sf).select("request_id", F.inline("entries"))
    return entries.groupBy("request_id", "parameter").agg(
        F.sum("n_raw").alias("records"), F.sum("value_count").alias("readable"), cut(F.sum("value_sum"), 4).alias("total"))


@register("place_index", f"""SELECT latitude AS place_latitude, longitude AS place_longitude, {text_time('timestamp_utc')}, parameter, count(*) AS records,
    count(value) AS readable, {snap('sum(value)', 4)} AS total FROM (
    SELECT DISTINCT r.latitude, r.longitude, o.event_id, o.timestamp_utc, o.parameter, o.value
    FROM live_req r JOIN obs o ON o.latitude BETWEEN round(r.latitude - 0.15, 4) AND round(r.latitude + 0.15, 4)
      AND o.longitude BETWEEN round(r.longitude - 0.18, 4) AND round(r.longitude + 0.18, 4)
      AND o.timestamp_utc BETWEEN r.end_hour - INTERVAL 170 HOUR AND r.end_hour) GROUP BY ALL""")
def _(spark, sf):
    from catalog.snap import snap as cut
    requests, sites = A.live_requests(spark, sf), live.site_hours(live.readings(A.observations(spark, sf)))
    index = live.place_hours(live.place_days(requests), sites)
    end = F.floor(F.unix_seconds("end_hour") / 3600)
    windows = requests.select(F.col("latitude").alias("_lat"), F.col("longitude").alias("_lon"), end.alias("_to")).distinct()
    # Requests of a place may leave hours between their windows, which only whole days of the index hold.
    asked = index.alias("i").join(windows.alias("w"), (F.col("i._lat") == F.col("w._lat")) & (F.col("i._lon") == F.col("w._lon"))
                                  & F.col("_hour").between(F.col("_to") - 170, F.col("_to")), "left_semi")
    entries = asked.select(F.col("_lat").alias("place_latitude"), F.col("_lon").alias("place_longitude"),
                           F.timestamp_seconds(F.col("_hour") * 3600).alias("timestamp_utc"), F.inline("entries"))
    return entries.select("place_latitude", "place_longitude", "timestamp_utc", "parameter", F.col("n_raw").alias("records"),
                          F.col("value_count").alias("readable"), cut(F.col("value_sum"), 4).alias("total"))


@register("hourly_area_mean", f"SELECT request_id, {text_time('timestamp_utc')}, {snap('value')} AS value FROM area WHERE value IS NOT NULL")
def _(spark, sf):
    rows = hours(spark, sf).filter(F.col("value").isNotNull())
    return rows.select("request_id", F.timestamp_seconds(F.col("_hour") * 3600).alias("timestamp_utc"), "value")


@register("request_grid", f"""SELECT g.request_id, g.pollutant, {text_time('g.t', 'timestamp_utc')}, {snap('a.value')} AS value FROM
    (SELECT request_id, pollutant, unnest(generate_series(end_hour - INTERVAL 170 HOUR, end_hour, INTERVAL 1 HOUR)) AS t FROM live_req) g
    LEFT JOIN area a ON a.request_id = g.request_id AND a.timestamp_utc = g.t""")
def _(spark, sf):
    asked = A.live_requests(spark, sf)
    different = live.questions(asked)
    found = live.hourly_area_mean(live.nearby(different, live.site_hours(live.readings(A.observations(spark, sf)))), None)
    grid = live.request_grid(different, found).drop("pollutant")
    return live.answered(asked, grid, "inner").select("request_id", "pollutant", "timestamp_utc", "value")


def said(warnings="warnings"):
    """Warnings as text: code, feature and count, in order."""
    return F.array_join(F.transform(warnings, lambda w: F.concat_ws(":", w["code"], w["feature"], w["count"])), "; ")


COVER_SAID = """CASE WHEN n_raw_obs = 0 THEN 'no_records:0' END,
    CASE WHEN n_raw_obs > 0 AND n_mine = 0 THEN 'other_parameters_only:' || n_raw_obs END,
    CASE WHEN n_mine > 0 AND coverage_hours < 171 THEN 'hours_missing:' || (171 - coverage_hours) END"""


@register("live_coverage", f"""SELECT request_id, pollutant, n_raw_obs, coverage_hours, missing_hours, sources, parameters_seen,
    concat_ws('; ', {COVER_SAID}) AS warnings FROM cover""")
def _(spark, sf):
    return live.live_coverage(A.live_requests(spark, sf), hours(spark, sf)).withColumns({
        "sources": F.array_join("sources", ", "), "parameters_seen": F.array_join("parameters_seen", ", "), "warnings": said()})


@register("latest_observation", f"SELECT request_id, {text_time('t0', 'latest_hour')} FROM latest")
def _(spark, sf):
    return live.latest_observation(hours(spark, sf))


@register("point_lag_lookup", f"SELECT l.request_id, {fields(READINGS[:3])} FROM live l WHERE l.request_id IN (SELECT request_id FROM near)")
def _(spark, sf):
    return live.point_lags(hours(spark, sf))


def live_weather(spark, sf):
    """Weather of the two providers for every third and every second request."""
    asked = A.live_requests(spark, sf)
    i = F.col("request_id")
    first = asked.filter(i % 3 != 0).select(
        "request_id", (i % 30).cast("double").alias("temp_c"), F.lit(2.5).alias("wind_speed_ms"), (i % 90).alias("humidity_pct"),
        F.when(i % 5 == 0, F.lit("timeout")).alias("error"))
    second = asked.filter(i % 2 != 0).select(
        "request_id", (i % 20).cast("double").alias("temp_c"), F.lit(1.5).alias("wind_speed_ms"), (i % 80).alias("humidity_pct"),
        F.when(i % 7 == 0, F.lit("unreachable")).alias("error"))
    return weather.weather_fallback(asked, first, second)


A_FINE, B_FINE = "(request_id % 3 <> 0 AND request_id % 5 <> 0)", "(request_id % 2 <> 0 AND request_id % 7 <> 0)"
LIVE_WX = {"temperature_2m": ("request_id % 30", "request_id % 20"), "wind_speed_10m": ("2.5", "1.5"), "relative_humidity_2m": ("request_id % 90", "request_id % 80")}
STATUS = "CASE WHEN t0 IS NULL THEN 'no observations' WHEN lag_1h IS NULL OR lag_24h IS NULL THEN 'missing essential lags' ELSE 'ok' END"
SOURCE = f"CASE WHEN {A_FINE} THEN 'provider A' WHEN {B_FINE} THEN 'provider B' ELSE 'all weather sources failed' END"
FAILED = f"""CASE WHEN NOT {A_FINE} AND NOT {B_FINE} THEN 'all weather sources failed: '
    || CASE WHEN request_id % 2 = 0 THEN 'no answer' ELSE 'unreachable' END END"""
FEATURE_SAID = ", ".join([f"CASE WHEN t0 IS NOT NULL AND lag_{k}h IS NULL THEN 'lag_missing:lag_{k}h' END" for k in (1, 24, 168)] + [
    "CASE WHEN t0 IS NOT NULL AND roll_168h_mean IS NULL THEN 'few_values:roll_168h_mean:' || week_count END",
    "CASE WHEN t0 IS NOT NULL THEN 'drift_assumed:drift_flag' END",
    f"CASE WHEN t0 IS NOT NULL AND NOT {A_FINE} AND NOT {B_FINE} THEN 'no_weather' END"])


def _label(name):
    """SQL of a feature's source label."""
    if name.startswith(("lag_", "roll_")):
        return f"CASE WHEN {name} IS NULL THEN 'unavailable/backfilled' ELSE '{'live' if name.startswith('lag_') else 'derived'}' END"
    if name in LIVE_WX:
        return f"CASE WHEN {A_FINE} OR {B_FINE} THEN 'live' ELSE 'unavailable/backfilled' END"
    return {"latitude": "'input'", "longitude": "'input'", "drift_flag": "'derived/assumed'"}.get(name, "'derived'")


def live_rows(spark, sf):
    return live.live_features(A.live_requests(spark, sf), A.observations(spark, sf), live_weather(spark, sf), digits=None)


@register("live_features", f"""SELECT request_id, pollutant, {STATUS} AS status, {text_time('t0', 'latest_hour')},
    {text_time('t0 + INTERVAL 24 HOUR', 'target_time')}, {fields(READINGS)}, {fields(CALENDAR)}, CAST(season AS DOUBLE) AS season, latitude, longitude, CAST(0 AS DOUBLE) AS drift_flag,
    {', '.join(f"{snap(f'CAST(CASE WHEN {A_FINE} THEN {a} WHEN {B_FINE} THEN {b} END AS DOUBLE)')} AS {c}" for c, (a, b) in LIVE_WX.items())},
    concat_ws('; ', {', '.join(f"'{c}=' || {_label(c)}" for c in sorted(C.FEATURES))}) AS feature_provenance,
    concat_ws('; ', {COVER_SAID}, {FEATURE_SAID}) AS warnings, {SOURCE} AS weather_source, {FAILED} AS weather_error,
    n_raw_obs, coverage_hours, missing_hours, sources, parameters_seen
    FROM (SELECT live.*, {calendar('t0')}, cover.* EXCLUDE (request_id, pollutant) FROM live JOIN cover ON cover.request_id = live.request_id)""")
def _(spark, sf):
    labels = F.transform(F.array_sort(F.map_entries("feature_provenance")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return live_rows(spark, sf).drop("features_used").withColumns({
        "sources": F.array_join("sources", ", "), "parameters_seen": F.array_join("parameters_seen", ", "),
        "feature_provenance": F.array_join(labels, "; "), "warnings": said()})


_MISSING = " + ".join(f"CAST({c} IS NULL AS BIGINT)" for c in READINGS)
_WX3 = f"CASE WHEN {A_FINE} OR {B_FINE} THEN 3 ELSE 0 END"


@register("provenance_counts", f"""SELECT request_id, CAST({' + '.join(f'CAST({c} IS NOT NULL AS BIGINT)' for c in READINGS[:3])} + {_WX3} AS BIGINT) AS live,
    CAST({' + '.join(f'CAST({c} IS NOT NULL AS BIGINT)' for c in READINGS[3:])} + 7 AS BIGINT) AS derived,
    CAST({_MISSING} + 3 - {_WX3} AS BIGINT) AS unavailable, CAST(1 AS BIGINT) AS assumed, CAST(20 AS BIGINT) AS total FROM live""")
def _(spark, sf):
    return live.provenance_counts(live_rows(spark, sf))
