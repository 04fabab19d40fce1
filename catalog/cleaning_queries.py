"""Scans of raw rows, cleaning, quality reports."""

from __future__ import annotations

from catalog import adapter as A
from catalog.ctes import P, each, fields, station, text_time
from catalog.registry import register
from catalog.snap import sql as snap
from hourgrid.operators import cleaning, quality

KEYS = f"station_id, {text_time('timestamp_utc')}"
PARSED = "try_strptime(date_gmt || ' ' || time_gmt, '%Y-%m-%d %H:%M')"


def wide(spark, sf):
    return cleaning.pivot_hours(cleaning.measurements(A.raw_long(spark, sf)))


def normal(spark, sf):
    return cleaning.normalize(A.raw_long(spark, sf))


def clean(spark, sf):
    return cleaning.clean_hourly(A.raw_long(spark, sf))


@register("station_id", f"SELECT event_id, {station('state_code', 'county_code', 'site_number')} AS station_id FROM raw")
def _(spark, sf):
    return cleaning.with_station_id(A.raw_long(spark, sf)).select("event_id", "station_id")


@register("parse_utc", f"SELECT event_id, {text_time(PARSED, 'timestamp_utc')} FROM raw WHERE date_gmt <> 'bad'")
def _(spark, sf):
    return cleaning.parse_utc(A.raw_long(spark, sf)).select("event_id", "timestamp_utc")


@register("param_filter_map", """SELECT event_id, CASE parameter_code WHEN '88101' THEN 'pm25' WHEN '42602' THEN 'no2'
    ELSE 'ozone' END AS pollutant FROM raw WHERE parameter_code IN ('88101', '42602', '44201')""")
def _(spark, sf):
    return cleaning.keep_parameters(A.raw_long(spark, sf)).select("event_id", "pollutant")


@register("station_meta", "SELECT station_id, latitude, longitude, state, county FROM meta")
def _(spark, sf):
    return cleaning.station_metadata(cleaning.measurements(A.raw_long(spark, sf)))


@register("poc_mean", f"""SELECT {KEYS}, pollutant, {snap('avg(value)')} AS value FROM meas
    GROUP BY meas.station_id, meas.timestamp_utc, pollutant""")
def _(spark, sf):
    return cleaning.sensor_mean(cleaning.measurements(A.raw_long(spark, sf)))


@register("pivot_wide", f"SELECT {KEYS}, {fields(P)} FROM wide")
def _(spark, sf):
    return wide(spark, sf)


@register("station_range", f"SELECT station_id, {text_time('a', 'first_hour')}, {text_time('z', 'last_hour')} FROM rng")
def _(spark, sf):
    return cleaning.station_range(wide(spark, sf))


@register("hourly_grid", f"SELECT {KEYS} FROM grid")
def _(spark, sf):
    return cleaning.hourly_grid(cleaning.station_range(wide(spark, sf)))


@register("grid_join", f"SELECT {KEYS}, {fields(P)} FROM norm")
def _(spark, sf):
    hours = wide(spark, sf)
    return cleaning.grid_join(cleaning.hourly_grid(cleaning.station_range(hours)), hours)


@register("meta_join", f"""SELECT w.station_id, {text_time('w.timestamp_utc', 'timestamp_utc')}, latitude, longitude, state, county
    FROM wide w LEFT JOIN meta m ON w.station_id = m.station_id""")
def _(spark, sf):
    rows = cleaning.measurements(A.raw_long(spark, sf))
    return cleaning.attach_metadata(cleaning.pivot_hours(rows), cleaning.station_metadata(rows)).drop(*P)


@register("normalize", f"SELECT {KEYS}, {fields(P)}, latitude, longitude, state, county FROM norm")
def _(spark, sf):
    return normal(spark, sf)


@register("interpolate_gaps", f"SELECT {KEYS}, {fields(P)}, {each('{p}_interp_flag')} FROM filled")
def _(spark, sf):
    return cleaning.interpolate_gaps(normal(spark, sf)).drop(*cleaning.METADATA)


@register("neg_flag", f"SELECT {KEYS}, {each('coalesce({p} < 0, false) AS {p}_neg_flag')} FROM wide")
def _(spark, sf):
    return cleaning.flag_negative(wide(spark, sf)).drop(*P)


@register("bounds_flag_null", f"SELECT {KEYS}, {fields(P)}, {each('{p}_bounds_flag')} FROM bounded")
def _(spark, sf):
    return cleaning.flag_bounds(cleaning.interpolate_gaps(normal(spark, sf))).select(
        "station_id", "timestamp_utc", *P, *(f"{p}_bounds_flag" for p in P)
    )


@register("drift_flag", f"SELECT {KEYS}, {each('{p}_drift_flag')} FROM clean")
def _(spark, sf):
    bounded = cleaning.flag_bounds(cleaning.interpolate_gaps(normal(spark, sf)))
    return cleaning.flag_drift(bounded).select("station_id", "timestamp_utc", *(f"{p}_drift_flag" for p in P))


FLAGS = tuple(f"{p}_{f}_flag" for p in P for f in ("interp", "neg", "bounds", "drift"))


@register("clean_hourly", f"SELECT {KEYS}, {fields(P)}, latitude, longitude, state, county, {', '.join(FLAGS)} FROM clean")
def _(spark, sf):
    return clean(spark, sf)


@register("stations_by_pollutant", """SELECT pollutant, count(*) FILTER (WHERE readings > 0) AS stations,
    count(*) AS station_count FROM pcounts GROUP BY pollutant""")
def _(spark, sf):
    return quality.stations_by_pollutant(clean(spark, sf))


@register("schema_metrics", """SELECT (SELECT count(*) FROM raw) AS raw_rows,
    (SELECT count(*) FROM raw WHERE date_gmt <> 'bad') AS rows_after_ts_parse,
    (SELECT count(*) FROM meas) AS rows_after_param_filter, count(*) AS pivoted_rows,
    CAST(9 AS BIGINT) AS pivoted_cols, count(DISTINCT station_id) AS station_count FROM norm""")
def _(spark, sf):
    raw = A.raw_long(spark, sf)
    return quality.schema_metrics(raw, cleaning.normalize(raw))


def _missing(active: str, readings: str, prefix: str = "") -> str:
    total, miss = f"coalesce(sum(hours) FILTER (WHERE {active}), 0)", f"coalesce(sum(hours - ({readings})) FILTER (WHERE {active}), 0)"
    pct = f"coalesce(round({miss} / nullif({total}, 0) * 100, 2), 0.0)"
    return f"CAST({total} AS BIGINT) AS {prefix}total_expected, CAST({miss} AS BIGINT) AS {prefix}missing_count, {snap(pct)} AS {prefix}missing_pct"


@register("missingness", f"SELECT pollutant, {_missing('readings > 0', 'readings')} FROM pcounts GROUP BY pollutant")
def _(spark, sf):
    return quality.missingness(clean(spark, sf))


OBSERVED = "readings + bounds - interp"
GAPS = f"""SELECT pollutant, CAST(sum(interp) AS BIGINT) AS interpolated,
    CAST(coalesce(sum(hours - readings - bounds) FILTER (WHERE {OBSERVED} > 0), 0) AS BIGINT) AS long_gaps_remaining,
    {_missing(OBSERVED + ' > 0', OBSERVED, 'before_')}, {_missing(OBSERVED + ' > 0', 'readings + bounds', 'after_')}
    FROM pcounts GROUP BY pollutant"""
OUTLIERS = """SELECT pollutant, CAST(sum(neg) AS BIGINT) AS negative, CAST(sum(bounds) AS BIGINT) AS beyond_bounds,
    CAST(sum(drift) AS BIGINT) AS drift_flagged FROM pcounts GROUP BY pollutant"""


@register("gap_counts", GAPS)
def _(spark, sf):
    return quality.gap_counts(clean(spark, sf))


@register("outlier_counts", OUTLIERS)
def _(spark, sf):
    return quality.outlier_counts(clean(spark, sf))


def _unpivot(section: str, body: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{section}' AS section, pollutant, '{c}' AS metric, {snap(f'CAST({c} AS DOUBLE)')} AS value FROM ({body})"
        for c in columns
    )


_MISS = ["total_expected", "missing_count", "missing_pct"]


REPORT = " UNION ALL ".join((
    _unpivot("schema", """SELECT '' AS pollutant, (SELECT count(*) FROM raw) AS raw_rows,
        (SELECT count(*) FROM raw WHERE date_gmt <> 'bad') AS rows_after_ts_parse,
        (SELECT count(*) FROM meas) AS rows_after_param_filter, count(*) AS pivoted_rows, 9 AS pivoted_cols,
        count(DISTINCT station_id) AS station_count FROM norm""",
             ["raw_rows", "rows_after_ts_parse", "rows_after_param_filter", "pivoted_rows", "pivoted_cols", "station_count"]),
    _unpivot("schema", "SELECT pollutant, count(*) FILTER (WHERE readings > 0) AS stations FROM pcounts GROUP BY pollutant", ["stations"]),
    _unpivot("missingness", GAPS, ["interpolated", "long_gaps_remaining", *("before_" + m for m in _MISS), *("after_" + m for m in _MISS)]),
    _unpivot("outliers", OUTLIERS, ["negative", "beyond_bounds", "drift_flagged"]),
))


@register("cleaning_report", REPORT)
def _(spark, sf):
    raw = A.raw_long(spark, sf)
    return quality.cleaning_report_rows(raw, cleaning.clean_hourly(raw))


@register("dataset_profile", """SELECT count(*) AS rows, count(DISTINCT station_id) AS stations,
    count(DISTINCT state) AS states FROM norm""")
def _(spark, sf):
    return quality.dataset_profile(normal(spark, sf))
